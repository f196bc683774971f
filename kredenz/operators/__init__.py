"""Table operators: DataFrame in, DataFrame out, no actions on the data path."""
