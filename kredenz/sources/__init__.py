"""Where tables and images come from."""
