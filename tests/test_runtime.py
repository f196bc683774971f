"""Session helpers: scratch folder and ranks."""

import random
from types import SimpleNamespace

from pyspark.sql import functions as F

from kredenz.runtime import drop_scratch, scratch_path, shared_dir, with_rank


def test_scratch_lies_in_the_folder_the_session_names(spark, tmp_path):
    named = SimpleNamespace(conf={"spark.checkpoint.dir": f"{tmp_path}/"}, sparkContext=spark.sparkContext)
    assert shared_dir(named) == str(tmp_path)
    one, other = (scratch_path(named, "x") for _ in range(2))
    assert one != other and one.startswith(f"{tmp_path}/x-")
    spark.range(3).write.parquet(one)
    drop_scratch(spark, one)
    assert [p.name for p in tmp_path.glob("x-*")] == [other.split("/")[-2]]


def test_scratch_without_a_named_folder_lies_beside_the_tables(spark, tmp_path):
    settings = {"spark.sql.warehouse.dir": f"file://{tmp_path}/tables"}
    session = SimpleNamespace(conf=settings, sparkContext=spark.sparkContext)
    own = shared_dir(session)
    assert own.startswith(settings["spark.sql.warehouse.dir"]) and shared_dir(session) == own
    assert (tmp_path / "tables").is_dir() and "spark.checkpoint.dir" not in settings


def test_ranks_over_blocks_and_spans(spark):
    """Negative, close, far and equal values."""
    dice = random.Random(1)
    values = [dice.randrange(-(2**40), 2**40) for _ in range(500)] + list(range(300)) + [7] * 20 + [2**50, -(2**50)]
    rows = spark.createDataFrame([(v, k) for k, v in enumerate(values)], "seq long, k long").repartition(7)
    got = with_rank(rows, "seq", "rank").orderBy("rank").collect()
    assert [r.rank for r in got] == list(range(len(values)))
    assert [r.seq for r in got] == sorted(values)
    assert with_rank(rows.where(F.col("k") < 0), "seq", "rank").count() == 0
