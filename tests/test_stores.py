"""Lookups in stored tables, and faces whose image can't be read."""

import re

import pytest
from pyspark.sql import functions as F

from kredenz.operators.faces import face_pair_join, face_response, face_similarity
from kredenz.sources import stores
from kredenz.sources.stores import look_up, write_store

ROWS = 60_000


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "rows")
    rows = spark.range(ROWS).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.xxhash64("id").cast("string"))).alias("key"),
        F.col("id").alias("n"), F.repeat(F.lit("x"), 50).alias("body"),
    )
    write_store(rows, path, "key")
    return path, rows


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def wanted(spark, rows, n):
    some = rows.where("key <> 'hot'").orderBy("n").limit(n).select("key")
    return some.union(spark.createDataFrame([("absent",), ("also absent",), (None,)], "key string")).union(some.limit(1))


@pytest.mark.parametrize("few, many", [(1_000, 1_000_000), (3, 1_000_000), (3, 3)])
def test_every_way_gives_each_key_its_rows(spark, store, monkeypatch, few, many):
    path, rows = store
    monkeypatch.setattr(stores, "FEW", few)
    monkeypatch.setattr(stores, "MANY", many)
    keys = wanted(spark, rows, 25)
    got = {(r.key, r.n) for r in look_up(spark, path, keys, "key").collect()}
    have = {(r.key, r.n) for r in rows.join(keys.distinct(), "key").collect()}
    assert len(have) == 25 and got == have | {("absent", None), ("also absent", None), (None, None)}


def test_hot_key_and_no_keys(spark, store):
    path, rows = store
    assert look_up(spark, path, spark.createDataFrame([("hot",)], "key string"), "key").count() == ROWS // 3
    assert look_up(spark, path, rows.select("key").limit(0), "key").count() == 0


def test_store_is_not_shuffled_and_keys_reach_the_scan(spark, store, monkeypatch):
    path, rows = store
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keys = wanted(spark, rows, 25)
        plan = plan_of(look_up(spark, path, keys, "key"))
        assert re.search(r"PushedFilters: \[[^\]]*Or\(", plan) and "In(key" in plan
        monkeypatch.setattr(stores, "FEW", 3)
        lines = plan_of(look_up(spark, path, keys, "key")).splitlines()
        # The scan of the store meets the keys in a broadcast join, before anything is exchanged.
        scan = next(k for k, line in enumerate(lines) if "FileScan parquet" in line)
        join = max(k for k, line in enumerate(lines[:scan]) if "BroadcastHashJoin" in line)
        assert "Exchange" not in "".join(lines[join:scan])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_row_groups_without_a_key_are_not_read(spark, tmp_path):
    """Values between a row group's least and greatest that are not there: the bloom filter tells."""
    import pyarrow.parquet as pq

    rows = spark.range(0, 40_000, 2).select(F.format_string("%08d", "id").alias("key"), "id")
    path = f"{tmp_path}/even"
    write_store(rows, path, "key")
    files = list((tmp_path / "even").glob("*.parquet"))
    groups = [pq.ParquetFile(f).metadata.row_group(0).column(0) for f in files]
    assert all(g.statistics.has_min_max for g in groups)

    def scanned(key):
        found = spark.read.parquet(path).where(stores.any_of("key", [key]))
        plan = found._jdf.queryExecution().executedPlan()
        found._jdf.queryExecution().executedPlan().executeCollectPublic()
        leaves = plan.collectLeaves()
        return leaves.apply(0).metrics().get("numOutputRows").get().value()

    assert 0 < scanned("00020000") < 40_000 and scanned("00020001") == 0


def test_faces_of_images_that_cannot_be_read(spark):
    schema = "case_id long, {}_embedding array<double>, load_error string"
    vector = [1.0, 0.5]
    ids = [(1, vector, None), (2, None, "cannot identify image file"), (3, vector, None), (4, None, "bad padding"), (5, None, None), (6, None, "x")]
    lives = [(1, vector, None), (2, vector, None), (3, None, "truncated"), (4, None, "other"), (5, None, "late")]
    pairs = face_pair_join(spark.createDataFrame(ids, schema.format("id")), spark.createDataFrame(lives, schema.format("live")))
    assert pairs.columns == ["case_id", "id_embedding", "live_embedding", "error"]
    verified = face_similarity(pairs)
    got = {r.case_id: (r.similarity_score, r.error) for r in verified.collect()}
    assert got[1][0] == pytest.approx(1) and got[1][1] is None
    assert {k: e for k, (_, e) in got.items() if k > 1} == {
        2: "Invalid image data: cannot identify image file",
        3: "Invalid image data: truncated",
        4: "Invalid image data: bad padding",  # the ID image is read first
        5: "Invalid image data: late",
        6: "Both id_image and live_image are required",
    }
    said = face_response(verified, F.lit("now")).where("case_id = 2").first()
    assert not said.success and said.verification_result is None and said.error.startswith("Invalid image data")
