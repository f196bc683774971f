"""What the plans must not contain, and what the scans must read."""

import re

import pytest

from kredenz.plans.catalog import QUERIES

# One task sees one row per shuffle partition here, never the data.
OFFSETS = {"rating_join"}
SPANS = {"doc_id_assign"}
PYTHON = {
    "otp_replay", "verified_phones", "otp_state", "image_adjust", "apply_detector", "image_quality",
    "photo_variance", "image_rows_quality", "capture_from_pixels", "capture_result",
}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def shuffled(spark):
    """Plans as they are for large tables: nothing is small enough to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(shuffled, folder, name):
    plan = plan_of(QUERIES[name](shuffled, folder))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert ("SinglePartition" in plan) == (name in OFFSETS | SPANS)
    assert bool(re.search("MapInPandas|EvalPython", plan)) == (name in PYTHON)
    # A broadcast without a threshold is a hint: only the offset table has one.
    assert ("BroadcastExchange" in plan) == (name in OFFSETS)


@pytest.mark.parametrize(
    "name, table, columns",
    [
        ("status_latest", "orders", {"o_orderkey", "o_custkey", "o_orderdate"}),
        ("capture_pick", "events", {"event_id", "ts", "user_id"}),
        ("field_counts", "lineitem", {"l_orderkey", "l_partkey", "l_suppkey"}),
        ("decode_national_id", "customer", {"c_custkey"}),
        ("upload_guard", "documents", {"doc_id", "text"}),
    ],
)
def test_only_needed_columns_are_read(spark, folder, name, table, columns):
    plan = plan_of(QUERIES[name](spark, folder))
    schemas = re.findall(rf"FileScan parquet \[([^\]]*)\][^\n]*{table}\.parquet", plan)
    read = {re.sub(r"#\d+L?", "", c).strip() for s in schemas for c in s.split(",")}
    assert read == columns


def test_latest_keeps_partial_aggregates(shuffled, folder):
    """Hot keys are reduced before the shuffle."""
    for name in ("result_upsert", "status_latest", "field_last_wins", "field_first_wins", "field_counts"):
        assert "partial_" in plan_of(QUERIES[name](shuffled, folder)), name
    bounds = plan_of(QUERIES["asset_list"](shuffled, folder))
    assert re.search(r"WindowGroupLimit[^\n]*Partial", bounds)


def test_digits_are_dealt_by_image_and_column(shuffled, folder):
    """Two exchanges, no join: the first on image and column, the second of short pieces."""
    plan = plan_of(QUERIES["digit_assemble"](shuffled, folder))
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan)
    assert [re.sub(r"#\d+L?", "", k) for k in keys] == ["image_id", "image_id, x_block"]
    assert "Join" not in plan and plan.count("FileScan") == 1


def test_digits_of_records_are_shuffled_once(shuffled, folder):
    """Dealt by number box, where they meet the record: no exchange of blocks or pieces."""
    for name in ("national_id_records", "national_id_results", "national_id_summary"):
        plan = plan_of(QUERIES[name](shuffled, folder))
        keys = [re.sub(r"#\d+L?", "", k) for k in re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan)]
        assert not any("x_block" in k for k in keys), name
        assert keys.count("image_id, angle, nid_seq") == 2, name


def test_pixels_are_not_shuffled(shuffled, folder):
    for name in ("image_quality", "photo_variance", "image_rows_quality"):
        assert "Exchange" not in plan_of(QUERIES[name](shuffled, folder)), name


def test_replay_is_one_plan_by_block(shuffled, folder):
    """Nothing runs while the replay is built, and its rows are dealt by phone and block."""
    plan = plan_of(QUERIES["otp_replay"](shuffled, folder))
    assert plan.count("FileScan") == 2 and "RDD" not in plan
    assert len(re.findall(r"Exchange hashpartitioning\(phone#\d+, block#\d+L?, \d+\)", plan)) >= 2
    assert plan.count("MapInPandas") == 3
