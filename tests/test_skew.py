"""One key holds a third of all rows: same values as SQL, and no block is left large."""

import os
import random

import duckdb
import pytest
from check_oracle import compare, tables
from pyspark.sql import functions as F

from kredenz.operators import detections, otp
from kredenz.plans.catalog import TEST_TTL
from kredenz.runtime import with_position
from kredenz.sources.tables import Inputs

HOT = {
    "lineitem": ("l_orderkey", "l_partkey % 3 = 0", "0"),
    "events": ("user_id", "event_id % 3 = 0", "0"),
    "orders": ("o_custkey", "o_orderkey % 3 = 0", "0"),
    "customer": ("c_nationkey", "c_custkey % 3 = 0", "1"),
}


@pytest.fixture(scope="module")
def hot_folder(tmp_path_factory, folder):
    out = tmp_path_factory.mktemp("hot")
    db = duckdb.connect()
    for file in os.listdir(folder):
        name, source = file.removesuffix(".parquet"), f"'{folder}/{file}'"
        rows = f"SELECT * FROM {source}"
        if name in HOT:
            key, when, value = HOT[name]
            rows = f"SELECT * REPLACE (CASE WHEN {when} THEN {value} ELSE {key} END AS {key}) FROM {source}"
        if name == "lineitem":
            rows = f"""SELECT * FROM ({rows}) QUALIFY row_number() OVER (
                PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey) = 1"""
        db.execute(f"COPY ({rows}) TO '{out}/{file}' (FORMAT parquet)")
    return str(out)


@pytest.mark.parametrize(
    "name",
    ["orientation_score", "orientation_best", "avg_confidence", "digit_assemble", "field_last_wins", "field_first_wins",
     "missing_fields", "national_id_records", "national_id_results", "capture_pick", "otp_replay", "otp_state", "verified_phones",
     "status_latest", "case_review", "country_lookup"],
)
def test_values_with_a_hot_key(spark, hot_folder, name):
    assert compare(spark, tables(hot_folder), hot_folder, name) == ""


def test_crowded_images_read_like_the_others(spark):
    """Digits come out in order, ties included, and a crowded image is dealt out by pixel column."""
    rng = random.Random(2)
    boxes = [(rng.choice([1, 1, 1, 2, 3]), i, rng.randrange(10), rng.randrange(12)) for i in range(900)]
    digits = spark.createDataFrame(boxes, "image_id int, det_seq int, digit int, x1 int")
    expected = {
        image: "".join(str(d) for m, _, d, _ in sorted(boxes, key=lambda b: (b[3], b[1])) if m == image)
        for image in (1, 2, 3)
    }
    rows = detections.digit_assemble(digits).collect()
    assert {r.image_id: r.id_number for r in rows} == expected
    assert {r.image_id: r.n_digits for r in rows} == {k: len(v) for k, v in expected.items()}
    tasks = digits.repartition(8, "image_id", "x1").where("image_id = 1").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 1 and max(r["count"] for r in tasks) < 0.7 * sum(r["count"] for r in tasks)


def test_a_checked_phone_gives_the_walk_one_check_a_code(spark):
    """A phone under a guessing attack over many blocks: the walk reads a small, bounded part."""
    ttl = 30 * otp.MICROS
    events = [(k, "p", "verify", f"{k % 50:06d}", k * otp.MICROS // 4) for k in range(48_000)]
    rows = spark.createDataFrame(events, "event_id long, phone string, action string, code string, micros long")
    blocks = rows.withColumn("block", F.floor(F.col("micros") / (otp.WINDOW * ttl))).repartition("phone", "block")
    openings = blocks.sortWithinPartitions("phone", "block", "micros", "event_id").mapInPandas(otp._openings(ttl), otp.OPENINGS)
    per_block = {r.block: r["count"] for r in openings.groupBy("block").count().collect()}
    assert len(per_block) == 20 and max(per_block.values()) <= 50
    stamped = rows.withColumn("ts", F.timestamp_micros("micros"))
    assert {r.message for r in otp.otp_replay(stamped).select("message").distinct().collect()} == {otp.NONE}


def test_a_hot_phone_fills_many_even_blocks(spark, hot_folder):
    window = otp.WINDOW * TEST_TTL * otp.MICROS
    events = Inputs(spark, hot_folder).otp_events().withColumn("block", F.floor(otp.micros() / window))
    hot = events.groupBy("phone").count().orderBy(F.desc("count")).first().phone
    sizes = [r["count"] for r in events.where(F.col("phone") == hot).groupBy("block").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 2 * sum(sizes) / len(sizes)


def test_positions_with_equal_leading_keys(spark):
    rows = spark.range(5000).select(F.lit("same").alias("k"), (F.col("id") * 7919 % 5003).alias("v"))
    got = with_position(rows.repartition(6), "k", "v").orderBy("v").collect()
    assert [r.position for r in got] == list(range(5000))


def test_digits_of_long_rows_and_other_classes(spark):
    """More digits than a whole number holds, leading zeros, ties, and boxes that are no digit."""
    dice = random.Random(9)
    boxes = [(1, k, 0 if k < 25 else dice.randrange(10), 5) for k in range(60)]  # one column, in arrival order
    boxes += [(2, k, dice.choice([None, 0, 3, 9, 12, -1]), dice.randrange(-70, 140)) for k in range(80)]
    boxes += [(3, 0, None, 4), (3, 1, 77, 4)]
    dice.shuffle(boxes)
    frame = spark.createDataFrame(boxes, "image_id int, det_seq int, digit int, x1 int").repartition(5)
    got = {r.image_id: (r.id_number, r.n_digits) for r in detections.digit_assemble(frame).collect()}
    want = {}
    for image in (1, 2, 3):
        own = sorted(((x, s, d) for i, s, d, x in boxes if i == image), key=lambda b: b[:2])
        want[image] = ("".join(str(d) for _, _, d in own if d is not None and 0 <= d <= 9) or None, len(own))
    assert got == want
