"""Rounding follows the exact binary value."""

import random
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from kredenz.functions.numbers import exact_round, exact_units


def _values():
    rng = random.Random(5)
    ties = [k / 2000 for k in range(1, 4000)] + [k / 800 for k in range(801)] + [2.675, 1.45, 1.25, 0.0, 255.0]
    return ties + [rng.random() * 300 for _ in range(3000)]


def test_round_agrees_with_python(spark):
    values = _values()
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for places in (1, 2, 3):
        rounded = df.select("v", exact_round(F.col("v"), places).alias("r")).collect()
        assert [(r.v, r.r) for r in rounded if r.r != round(r.v, places)] == []


def test_units_with_ties_up(spark):
    df = spark.createDataFrame([(v,) for v in _values()], "v double")
    for row in df.select("v", exact_units(F.col("v"), 10, ties_up=True).alias("u")).collect():
        exact = (Decimal(row.v) * 10).quantize(Decimal(1), ROUND_HALF_UP)
        assert row.u == int(exact), row.v
