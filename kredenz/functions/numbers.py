"""Rounding and order-free sums."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BILLION = 1_000_000_000


def half_up(c: Column) -> Column:
    """Round to the nearest whole number, halves upwards."""
    return F.floor(c + F.lit(0.5)).cast("bigint")


def exact_units(x: Column, per: int, ties_up: bool = False) -> Column:
    """Number of 1/``per`` parts nearest to ``x``, judged on its exact binary value.

    Spark's own rounding works on the printed decimal, so 0.5025 rounds up to
    0.503 although the stored value lies below it. Here ``x * per`` is compared
    with the midpoint without error: ``x`` is split into two halves whose
    products with ``per`` are exact. Exact ties go to the even neighbour, or up.
    """
    wide = x * F.lit(134217729.0)  # 2**27 + 1 splits a double in two
    high = wide - (wide - x)
    below = F.floor(x * F.lit(float(per)))
    gap = (high * F.lit(float(per)) - (below + F.lit(0.5))) + (x - high) * F.lit(float(per))
    tie_up = F.lit(True) if ties_up else below % 2 != 0
    return below + F.when((gap > 0) | ((gap == 0) & tie_up), 1).otherwise(0)


def exact_round(x: Column, places: int) -> Column:
    """Round to decimal places on the exact binary value, ties to even."""
    per = 10**places
    return exact_units(x, per) / F.lit(float(per))


def one_decimal(tenths: Column) -> Column:
    """Text of a whole number of tenths, such as 15 -> '1.5'."""
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def exact_sum(c: Column) -> Column:
    """Sum of fractions in whole billionths.

    Adding integers gives the same answer in every order, so ties between
    groups do not depend on how rows were shuffled.
    """
    return F.coalesce(F.sum(F.rint(c * F.lit(float(BILLION))).cast("bigint")), F.lit(0))


def exact_mean(total: Column, n: Column) -> Column:
    """Mean from ``exact_sum`` and a count; null for no rows."""
    return F.when(n > 0, total / F.lit(float(BILLION)) / n)


def population_variance(n: Column, s: Column, s2: Column) -> Column:
    """Variance of integers from their count, sum and sum of squares."""
    n_ = n.cast("double")
    return F.when(n > 0, (n_ * s2 - s.cast("double") * s) / (n_ * n_))
