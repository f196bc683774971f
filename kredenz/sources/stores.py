"""Tables stored for lookups by key: sorted by it, with a bloom filter of it in every row group.

A lookup reads the row groups that may hold a key and nothing else; the store is never shuffled
unless the keys themselves are a large table.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

FEW = 1_000  # keys that become filters of the scan
AT_ONCE = 10  # keys of one filter: Parquet compares up to so many one by one
MANY = 1_000_000  # keys that are broadcast
GROUP_BYTES = 16 << 20


def write_store(table: DataFrame, path: str, key: str, values: int = 1_000_000) -> None:
    """Write ``table`` for lookups by ``key``; ``values`` is how many distinct keys a file may have, for its filters' size.

    Rows are dealt out by ranges of the key, so files don't overlap; one key's rows may fill several files.
    """
    spread = table.repartitionByRange(key, F.xxhash64(*table.columns)).sortWithinPartitions(key)
    writer = spread.write.option("parquet.block.size", GROUP_BYTES)
    writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
    writer.option(f"parquet.bloom.filter.expected.ndv#{key}", values).mode("overwrite").parquet(path)


def any_of(key: str, wanted: list) -> Column:
    """``key`` is one of ``wanted``, as filters that reach the scan."""
    parts = [F.col(key).isin(wanted[k : k + AT_ONCE]) for k in range(0, len(wanted), AT_ONCE)]
    return reduce(or_, parts, F.lit(False))


def look_up(spark: SparkSession, path: str, keys: DataFrame, key: str) -> DataFrame:
    """Every key of ``keys`` once, with its stored rows, or nulls where there are none.

    Up to ``FEW`` keys are read first and pushed to the scan; up to ``MANY`` are broadcast; beyond
    them both sides are shuffled.
    """
    store, wanted = spark.read.parquet(path), keys.select(key).distinct()
    few = [r[0] for r in wanted.where(F.col(key).isNotNull()).limit(FEW + 1).collect()]
    if len(few) <= FEW:
        found = store.where(any_of(key, few))
    elif wanted.limit(MANY + 1).count() <= MANY:
        found = store.join(F.broadcast(wanted), key, "left_semi")
    else:
        return wanted.join(store, key, "left")
    # What was found is small beside the store: the keys are joined to it.
    return wanted.join(found, key, "left")
