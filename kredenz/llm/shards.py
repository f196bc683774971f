"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

The permutation is a bijection of ``[0, n)``: a balanced Feistel network over the
next even power of two, walked along its cycle until the value falls below ``n``.
Position ``p`` of a row gives its shard ``p mod shards`` and slot ``p div shards``,
so shard sizes differ by one row at most, slots have no gaps, and the place of any
row (and the row at any place, ``row_at``) can be computed without the table.

Row numbers follow ``(doc_id, text_crc32, size)``. Rows equal in all three are
interchangeable: whichever is numbered first, the table of places is the same.
Null texts count as empty (crc 0); null ids come first. An empty table gives no rows.
Only ids, sizes and checksums are shuffled, never texts, so their length doesn't matter. Other columns are not
read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kredenz.runtime import with_position

ROUNDS = 6
GOLDEN, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def scramble(x: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit value of each x (finalizer with multiplications)."""
    x = x + np.uint64(GOLDEN)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


class Permutation:
    """A keyed bijection of ``[0, n)``."""

    def __init__(self, n: int, seed: int):
        self.n = n
        self.half = np.uint64(max(1, ((max(n, 2) - 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = scramble(np.arange(ROUNDS, dtype=np.uint64) + np.uint64((seed * 1_000_003) % 2**64))

    def _pass(self, x: np.ndarray, backward: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys[::-1] if backward else self.keys:
            if backward:
                left, right = right ^ (scramble(left ^ key) & self.mask), left
            else:
                left, right = right, left ^ (scramble(right ^ key) & self.mask)
        return (left << self.half) | right

    def _walk(self, x: np.ndarray, backward: bool) -> np.ndarray:
        out = self._pass(np.asarray(x, dtype=np.uint64), backward)
        while (far := out >= self.n).any():
            out[far] = self._pass(out[far], backward)
        return out.astype(np.int64)

    def place(self, rows: np.ndarray) -> np.ndarray:
        return self._walk(rows, backward=False)

    def row(self, places: np.ndarray) -> np.ndarray:
        return self._walk(places, backward=True)


def row_at(n: int, shards: int, seed: int, shard: int, slot: int) -> int:
    """Row number held by ``(shard, slot)``."""
    return int(Permutation(n, seed).row(np.array([slot * shards + shard]))[0])


def assign_shards(docs: DataFrame, shards: int = 24, seed: int = 7) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number``."""
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col("text"), F.lit(""))
    small = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("read_order"),  # spreads one hot id over blocks
    )
    numbered = with_position(small, "doc_id", "text_crc32", "size", "read_order", name="row_number")
    total = docs.count()

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Permutation(total, seed)
        for batch in batches:
            if not batch.num_rows:
                continue
            at = order.place(batch.column("row_number").to_numpy(zero_copy_only=False))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("size"),
                    batch.column("text_crc32"),
                    pa.array(["rows"] * n),
                    pa.array((at % shards).astype(np.int32)),
                    pa.array(at // shards),
                    pa.nulls(n, pa.int32()),
                    batch.column("row_number"),
                ],
                names=["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "row_number"],
            )

    schema = (
        "doc_id long, size long, text_crc32 long, law string, shard int, slot long, "
        "grown_shard int, row_number long"
    )
    return numbered.select("doc_id", "size", "text_crc32", "row_number").mapInArrow(place, schema)
