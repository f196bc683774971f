"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Codes are signs of rotated, centred unit vectors; each rotation is learned by
iterative quantization on a bounded sample (``SAMPLE`` rows), and ``ROTATIONS`` of them
give ``dimension * ROTATIONS`` bits. A code is cut into bytes, and each byte position is an
index from value to rows. For a radius r, byte j is probed within its own radius r_j
with ``sum(r_j + 1) > r``: by the pigeonhole principle that retrieves every code within r.
Retrieved codes are checked against r, then ranked by exact cosine in double
precision. The radius is the distance that holds ``recall`` of the sample's true
neighbours; neighbours among all rows are nearer, so recall there is higher. A
partition that has fewer than k rows within the radius is probed wider until it has
k or no more rows, so a query always gets k rows if there are that many.

Rows are dealt into shards of bounded size; each shard is indexed once, in the task that holds it, and answers all
queries, which reach it through the same shuffle, sorted behind its rows. A task holds one
shard and one batch of queries; no query passes through the driver. Shards return their k best of each query.
Equal vectors of a shard are one index row with their
k + 1 smallest ids: enough for any answer, however many copies there are.

How much the probes leave out depends on the vectors: with the radius near half the bits, as for vectors
without structure, they mark almost every row, and the check against the radius does the pruning
(``probed`` tells both shares).

Vectors that are null, zero or hold null or non-finite components take no part.
Vectors are compared with those of the same dimension only. Ties go to the smaller
id. An empty table gives no rows; a query alone in its table gives none. Rows that
share an id are one candidate with the best of their scores; a query id with several
rows asks with one of them (the smallest vector). Other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from kredenz.llm.batches import answered, shard_count

SAMPLE = 4_000
ROTATIONS = 2
ROUNDS = 30
SHARD_ROWS = 2_048, 131_072  # least and most rows of a shard
ONES = np.bitwise_count(np.arange(256, dtype=np.uint8))
BY_DISTANCE = [np.flatnonzero(ONES == k).astype(np.uint8) for k in range(9)]


def vectors(batch: pa.RecordBatch | pa.Table, column: str = "embedding") -> np.ndarray:
    lists = batch.column(column)
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


class Coder:
    """Binary codes learned from a sample of vectors, and the search radius."""

    def __init__(self, sample: np.ndarray, k: int, recall: float):
        x = unit(np.unique(sample, axis=0))
        self.mean = x.mean(0)
        centred = x - self.mean
        _, _, axes = np.linalg.svd(centred, full_matrices=True)
        dice = np.random.default_rng(0)
        d = x.shape[1]
        self.rotation = []
        for _ in range(ROTATIONS):
            projected = centred @ axes.T
            turn, _ = np.linalg.qr(dice.normal(size=(d, d)))
            for _ in range(ROUNDS):
                signs = np.where(projected @ turn >= 0, 1.0, -1.0)
                left, _, right = np.linalg.svd(signs.T @ projected)
                turn = (left @ right).T
            self.rotation.append(axes.T @ turn)
        self.bits = d * ROTATIONS
        self.radius = self._radius(x, k, recall)

    def encode(self, x: np.ndarray) -> np.ndarray:
        centred = unit(x) - self.mean
        return np.packbits(np.hstack([centred @ r >= 0 for r in self.rotation]), axis=1)

    def _radius(self, x: np.ndarray, k: int, recall: float) -> int:
        asked = x[:: max(1, len(x) // 200)]
        near = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, 1 : k + 1]
        codes = self.encode(x)
        far = ONES[self.encode(asked)[:, None, :] ^ codes[near]].sum(2) if near.size else np.zeros(1)
        return int(np.quantile(far, recall, method="higher"))


class Index:
    """The codes of one partition, listed by the value of each of their bytes."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, coder: Coder, k: int):
        order = np.lexsort((ids, *x.T[::-1]))
        ids, x = ids[order], x[order]
        new = np.append(True, (x[1:] != x[:-1]).any(1))
        begin = np.flatnonzero(new)
        self.x, self.size = x[begin], np.sqrt((x[begin] ** 2).sum(1))
        self.few = [ids[a : min(z, a + k + 1)] for a, z in zip(begin, np.append(begin[1:], len(ids)))]
        self.codes = coder.encode(self.x)
        self.by_byte = []
        for j in range(self.codes.shape[1]):
            rows = np.argsort(self.codes[:, j], kind="stable")
            self.by_byte.append((rows, np.searchsorted(self.codes[rows, j], np.arange(257))))

    def probed(self, code: np.ndarray, radius: int) -> np.ndarray:
        """The index rows that one of the probed bytes names: all within ``radius``, and others."""
        n = self.codes.shape[1]
        if radius >= 8 * n:
            return np.arange(len(self.codes))
        seen = np.zeros(len(self.codes), bool)
        for j, (rows, begin) in enumerate(self.by_byte):
            own = (radius + 1) // n + (j < (radius + 1) % n) - 1  # sums to more than the radius
            for distance in range(own + 1):
                for value in (BY_DISTANCE[distance] ^ code[j]).tolist():
                    seen[rows[begin[value] : begin[value + 1]]] = True
        return np.flatnonzero(seen)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every index row whose code is within ``radius`` of ``code``."""
        found = self.probed(code, radius)
        return found[ONES[self.codes[found] ^ code].sum(1) <= radius]

    def search(self, query: np.ndarray, code: np.ndarray, own: int, k: int, radius: int) -> list[tuple[float, int]]:
        """The k nearest rows as ``(score, id)``, nearest first, ties to the smaller id."""
        while True:
            rows = self.within(code, radius)
            if sum(len(self.few[r]) for r in rows[: k + 2]) > k or len(rows) == len(self.codes):
                break
            radius = max(radius + 4, radius * 5 // 4)
        score = (self.x[rows] * query).sum(1) / (self.size[rows] * np.sqrt((query * query).sum()))
        if len(rows) > k + 1:
            bound = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
            rows, score = rows[score >= bound], score[score >= bound]
        best = [(s, i) for s, r in zip(score.tolist(), rows.tolist()) for i in self.few[r].tolist() if i != own]
        return nearest_of(best, k)


def nearest_of(found: list[tuple[float, int]], k: int) -> list[tuple[float, int]]:
    """The k best ``(score, id)``, each id once."""
    best: dict[int, float] = {}
    for score, i in sorted(found, key=lambda b: (-b[0], b[1])):
        best.setdefault(i, score)
    return [(score, i) for i, score in list(best.items())[:k]]


def usable(rows: DataFrame) -> DataFrame:
    """Rows with an id and a finite vector that is not zero."""
    kind = rows.schema["embedding"].dataType.elementType.simpleString()
    vector = F.col("embedding").cast(f"array<{kind if kind == 'float' else 'double'}>").alias("embedding")
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector).where(
        F.col("vec_id").isNotNull()
        & F.exists("embedding", lambda v: v != 0)
        & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    )


FOUND = "query_id long, vec_id long, score double"


def search(rows: DataFrame, queries: DataFrame, shards: int, coder: Coder, k: int) -> DataFrame:
    """The k nearest rows of each query in each shard of ``rows``."""

    def build(held: pa.Table) -> Index:
        return Index(held.column("vec_id").to_numpy(), vectors(held), coder, k)

    def answer(index: Index, batch: pa.RecordBatch) -> pa.RecordBatch:
        x, ids = vectors(batch), batch.column("vec_id").to_pylist()
        found = [(q, i, s) for q, v, c in zip(ids, x, coder.encode(x)) for s, i in index.search(v, c, q, k, coder.radius)]
        return pa.RecordBatch.from_arrays(
            [pa.array([f[c] for f in found], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))],
            names=["query_id", "vec_id", "score"],
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return answered(batches, build, answer)

    dealt = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shards)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    index = rows.select(dealt.alias("shard"), F.lit(0).alias("kind"), "vec_id", "embedding")
    asked = queries.select(every.alias("shard"), F.lit(1).alias("kind"), "vec_id", "embedding")
    return index.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(run, FOUND)


def nearest(rows: DataFrame, every: int = 50, k: int = 5, recall: float = 0.95) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k nearest rows of each row whose id is divisible by ``every``."""
    rows = usable(rows)
    spark = rows.sparkSession
    found = spark.createDataFrame([], FOUND)
    for size, n in sorted(rows.groupBy(F.size("embedding")).count().collect()):
        own = rows.where(F.size("embedding") == size)
        sample = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
        coder = Coder(vectors(sample), k, recall)
        asked = own.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
        shards = shard_count(n, int(spark.conf.get("spark.sql.shuffle.partitions")), *SHARD_ROWS)
        found = found.unionByName(search(own, asked, shards, coder, k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
