"""Hard negatives by an inverted multi-index.

A vector is cut into two halves, each with a codebook of its own (k-means on ``SAMPLE`` vectors); a
pair of codes is a cell. The inner product of an anchor with any row of a cell is at most the
sum of two half-scores, ``q_h . centre + |q_h| * radius``, the radius being the distance of the code's
farthest row. Cells are visited by that sum, highest first, through a heap over the two
sorted lists of half-scores (the multi-sequence), and a search ends when no cell left can hold a better
row: the bound of the next cell is below the last row kept of every window. So results are
those of a scan of all rows; only the order and the number of visits follow the index.

Rows are dealt into shards of neighbouring cells, the cells of more rows than a shard into several.
An anchor first asks the shard with its best cell; what it finds there is the mark below which
no other shard is asked. Windows of negatives ask only the shards whose bounds meet them. Rows and
questions meet in one shuffle by shard, sorted so that a task holds one shard and one batch of
questions. The driver holds the codebooks and a count for each cell (``CODES ** 2`` at most).

Copies: rows of one label and vector are one index row with their smallest ids, as many as
an answer can hold, so a vector that a third of the table shares weighs no more than any other.

Rows with a null id, label or vector, or with a null or non-finite component, take no part. Exact repeats
of a row count once; rows that share an id but differ are rows each, and an anchor with
several is asked with the least of them. A row is never its own positive or negative. Vectors of
different lengths do not meet. Ties go to the smaller id. Scores beyond a long are held at its
ends. An empty table, or one without anchors or without a second label, gives no rows. Other
columns are left out, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from kredenz.llm.batches import answered, shard_count
from kredenz.llm.whitening import LONG_MOST
from kredenz.runtime import pin

SAMPLE = 8_000
CODES = 64  # most codes of a half
CELL_ROWS = 48  # rows a cell should hold on average, while codes are fewer than CODES
SHARD_ROWS = 2_048, 65_536  # least and most rows of a shard
CHUNK = 256  # rows scored at a time
ROUNDS = 12


def matrix(batch: pa.RecordBatch | pa.Table, d: int) -> np.ndarray:
    lists = batch.column("x")
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), d)


def centres(sample: np.ndarray, codes: int) -> np.ndarray:
    """k-means with a fixed start: the first distinct sample vectors."""
    _, first = np.unique(sample, axis=0, return_index=True)
    found = sample[np.sort(first)[:codes]].copy()
    for _ in range(ROUNDS):
        code, _ = assign(sample, found)
        for k in range(len(found)):
            own = sample[code == k]
            if len(own):
                found[k] = own.mean(0)
    return found


def assign(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and the distance to it."""
    code = np.argmin((book * book).sum(1) - 2 * x @ book.T, axis=1)
    return code, np.sqrt(((x - book[code]) ** 2).sum(1))


def half_scores(q: np.ndarray, book: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the half-scores of ``q`` (rows) with the rows of each code, rounding included."""
    size = np.sqrt((q * q).sum(1))[:, None]
    middle, reach = q @ book.T, size * radii
    slack = 1e-9 * (size * (np.sqrt((book * book).sum(1)) + radii)) + 1e-6
    return middle - reach - slack, middle + reach + slack


@dataclass
class Layout:
    """Codebooks, radii and the shards that hold each cell's rows."""

    d: int
    books: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    first: np.ndarray  # by cell: its first shard, -1 without rows
    parts: np.ndarray  # by cell: how many shards share it
    shards: int

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.d // 2], x[:, self.d // 2 :]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell of each row and its distances to both centres."""
        (a, far_a), (b, far_b) = (assign(h, book) for h, book in zip(self.halves(x), self.books))
        return a * len(self.books[1]) + b, far_a, far_b

    def shard_bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score that each anchor (row) can have in each shard."""
        (low_a, up_a), (low_b, up_b) = (
            half_scores(h, book, r) for h, book, r in zip(self.halves(x), self.books, self.radii)
        )
        lows, ups = np.full((self.shards, len(x)), np.inf), np.full((self.shards, len(x)), -np.inf)
        for cell in np.flatnonzero(self.first >= 0).tolist():
            a, b = divmod(cell, len(self.books[1]))
            shards = slice(self.first[cell], self.first[cell] + self.parts[cell])
            lows[shards] = np.minimum(lows[shards], low_a[:, a] + low_b[:, b])
            ups[shards] = np.maximum(ups[shards], up_a[:, a] + up_b[:, b])
        return lows.T, ups.T


def lay_out(rows: DataFrame, d: int) -> Layout:
    """Codebooks from a sample, radii and counts from all rows."""
    spark = rows.sparkSession
    n = rows.count()
    sample = matrix(rows.orderBy(F.xxhash64("x", "label")).limit(SAMPLE).select("x").toArrow(), d)
    codes = max(1, min(CODES, int((n / CELL_ROWS) ** 0.5)))
    books = tuple(centres(h, codes) for h in (sample[:, : d // 2], sample[:, d // 2 :]))
    width = len(books[1])
    cells = len(books[0]) * width
    layout = Layout(d, books, (np.zeros(len(books[0])), np.zeros(width)), np.full(cells, -1), np.zeros(cells, int), 0)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far_a, far_b = layout.cells(matrix(batch, d))
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(far_a), pa.array(far_b)], names=["cell", "far_a", "far_b"])

    counted = rows.select("x").mapInArrow(run, "cell long, far_a double, far_b double").groupBy("cell")
    counted = counted.agg(F.count("*").alias("rows"), F.max("far_a"), F.max("far_b")).orderBy("cell").collect()
    for cell, _, far_a, far_b in counted:
        for radii, code, far in zip(layout.radii, divmod(cell, width), (far_a, far_b)):
            radii[code] = max(radii[code], far)
    most = -(-n // shard_count(n, int(spark.conf.get("spark.sql.shuffle.partitions")), *SHARD_ROWS))
    shard, held = 0, 0
    for cell, count, _, _ in counted:
        if held and held + count > most:
            shard, held = shard + 1, 0
        layout.first[cell], layout.parts[cell] = shard, max(1, -(-count // most))
        held += count
        if layout.parts[cell] > 1:
            shard, held = shard + layout.parts[cell], 0
    layout.shards = shard + (held > 0)
    return layout


#: Index rows (``kind`` 0) and questions (1), as they meet. Of a question, ``ids`` and ``scores`` are the anchor's positives.
MET = "shard int, kind int, cell int, key long, label long, x {kind}, ids array<long>, scores array<long>, mark long"


def met_schema(rows: DataFrame) -> str:
    return MET.format(kind=rows.schema["x"].dataType.simpleString())


def indexed(rows: DataFrame, layout: Layout) -> DataFrame:
    """Index rows with the shard they belong to."""
    schema = met_schema(rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            cell, _, _ = layout.cells(matrix(batch, layout.d))
            part = batch.column("part").to_numpy() % np.maximum(layout.parts[cell], 1)
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(layout.first[cell] + part, pa.int32()), pa.array(np.zeros(n, np.int32)), pa.array(cell, pa.int32()),
                    none, batch.column("label"), batch.column("x"), batch.column("ids"), pa.nulls(n, pa.list_(pa.int64())), none,
                ],
                names=[f.split()[0] for f in schema.split(", ")],
            )

    part = F.pmod(F.xxhash64("x", "label"), F.lit(1 << 30)).alias("part")
    return rows.select("label", "x", "ids", part).mapInArrow(run, schema)


def least_and_most(score: int, low: int, high: int) -> tuple[int, int]:
    """The whole scores s with ``low * score <= 100 * s <= high * score``."""
    return -(-low * score // 100), high * score // 100


def asked(anchors: DataFrame, layout: Layout, which: str, low: int = 0, high: int = 0) -> DataFrame:
    """Questions, one row for each shard that an anchor must ask.

    ``which`` is ``home`` (the shard of the best bound), ``others`` (all others that may reach the anchor's
    ``mark``) or ``windows`` (those whose scores may lie in a window of one of its positives).
    """
    schema = met_schema(anchors)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 1_000):
                batch = whole.slice(begin, 1_000)
                lows, ups = layout.shard_bounds(matrix(batch, layout.d))
                home = ups.argmax(1) if layout.shards else np.zeros(0, int)
                at_home = np.arange(layout.shards) == home[:, None]
                if which == "home":
                    send = at_home
                elif which == "others":
                    marks = batch.column("mark").cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                    send = ~at_home & (ups >= marks[:, None])
                else:
                    send = np.zeros(lows.shape, bool)
                    for k, scores in enumerate(batch.column("scores").to_pylist()):
                        for s in scores or []:
                            least, most = least_and_most(s, low, high)
                            if least <= most:
                                send[k] |= (ups[k] >= least) & (lows[k] <= most)
                row, shard = np.nonzero(send)
                take = batch.take(pa.array(row))
                columns = [take.column(c) for c in ("key", "label", "x", "ids", "scores", "mark")]
                n = len(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard, pa.int32()), pa.array(np.ones(n, np.int32)), pa.nulls(n, pa.int32()), *columns],
                    names=[f.split()[0] for f in schema.split(", ")],
                )

    return anchors.mapInArrow(run, schema)


class Index:
    """The rows of one shard by cell."""

    def __init__(self, held: pa.Table, layout: Layout):
        cell = held.column("cell").to_numpy()
        order = np.argsort(cell, kind="stable")
        held, cell = held.take(pa.array(order)), cell[order]
        self.layout, self.x = layout, matrix(held, layout.d)
        self.label = held.column("label").to_numpy()
        self.ids = held.column("ids").to_pylist()
        self.largest = float(np.abs(self.x).max(initial=0))
        begin = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        a, b = np.divmod(cell[begin], len(layout.books[1]))
        self.codes = np.unique(a), np.unique(b)
        at = zip(np.searchsorted(self.codes[0], a).tolist(), np.searchsorted(self.codes[1], b).tolist())
        self.rows = dict(zip(at, zip(begin.tolist(), [*begin[1:].tolist(), len(cell)])))
        self.radii = []
        for h, codes, book, code in zip(layout.halves(self.x), self.codes, layout.books, np.divmod(cell, len(layout.books[1]))):
            far, radii = np.sqrt(((h - book[code]) ** 2).sum(1)), np.zeros(len(codes))
            np.maximum.at(radii, np.searchsorted(codes, code), far)
            self.radii.append(radii)

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact inner products."""
        if self.largest * float(np.abs(q).max(initial=0)) * self.layout.d < 2.0**53:
            return (self.x[rows] @ q).astype(np.int64)
        own = [int(v) for v in q.tolist()]
        found = [sum(int(a) * b for a, b in zip(x, own)) for x in self.x[rows].tolist()]
        return np.array([min(max(s, -LONG_MOST - 1), LONG_MOST) for s in found], np.int64)

    def visits(self, ups: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[float, tuple[int, int] | None]]:
        """``(bound, rows)`` of the cells, highest bound first."""
        order = [np.argsort(-u, kind="stable") for u in ups]
        u, v = (up[o].tolist() for up, o in zip(ups, order))
        i_at, j_at = (o.tolist() for o in order)
        heap = [(-(u[0] + v[0]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            if j + 1 < len(v):
                heapq.heappush(heap, (-(u[i] + v[j + 1]), i, j + 1))
            if not j and i + 1 < len(u):
                heapq.heappush(heap, (-(u[i + 1] + v[0]), i + 1, 0))
            yield -bound, self.rows.get((i_at[i], j_at[j]))

    def search(self, q: np.ndarray, ups: tuple[np.ndarray, np.ndarray], own: int, label: int, same: bool, windows: list["Best"]) -> None:
        """Fill ``windows`` with rows of the same label or of others."""
        spans: list[tuple[int, int]] = []
        n = 0

        def score() -> None:
            rows = np.concatenate([np.arange(a, b) for a, b in spans])
            rows = rows[(self.label[rows] == label) == same]
            found = self.scores(rows, q)
            for w in windows:
                w.take(found, rows, self.ids, own)

        for bound, at in self.visits(ups):
            if not any(w.open(bound) for w in windows):
                break
            if at:
                spans.append(at)
                n += at[1] - at[0]
            if n >= CHUNK:
                score()
                spans, n = [], 0
        if spans:
            score()


class Best:
    """The best ``k`` of the rows that score between ``least`` and ``most``."""

    def __init__(self, k: int, least: float, most: float):
        self.k, self.least, self.most = k, least, most
        self.found: list[tuple[int, int]] = []  # (-score, id), best first

    def open(self, bound: float) -> bool:
        """Whether a row of at most this score could still come in."""
        if self.least > self.most or bound < self.least:
            return False
        return len(self.found) < self.k or bound >= -self.found[-1][0]

    def take(self, scores: np.ndarray, rows: np.ndarray, ids: list[list[int]], own: int) -> None:
        least = max(self.least, -self.found[-1][0]) if len(self.found) == self.k else self.least
        fit = np.flatnonzero((scores >= least) & (scores <= self.most))
        if len(fit) > self.k + 1:  # an anchor's own row may be among them
            bound = np.partition(scores[fit], len(fit) - self.k - 1)[len(fit) - self.k - 1]
            fit = fit[scores[fit] >= bound]
        new = [(-s, i) for s, r in zip(scores[fit].tolist(), rows[fit].tolist()) for i in ids[r] if i != own]
        self.found = sorted({*self.found, *new})[: self.k]


FOUND = "key long, positive long, positive_score long, id long, score long"


def search(index: DataFrame, questions: DataFrame, layout: Layout, k: int, windows: tuple[int, int] | None = None) -> DataFrame:
    """The k best rows of each question in each shard asked: of the same label, or of other labels for each positive's window."""

    def answer(at: Index, batch: pa.RecordBatch) -> pa.RecordBatch:
        x = matrix(batch, layout.d)
        ups = [
            half_scores(h, book[codes], radii)[1]
            for h, book, codes, radii in zip(layout.halves(x), layout.books, at.codes, at.radii)
        ]
        out: list[tuple] = []
        asked_of = zip(*(batch.column(c).to_pylist() for c in ("key", "label", "ids", "scores", "mark")))
        for n, (key, label, ids, scores, mark) in enumerate(asked_of):
            if windows is None:
                wanted = [(None, None, Best(k, -np.inf if mark is None else mark, np.inf))]
            else:
                wanted = [(i, s, Best(k, *least_and_most(s, *windows))) for i, s in zip(ids, scores)]
            at.search(x[n], (ups[0][n], ups[1][n]), key, label, windows is None, [w for _, _, w in wanted])
            out += [(key, i, s, found, -score) for i, s, w in wanted for score, found in w.found]
        names = [f.split()[0] for f in FOUND.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(5)], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return answered(batches, lambda held: Index(held, layout), answer)

    return index.unionByName(questions).repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(run, FOUND)


def best(found: DataFrame, k: int, *keys: str) -> DataFrame:
    """The k best of each key, with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.distinct().select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)


OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(
    rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """Negatives of each row whose id is divisible by ``every``, for each of its nearest rows of the same label.

    ``rows`` holds ``vec_id``, ``label`` and ``x``, whole numbers kept as float or double. A negative has another label
    and between ``low`` and ``high`` percent of the positive's score.
    """
    ids = F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label")
    rows = rows.select(*ids, "x").where("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").distinct()
    few = max(positives, negatives) + 1
    order = Window.partitionBy("label", "x").orderBy("vec_id")
    first = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= few)
    groups = pin(first.groupBy("label", "x").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    asking = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("_row"))
    asking = pin(asking.select(F.col("vec_id").alias("key"), "_row.label", "_row.x"))
    out = rows.sparkSession.createDataFrame([], OUT)
    for (d,) in sorted(asking.select(F.size("x")).distinct().collect()):
        own, anchors = groups.where(F.size("x") == d), asking.where(F.size("x") == d)
        layout = lay_out(own, d)
        index = indexed(own, layout)
        nothing = F.lit(None).cast("array<long>")
        plain = anchors.select("*", nothing.alias("ids"), nothing.alias("scores"))
        near = search(index, asked(plain.withColumn("mark", F.lit(None).cast("long")), layout, "home"), layout, positives)
        near = pin(near)
        marks = best(near, positives, "key").where(F.col("rank") == positives).select("key", F.col("score").alias("mark"))
        further = search(index, asked(plain.join(marks, "key", "left"), layout, "others"), layout, positives)
        pairs = best(near.unionByName(further), positives, "key").groupBy("key").agg(
            F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("_p")
        )
        wide = anchors.join(pairs, "key").select(
            "key", "label", "x", F.col("_p.id").alias("ids"), F.col("_p.score").alias("scores"), F.lit(None).cast("long").alias("mark")
        )
        wide = pin(wide)
        hard = search(index, asked(wide, layout, "windows", low, high), layout, negatives, (low, high))
        hard = best(hard, negatives, "key", "positive", "positive_score")
        out = out.unionByName(
            hard.select(
                F.col("key").alias("anchor_id"),
                F.col("positive").alias("positive_id"),
                "rank",
                F.col("id").alias("negative_id"),
                "positive_score",
                F.col("score").alias("negative_score"),
            )
        )
    return out
