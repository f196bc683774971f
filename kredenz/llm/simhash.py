"""SimHash near-duplicates: a binary trie of fingerprints joined with itself.

A fingerprint has a bit set if more than half of the XXH64 values of a text's word
shingles have it set. Distinct fingerprints form a binary trie; the join walks pairs
of nodes together from the root, adds up the bits in which they differ, and drops a
pair as soon as that exceeds ``budget``.

The first ``depth`` levels of the walk are a Spark join: one task group for each pair
of subtrees whose prefixes differ in at most ``budget`` bits. ``depth`` follows the number
of distinct fingerprints, so a subtree holds about ``SUBTREE`` of them at any scale; pairs of subtrees that
hold more, because fingerprints crowd under a prefix, are split by further bits.
Below, a subtree is a sorted array, a node is a range of it, and a level of node
pairs is expanded at once, in blocks of bounded size. A group returns the links of a
spanning forest, never all its pairs, so no link between groups is lost and a dense
cluster costs one row for each fingerprint. Components then join forests.

Documents with one fingerprint are collapsed first (smallest id, with partial
aggregates), so copies cost nothing, however many there are.

Null and empty texts and texts without words have fingerprint zero, which links like
any other. Texts are whole, of any length; other columns are not read, whatever their names. An empty table gives
no rows. Rows with equal ids are separate rows with equal results. Null ids come last:
they are the component's id only if it has no other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kredenz.llm.batches import slices
from kredenz.llm.components import components
from kredenz.runtime import pin

SUBTREE = 131_072
FRONTIER = 200_000  # node pairs expanded at a time
SEED = 42
CHUNK = 65_536


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of one text as an unsigned 64-bit number."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :][:n]
    set_bits = np.zeros(64, np.int64)
    for a in range(0, n, CHUNK):
        values = np.array(
            [xxh64_intdigest(joined[x:y], SEED) for x, y in zip(begins[a : a + CHUNK].tolist(), last[a : a + CHUNK].tolist())][: n - a],
            dtype="<u8",
        )
        set_bits += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, fp`` (signed 64-bit) of every whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values = np.array([fingerprint(x, shingle) for x in part.column("text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(values.view(np.int64))], names=["doc_id", "fp"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


class Forest:
    """Union of numbers 0 to n - 1; ``join`` tells which pairs joined two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def walk(values: np.ndarray, pairs: np.ndarray, bit: int, budget: int, found) -> None:
    """Walk node pairs ``(a, a_end, b, b_end, spent)`` of sorted ``values`` down from ``bit``.

    ``found(i, j)`` gets arrays of positions of leaves within the budget. Blocks of the
    frontier are walked to the end one after another, so memory stays bounded.
    """
    todo = [(pairs, bit)]
    while todo:
        nodes, bit = todo.pop()
        if not len(nodes):
            continue
        if len(nodes) > FRONTIER:
            todo += [(nodes[k : k + FRONTIER], bit) for k in range(0, len(nodes), FRONTIER)]
            continue
        single = (nodes[:, 1] - nodes[:, 0] == 1) & (nodes[:, 3] - nodes[:, 2] == 1)
        leaves = nodes[single]
        if len(leaves):
            far = np.bitwise_count(values[leaves[:, 0]] ^ values[leaves[:, 2]])
            near = (far <= budget) & (leaves[:, 0] < leaves[:, 2])
            found(leaves[near, 0], leaves[near, 2])
            nodes = nodes[~single]
        if not len(nodes) or bit < 0:
            continue
        mids = []
        for a, z in ((0, 1), (2, 3)):  # first value of each node with this bit set
            ones = (values[nodes[:, a]] >> np.uint64(bit) << np.uint64(bit)) | np.uint64((1 << bit))
            mids.append(np.clip(np.searchsorted(values, ones), nodes[:, a], nodes[:, z]))
        m, k = mids
        a, z, b, y, spent = nodes.T
        same = (a == b) & (z == y)
        children = [
            (a, m, b, k, spent, True),
            (m, z, k, y, spent, True),
            (a, m, k, y, spent + 1, True),
            (m, z, b, k, spent + 1, ~same),  # the mirror image of the one before
        ]
        level = []
        for p, q, r, s, cost, also in children:
            keep = (q > p) & (s > r) & (cost <= budget) & also
            level.append(np.column_stack([p[keep], q[keep], r[keep], s[keep], cost[keep]]))
        todo.append((np.concatenate(level), bit - 1))


def forest_links(values: np.ndarray, cross: tuple[int, int] | None, bit: int, budget: int, spent: int) -> list[tuple[int, int]]:
    """Forest of links among sorted distinct ``values``; ``cross`` are the sizes of two subtrees."""
    forest, out = Forest(len(values)), []

    def found(i: np.ndarray, j: np.ndarray) -> None:
        out.extend((x, y) for x, y in zip(i.tolist(), j.tolist()) if forest.join(x, y))

    n = len(values)
    start = [[0, cross[0], cross[0], n, spent]] if cross else [[0, n, 0, n, 0]]
    walk(values, np.array(start, np.int64), bit, budget, found)
    return out


STEP = 8  # further bits by which a crowded pair of subtrees is split
LINKS = "u long, v long"


def flips(bits: int, budget: int) -> list[int]:
    """All ways to change up to ``budget`` of ``bits`` bits."""
    return [sum(1 << b for b in c) for k in range(min(budget, bits) + 1) for c in combinations(range(bits), k)]


def tops(fp: np.ndarray, depth: int) -> np.ndarray:
    return (fp.view(np.uint64) >> np.uint64(64 - depth)).astype(np.int64) if depth else np.zeros(len(fp), np.int64)


def paired(rows: DataFrame, budget: int, depth: int, step: int) -> DataFrame:
    """``p, q, fp``: each value of each pair ``(p, q)`` of subtrees of ``depth`` bits, under its pairs ``step`` bits further down."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("p", "q", "fp"))
            away = p ^ q
            spent, top = np.bitwise_count(away), tops(fp, depth + step)
            for flip in flips(step, budget):
                within = spent + flip.bit_count() <= budget
                own, other = top[within], top[within] ^ (away[within] << step) ^ flip
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(own, other)), pa.array(np.maximum(own, other)), pa.array(fp[within])], names=["p", "q", "fp"]
                )

    return rows.mapInArrow(run, "p long, q long, fp long")


def joined(rows: DataFrame, budget: int, depth: int) -> DataFrame:
    """``u, v``: forests of links of each pair of subtrees."""

    def join(key: tuple, table: pa.Table) -> pa.Table:
        p, q = key[0].as_py(), key[1].as_py()
        values = np.sort(np.asarray(table.column("fp").combine_chunks(), np.int64).view(np.uint64))
        cross = None
        if p != q:
            own = int((tops(values, depth) == p).sum())
            cross = (own, len(values) - own)
        links = [] if cross and 0 in cross else forest_links(values, cross, 63 - depth, budget, (p ^ q).bit_count())
        signed = values.view(np.int64)
        return pa.table(
            {"u": pa.array(signed[[x for x, _ in links]], pa.int64()), "v": pa.array(signed[[y for _, y in links]], pa.int64())}
        )

    return rows.groupBy("p", "q").applyInArrow(join, LINKS)


def linked(distinct: DataFrame, budget: int, depth: int) -> DataFrame:
    """``u, v``: links of the self-join of ``distinct(fp)`` over pairs of subtrees.

    The walk begins with the pairs ``depth`` bits down. Pairs that hold more than twice ``SUBTREE`` values, because
    values crowd under few prefixes, go on ``STEP`` bits further down, until none does.
    """
    rows = paired(distinct.select(F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q"), "fp"), budget, 0, depth)
    if not depth:
        return joined(rows, budget, 0)
    found = None
    while True:
        rows = pin(rows)
        crowded = pin(rows.groupBy("p", "q").count().where(F.col("count") > 2 * SUBTREE)) if depth < 64 else None
        if crowded is None or crowded.isEmpty():
            more = joined(rows, budget, depth)
            return more if found is None else found.unionByName(more)
        more = joined(rows.join(crowded, ["p", "q"], "left_anti"), budget, depth)
        found = more if found is None else found.unionByName(more)
        step = min(STEP, 64 - depth)
        rows = paired(rows.join(crowded, ["p", "q"], "left_semi"), budget, depth, step)
        depth += step


def trie_depth(count: int) -> int:
    """Levels that are walked as a join, so that a subtree of ``count`` values holds about ``SUBTREE`` of them."""
    return max(0, (-(-count // SUBTREE) - 1).bit_length())


def near_duplicates(docs: DataFrame, budget: int = 2, shingle: int = 3) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``."""
    prints = pin(fingerprints(docs, shingle))
    distinct = pin(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = components(linked(distinct.select("fp"), budget, trie_depth(distinct.count())))
    named = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("label", "fp").alias("label")
    )
    named = pin(named)
    smallest = pin(named.groupBy("label").agg(F.min("least").alias("component_id")))
    ids = pin(named.select("fp", "label").join(smallest, "label").select("fp", "component_id"))
    return prints.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
