"""Near copies: documents whose word shingles have a Jaccard similarity of ``similarity`` at least.

Texts are sets of hashed shingles (lower case ASCII, split at ASCII white space; a text under
``shingle`` words is one shingle). Equal sets are one node, named by a hash of the set.

* A node has a 64-bit fingerprint: a bit is set if over half of its shingle hashes have it set. The binary trie of all fingerprints is joined
  with itself under ``BITS`` bits, as operator 7 does it.
* At similarity 0.8 fingerprints differ in 10 to 12 bits, more than one trie over everything can be walked with. So the trie is divided:
  ``BANDS`` keys of ``ROWS`` least hashes each tell who shares a bucket (a pair at similarity 0.8 shares one with probability 0.9999), and each
  bucket's own trie is joined with itself under ``NEAR`` bits. Buckets of the same nodes are one. The join returns spanning forests, not pairs.
* The shingles of nodes with company are put in one order, rarest first, by counts over all of them. A bucket of more than ``CROWD``
  nodes isn't walked with ``NEAR`` bits: its middle is its node with the fewest shingles of its own, and every node of the bucket meets the middle.
* Nodes that this leaves in different components meet on a prefix of their ordered shingles. Two sets of
  similarity s share one of the first ``n - ceil(s * n) + 1``, and from the places of the first one they share
  follows how much they can share at all; a pair that can't reach s is never made. Shingles of a common line come
  last in the order, so texts that have nothing else in common don't meet, and a large group
  of near copies costs one pair for each node and bucket, not all its pairs.
* Every link is verified by the exact similarity of the two sets. Pairs carry hashes, and texts stay where they
  are: rows are picked by one bit each, broadcast up to ``MASKS`` words of them and joined beyond.

Rows are told apart by a number of their own, so null and repeated ids are rows like any
other. All texts without words are one group. Texts are whole, of any length.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, Window
from pyspark.sql.types import ArrayType, LongType
from xxhash import xxh64_intdigest

from kredenz.llm.batches import slices, texts, word_table
from kredenz.llm.components import components
from kredenz.llm.shards import scramble
from kredenz.llm.simhash import CHUNK, joined, linked, trie_depth
from kredenz.runtime import pin, scratch_path

BANDS, ROWS = 24, 5
BITS = 2  # by which fingerprints may differ anywhere
NEAR = 20  # by which they may within a bucket
CROWD = 512  # nodes of a bucket whose trie is walked with so many bits
MASKS = 1 << 18  # words of 64 rows that are broadcast; 16 bytes each
FACTORS = scramble(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(array: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """``values, offsets``: sorted distinct shingle hashes of each text."""
    words = word_table(pc.ascii_lower(array))
    hashes = np.array([xxh64_intdigest(w.encode()) for w in words.distinct.to_pylist()], np.uint64)
    text = hashes[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    begins, counts = words.offsets[:-1], words.counts
    n = np.where(counts > 0, np.maximum(1, counts - shingle + 1), 0)
    owner = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + begins[owner]
    value = np.zeros(len(owner), np.uint64)
    for k in range(shingle):
        inside = at + k < words.offsets[1:][owner]
        value[inside] = scramble(value[inside] + text[at[inside] + k])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(n) + 1))


def sketches(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``node, buckets`` of each set; an empty set has node 0 and zeros for buckets."""
    full = np.flatnonzero(np.diff(offsets))
    node = np.zeros(len(offsets) - 1, np.uint64)
    buckets = np.zeros((len(offsets) - 1, BANDS), np.uint64)
    if not len(full):
        return node, buckets
    begins = offsets[full]
    node[full] = [xxh64_intdigest(values[offsets[k] : offsets[k + 1]].tobytes()) or 1 for k in full.tolist()]
    for band in range(BANDS):
        key = np.full(len(full), band, np.uint64)
        for factor in FACTORS[band * ROWS : (band + 1) * ROWS]:
            key = scramble(key + np.minimum.reduceat(values * factor, begins))
        buckets[full, band] = key
    return node, buckets


def prints(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """SimHash of each set: a bit is set if over half of its hashes have it set."""
    sums = np.zeros((len(offsets) - 1, 64), np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for a in range(0, len(values), CHUNK):
        own = owner[a : a + CHUNK]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        bits = np.unpackbits(values[a : a + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits(2 * sums > np.diff(offsets)[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def sketched(docs: DataFrame, columns: tuple[str, ...], shingle: int) -> DataFrame:
    """``docs`` with ``_row``, ``_node``, ``_print`` and ``_buckets``, written out so that row numbers stay."""
    schema = docs.select(*columns).schema
    numbered = docs.select(*columns, F.monotonically_increasing_id().alias("_row"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values, offsets = shingle_sets(texts(part), shingle)
                node, buckets = sketches(values, offsets)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(node) + 1) * BANDS, pa.int32()), pa.array(buckets.ravel().view(np.int64))
                )
                own = [pa.array(x.view(np.int64)) for x in (node, prints(values, offsets))]
                yield pa.RecordBatch.from_arrays([*part.columns, *own, lists], names=[*part.schema.names, "_node", "_print", "_buckets"])

    out = schema.add("_row", "long", False).add("_node", "long").add("_print", "long").add("_buckets", ArrayType(LongType()))
    path = scratch_path(docs.sparkSession, "near-copies")
    numbered.mapInArrow(run, out).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def trie_links(fps: DataFrame, members: DataFrame, sizes: DataFrame) -> DataFrame:
    """``u, v``: nodes whose fingerprints meet in the trie of all, or in that of a bucket; each is a link of a spanning forest.

    ``fps`` has ``node, fp``; nodes of one fingerprint are linked to the least of them.
    """
    distinct = pin(fps.groupBy("fp").agg(F.min("node").alias("least")))
    near = linked(distinct.select("fp"), BITS, trie_depth(distinct.count()))
    small = sizes.where(F.col("n") <= CROWD).groupBy("n", "least", "most", "mixed").agg(F.min("bucket").alias("bucket"))
    own = members.join(small.select("bucket"), "bucket").join(fps, "node")
    own = own.select(F.col("bucket").alias("p"), F.col("bucket").alias("q"), "fp").distinct()
    near = pin(near.unionByName(joined(own, NEAR, 0)).distinct())
    for end in ("u", "v"):
        near = near.join(distinct.withColumnsRenamed({"fp": end, "least": f"{end}_node"}), end)
    same = fps.join(distinct, "fp").where("node <> least")
    return near.select(F.col("u_node").alias("u"), F.col("v_node").alias("v")).unionByName(
        same.select(F.col("least").alias("u"), F.col("node").alias("v"))
    )


def chosen(rows: DataFrame, picked: DataFrame) -> DataFrame:
    """The rows whose ``_row`` is in ``picked``, one bit for each; texts are shuffled only if there are more than ``MASKS`` words of bits."""
    bits = F.expr("shiftleft(1L, cast(_row & 63 AS INT))")
    masks = pin(picked.groupBy(F.shiftright("_row", 6).alias("_word")).agg(F.bit_or(bits).alias("_bits")))
    masks = F.broadcast(masks) if masks.count() <= MASKS else masks
    marked = rows.withColumn("_word", F.shiftright("_row", 6)).join(masks, "_word")
    return marked.where("shiftrightunsigned(_bits, cast(_row & 63 AS INT)) & 1 = 1").select(*rows.columns)


def shingled(rows: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """``node, values``: the set of each of ``nodes``, from one of its texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values, offsets = shingle_sets(texts(part), shingle)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("node"), lists], names=["node", "values"])

    one = rows.groupBy(F.col("_node").alias("node")).agg(F.min("_row").alias("_row")).join(nodes, "node", "left_semi")
    bodies = chosen(rows, one).select(F.col("_node").alias("node"), "text")
    return pin(bodies.mapInArrow(run, "node long, values array<long>"))


def prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """``node, size, own, value, at``: shingles that other nodes have too among the first of each node's order, with their place.

    ``own`` is how many shingles no other node has; they come first. A node that is not here can't reach ``similarity`` with any.
    """
    each = sets.select("node", F.size("values").alias("size"), F.explode("values").alias("value"))
    shared = each.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    node = Window.partitionBy("node")
    place = F.row_number().over(node.orderBy("df", "value")) - 1
    placed = each.join(shared, "value").withColumn("own", F.col("size") - F.count("*").over(node)).withColumn("at", place + F.col("own"))
    length = F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1
    return pin(placed.where(F.col("at") < length).select("node", "size", "own", "value", "at"))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs(u, v)`` whose sets are similar enough."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, xs), (y, ys) = ((np.asarray(c.flatten()), np.asarray(c.offsets) - c.offsets[0].as_py()) for c in map(batch.column, "ab"))
            keep = []
            for k in range(batch.num_rows):
                one, two = x[xs[k] : xs[k + 1]], y[ys[k] : ys[k + 1]]
                both = len(np.intersect1d(one, two, assume_unique=True))
                if both >= similarity * (len(one) + len(two) - both) - 1e-9:
                    keep.append(k)
            yield batch.select(["u", "v"]).take(pa.array(keep, pa.int64()))

    size = F.size("values").alias
    with_u = pairs.join(sets.select(F.col("node").alias("u"), size("n")), "u")
    with_v = with_u.join(sets.select(F.col("node").alias("v"), F.col("values").alias("b")), "v")
    near = with_v.where(F.least("n", F.size("b")) >= similarity * F.greatest("n", F.size("b")) - 1e-9)
    full = near.drop("n").join(sets.select(F.col("node").alias("u"), F.col("values").alias("a")), "u")
    return pin(full.select("u", "v", "a", "b").mapInArrow(run, "u long, v long"))


def met(order: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """``u, v``: nodes of different components that share a shingle of their prefixes and may reach ``similarity``."""
    place = order.join(labels, "node", "left")
    place = pin(place.select("value", "at", "node", "size", F.coalesce("label", "node").alias("label")))
    counts = place.groupBy("value", "label").agg(F.count("*").alias("n"))
    top = counts.groupBy("value").agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1")
    open_ = pin(place.join(top.select("value", F.col("top.label").alias("top")), "value"))
    x = open_.where("label <> top").select("value", *[F.col(c).alias(f"x_{c}") for c in ("at", "node", "size", "label")])
    y = open_.drop("top")
    most = F.least(F.col("x_size") - F.col("x_at"), F.col("size") - F.col("at"))
    may = most * (1 + similarity) >= similarity * (F.col("x_size") + F.col("size")) - 1e-6
    pairs = x.join(y, (x.value == y.value) & (F.col("x_label") != F.col("label")) & may)
    return pairs.select(F.least("x_node", "node").alias("u"), F.greatest("x_node", "node").alias("v")).distinct()


def first_of_near_copies(docs: DataFrame, columns: tuple[str, ...], similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """One row of each group of near copies: the smallest id (null last), then by a hash of the row."""
    rows = sketched(docs, columns, shingle)
    nodes = rows.where("_node <> 0").select(F.col("_node").alias("node"), F.col("_print").alias("fp"), "_buckets").dropDuplicates(["node"])
    members = pin(nodes.select("node", F.explode("_buckets").alias("bucket")))
    sizes = members.groupBy("bucket").agg(
        F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("mixed")
    )
    sizes = pin(sizes.where("least < most"))
    members = pin(members.join(sizes.select("bucket"), "bucket"))
    near = pin(trie_links(pin(nodes.select("node", "fp")), members, sizes))
    company = [x.select(F.col(c).alias("node")) for x, c in ((members, "node"), (near, "u"), (near, "v"))]
    sets = shingled(rows, reduce(DataFrame.unionByName, company).distinct(), shingle)
    order = prefixes(sets, similarity)
    able = order.groupBy("node").agg(F.min("own").alias("own"))
    central = pin(members.join(sizes.where(F.col("n") > CROWD).select("bucket"), "bucket").join(able, "node"))
    middle = central.groupBy("bucket").agg(F.min(F.struct("own", "node")).alias("middle"))
    stars = central.join(middle, "bucket").select(F.col("middle.node").alias("u"), F.col("node").alias("v")).where("u <> v")
    pairs = near.unionByName(stars).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    links = verified(pin(pairs.distinct()), sets, similarity)
    links = links.unionByName(verified(pin(met(order, components(links), similarity)), sets, similarity))

    groups = components(links).withColumnRenamed("node", "_node")
    order = F.struct(
        F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.xxhash64(*columns).alias("hash"), F.col("_row").alias("row")
    )
    named = rows.select("_node", order.alias("o")).groupBy("_node").agg(F.min("o").alias("o"))
    named = named.join(groups, "_node", "left").select(F.coalesce("label", "_node").alias("label"), "o")
    kept = pin(named.groupBy("label").agg(F.min("o").alias("o")).select(F.col("o.row").alias("_row")))
    return chosen(rows, kept).select(*columns)
