"""Removal of word passages that repeat an earlier document, by fixed-block anchors.

A window is ``window`` consecutive words. A word is removed if a window over it
also starts in a document with a smaller id. Every document is cut into
non-overlapping blocks of ``block`` words; with ``window >= 2 * block - 1`` each
window holds a whole block. So two equal windows always show an anchor: a block of
one document that equals a rolling ``block``-word window of the other.

1. Rolling windows of all documents probe the block index, bucket by bucket.
   A window that equals an indexed block and stands in two documents is a hit.
2. Hits are extended: every full window around a hit is compared over all
   documents by 96 bits of a 128-bit value of its words (32 in the first step, 64 more) and its bucket, keeping the smallest id that has it.
   Adjoining repeated windows together are the maximal exact repeats.
3. Words under a window with a smaller id elsewhere are removed.

Documents are dealt to groups of ``GROUP_BYTES`` of text, and each group sends a
window once, however many of its documents have it, so a passage found in a third
of all documents is one entry for each group. Groups get back one bit for each
window sent. Windows travel in steps 1 as 32 bits beside the bucket (a chance
match only costs a comparison in step 2). Group and bucket counts follow the size
of the text, so both stay of one size at any scale. Texts are shuffled once: all
three steps read the same exchange.

Null and empty texts have no words; their hash is that of an empty text. Rows
with equal ids are one document for each other: none removes the other's words.
Null ids come before all others, equal among themselves. Texts are whole, of any length, hashed in pieces
of bounded size. Of other columns only those named in ``keep`` are read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_128_intdigest

from kredenz.llm.batches import give_back, texts
from kredenz.llm.shards import scramble

GROUP_BYTES = 4_000_000
LONG_WORD = 48  # bytes; longer words get a library hash
PIECE = 1 << 17  # bytes of text whose running sums are held at a time
BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)  # odd, both of order 2**62
LOWEST = -(2**63)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def powers(base: int) -> np.ndarray:
    out = np.full(PIECE + LONG_WORD, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_values(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Two values of each word ``raw[begin:end]``: sums of its bytes times powers of a base.

    Short words are done in pieces of ``PIECE`` bytes, from running sums over a piece.
    """
    out = [np.empty(len(begin), np.uint64) for _ in BASES]
    short = np.flatnonzero(end - begin <= LONG_WORD)
    edges = [0, *(np.flatnonzero(np.diff(begin[short] // PIECE)) + 1).tolist(), len(short)]
    tables = [(powers(b), powers(pow(b, -1, 2**64))) for b in BASES] if len(short) else []
    for i, j in zip(edges, edges[1:]):
        own = short[i:j]
        if not len(own):
            continue
        first, n = begin[own[0]], end[own[-1]] - begin[own[0]]
        wide = raw[first : first + n].astype(np.uint64) + np.uint64(1)
        a, z = begin[own] - first, end[own] - first
        running = np.zeros(n + 1, np.uint64)
        for values, base, (up, down) in zip(out, BASES, tables):
            np.cumsum(wide * up[:n], out=running[1:])
            values[own] = scramble((running[z] - running[a]) * down[a] + (z - a).astype(np.uint64) * np.uint64(base))
    for k in np.flatnonzero(end - begin > LONG_WORD).tolist():
        whole = xxh3_128_intdigest(raw[begin[k] : end[k]].tobytes())
        out[0][k], out[1][k] = whole >> 64, whole & (2**64 - 1)
    return out


class Text:
    """Words of many texts as 64-bit symbols, one pair of arrays for all."""

    def __init__(self, array: pa.Array, ids: np.ndarray):
        array = pa.concat_arrays([array])  # offsets from 0
        bounds = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
        buffer = array.buffers()[2]
        raw = np.frombuffer(buffer, np.uint8)[bounds[0] : bounds[-1]] if buffer else np.zeros(0, np.uint8)
        bounds = bounds - bounds[0]
        inside = np.zeros(len(raw) + 2, bool)
        inside[1:-1] = ~SPACE[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[bounds] = True
        self.begin = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
        self.end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
        self.first = np.searchsorted(self.begin, bounds)  # first word of each text
        self.owner = np.repeat(np.arange(len(array)), np.diff(self.first))
        self.ids = ids
        self.id = ids[self.owner]
        self.left = self.first[1:][self.owner] - np.arange(len(self.owner))  # words up to the text's end
        self.symbols = word_values(raw, self.begin, self.end)

    def windows(self, length: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which ``length`` words of one text stand, and the window's value."""
        at = np.flatnonzero(self.left >= length)
        symbols, factors = self.symbols[which], scramble(np.arange(length, dtype=np.uint64)) | np.uint64(1)
        value = np.zeros(len(at), np.uint64)
        for k in range(length):
            value += symbols[at + k] * factors[k]
        return at, scramble(value)


class Sent:
    """Distinct windows of a group in the order in which they are sent, by bucket."""

    def __init__(self, values: tuple[np.ndarray, ...], ids: np.ndarray, buckets: int):
        order = np.lexsort(values[::-1]) if len(values) > 1 else np.argsort(values[0], kind="stable")
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = np.any([v[order][1:] != v[order][:-1] for v in values], axis=0)
        self.start = np.flatnonzero(new)
        self.order, self.entry = order, np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1  # entry of each window
        self.values = [v[order][self.start] for v in values]
        self.least = np.minimum.reduceat(ids[order], self.start) if len(order) else ids[:0]
        self.most = np.maximum.reduceat(ids[order], self.start) if len(order) else ids[:0]
        bucket = ((self.values[0] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        self.buckets, self.at = np.unique(bucket.astype(np.int64), return_index=True)
        self.until = np.append(self.at[1:], len(bucket))

    def rows(self) -> Iterator[tuple[int, slice]]:
        for b, x, y in zip(self.buckets.tolist(), self.at.tolist(), self.until.tolist()):
            yield b, slice(x, y)

    def answered(self, replies: dict[int, bytes]) -> np.ndarray:
        """One boolean for each entry."""
        out = np.zeros(len(self.values[0]), bool)
        for b, s in self.rows():
            if b in replies:
                out[s] = np.unpackbits(np.frombuffer(replies[b], np.uint8), count=s.stop - s.start).view(bool)
        return out


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def shrunk(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values).tobytes(), codec="zstd", asbytes=True)


def grown(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, n * 8, codec="zstd", asbytes=True), np.int64)


SENT = "bucket long, grp long, n long, keys binary, more binary, flags binary"
REPLY = "grp long, kind int, bucket long, bits binary"


def read(table: pa.Table) -> Text:
    give_back()
    batch = table.combine_chunks().to_batches()
    array = texts(batch[0]) if batch else pa.array([], pa.string())
    ids = table.column("doc_id").combine_chunks().cast(pa.int64())
    return Text(array, np.asarray(pc.fill_null(ids, LOWEST), np.int64))


def probes(text: Text, block: int, buckets: int) -> tuple[Sent, np.ndarray, np.ndarray]:
    """Rolling windows of ``block`` words; their positions; whether they are blocks."""
    at, value = text.windows(block)
    own = (at - text.first[text.owner[at]]) % block == 0
    return Sent((value,), text.id[at], buckets), at, own


def sent_rows(grp: int, sent: Sent, keys, more, flags) -> pa.Table:
    rows = list(sent.rows())
    return pa.table(
        {
            "bucket": pa.array([b for b, _ in rows], pa.int64()),
            "grp": pa.array([grp] * len(rows), pa.int64()),
            "n": pa.array([s.stop - s.start for _, s in rows], pa.int64()),
            "keys": pa.array([keys(s) for _, s in rows], pa.binary()),
            "more": pa.array([more(s) for _, s in rows], pa.binary()),
            "flags": pa.array([flags(s) for _, s in rows], pa.binary()),
        }
    )


def reply_rows(table: pa.Table, kind: int, yes: np.ndarray, ends: np.ndarray) -> pa.Table:
    out = [(g, kind, b, bits(part)) for g, b, part in zip(
        table.column("grp").to_pylist(), table.column("bucket").to_pylist(), np.split(yes, ends[:-1])
    ) if part.any()]
    names = ("grp", "kind", "bucket", "bits")
    types = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
    return pa.table({n: pa.array([r[k] for r in out], t) for k, (n, t) in enumerate(zip(names, types))})


def probe_index(table: pa.Table) -> pa.Table:
    """Which of the windows sent to one bucket are hits: block of one document, window of another."""
    counts = np.array(table.column("n").to_pylist(), np.int64)
    keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint32)
    blocks = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table.column("flags").to_pylist(), counts)])
    several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table.column("more").to_pylist(), counts)])
    order = np.argsort(keys, kind="stable")
    start = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
    indexed = np.maximum.reduceat(blocks[order], start) > 0
    documents = np.add.reduceat(several[order].astype(np.int64) + 1, start)
    yes = np.empty(len(keys), bool)
    yes[order] = np.repeat(indexed & (documents > 1), np.diff(np.append(start, len(keys))))
    return reply_rows(table, 1, yes, np.cumsum(counts))


def smallest(table: pa.Table) -> pa.Table:
    """Which of the full windows sent to one bucket stand in a smaller id than the group's own."""
    counts = table.column("n").to_pylist()
    low = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint32)
    high = np.frombuffer(b"".join(table.column("more").to_pylist()), np.uint64)
    least = np.concatenate([np.cumsum(grown(x, n)) for x, n in zip(table.column("flags").to_pylist(), counts)])
    order = np.lexsort((low, high))
    new = np.ones(len(order), bool)
    new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    start = np.flatnonzero(new)
    yes = np.empty(len(order), bool)
    yes[order] = least[order] > np.repeat(np.minimum.reduceat(least[order], start), np.diff(np.append(start, len(order))))
    return reply_rows(table, 2, yes, np.cumsum(counts))


def replies_of(table: pa.Table, kind: int) -> dict[int, bytes]:
    mine = table.filter(pc.equal(table.column("kind"), kind)) if table.num_rows else table
    return dict(zip(mine.column("bucket").to_pylist(), mine.column("bits").to_pylist()))


def around_hits(text: Text, window: int, block: int, buckets: int, replies: pa.Table) -> tuple[np.ndarray, Sent]:
    """Positions of full windows that hold a hit, and those windows as sent."""
    sent, at, _ = probes(text, block, buckets)
    hits = np.zeros(len(text.owner) + 1, np.int64)
    hits[at + 1] = sent.answered(replies_of(replies, 1))[sent.entry]
    hits = np.cumsum(hits)
    full, low = text.windows(window)
    holds = hits[full + window - block + 1] > hits[full]
    _, high = text.windows(window, 1)
    full, low, high = full[holds], low[holds], high[holds]
    return full, Sent((low, high), text.id[full], buckets)


def remove_repeats(
    docs: DataFrame, window: int = 13, block: int | None = None, keep: tuple[str, ...] = (), with_text: bool = True
) -> DataFrame:
    """One row per document: ``keep`` columns, ``doc_id, n_words, n_removed, kept_sha256`` and ``kept_text``.

    ``kept_text`` is the text itself if nothing was removed, else the kept words
    joined by one space.
    """
    block = block or (window + 1) // 2
    if not 1 <= block <= (window + 1) // 2:
        raise ValueError("a window must hold a whole block wherever it starts")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = buckets = max(1, -(-size // GROUP_BYTES))
    keyed = docs.select(
        *[F.col(c).alias(f"keep_{k}") for k, c in enumerate(keep)],
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).alias("grp"),
    )

    def send_probes(key: tuple, table: pa.Table) -> pa.Table:
        sent, _, own = probes(read(table), block, buckets)
        indexed = np.maximum.reduceat(own[sent.order], sent.start) if len(sent.start) else own
        several = sent.most > sent.least
        return sent_rows(
            key[0].as_py(),
            sent,
            lambda s: (sent.values[0][s] & np.uint64(2**32 - 1)).astype(np.uint32).tobytes(),
            lambda s: bits(several[s]),
            lambda s: bits(indexed[s]),
        )

    def send_windows(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({f.split()[0]: pa.array([], pa.int64() if "long" in f else pa.binary()) for f in SENT.split(", ")})
        _, sent = around_hits(read(table), window, block, buckets, replies)
        return sent_rows(
            key[0].as_py(),
            sent,
            lambda s: (sent.values[0][s] & np.uint64(2**32 - 1)).astype(np.uint32).tobytes(),
            lambda s: sent.values[1][s].tobytes(),
            lambda s: shrunk(np.diff(sent.least[s], prepend=0)),
        )

    names = [*[f"keep_{k}" for k in range(len(keep))], "doc_id"]
    schema = ", ".join(
        [f"`keep_{k}` {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(keep)]
        + ["doc_id long", "n_words long", "n_removed long", "kept_sha256 string"]
        + ["kept_text string"] * with_text
    )

    def cut(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        text = read(table)
        full, sent = around_hits(text, window, block, buckets, replies)
        earlier = (sent.answered(replies_of(replies, 2))[sent.entry]) | (text.id[full] > sent.least[sent.entry])
        cover = np.zeros(len(text.owner) + 1, np.int64)
        np.add.at(cover, full[earlier], 1)
        np.add.at(cover, full[earlier] + window, -1)
        gone = np.cumsum(cover[:-1]) > 0
        digests, kept, removed = [], [], []
        for k, whole in enumerate(table.column("text").to_pylist()):
            mine = gone[text.first[k] : text.first[k + 1]]
            words = (whole or "").encode().split()
            left = b" ".join(w for w, g in zip(words, mine.tolist()) if not g) if mine.any() else b" ".join(words)
            digests.append(hashlib.sha256(left).hexdigest())
            removed.append(int(mine.sum()))
            if with_text:
                kept.append(left.decode() if removed[-1] else whole)
        columns = {n: table.column(n) for n in names}
        columns |= {
            "n_words": pa.array(np.diff(text.first)),
            "n_removed": pa.array(removed, pa.int64()),
            "kept_sha256": pa.array(digests, pa.string()),
        }
        return pa.table(columns | ({"kept_text": pa.array(kept, pa.string())} if with_text else {}))

    by_group = keyed.groupBy("grp")
    hits = by_group.applyInArrow(send_probes, SENT).groupBy("bucket").applyInArrow(probe_index, REPLY)
    found = by_group.cogroup(hits.groupBy("grp")).applyInArrow(send_windows, SENT)
    earlier = found.groupBy("bucket").applyInArrow(smallest, REPLY)
    result = by_group.cogroup(hits.unionByName(earlier).groupBy("grp")).applyInArrow(cut, schema)
    renamed = [F.col(f"keep_{k}").alias(c) for k, c in enumerate(keep)]
    rest = ["doc_id"] * ("doc_id" not in keep) + ["n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
    return result.select(*renamed, *rest)
