"""Arrow batches of texts: byte-bounded slices and word tables.

A word table holds the words of many texts as codes into one list of distinct
words, so per-word Python work is done once per distinct word of a slice.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 8_000_000


def give_back() -> None:
    """Return freed memory to the system: a worker is used again by later stages."""
    pa.default_memory_pool().release_unused()
    library = ctypes.CDLL(None)
    if hasattr(library, "malloc_trim"):
        library.malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut ``batch`` into runs of rows whose texts hold about ``most`` bytes.

    A single text above ``most`` is a slice of its own; no row is dropped.
    """
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes, dtype=np.int64) - sizes) // most
    begins = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(begins, begins[1:]):
        yield batch.slice(a, b - a)
        give_back()


def texts(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The text column as plain strings, null as empty."""
    return pc.fill_null(batch.column(column).cast(pa.string()), "")


@dataclass
class Words:
    """``codes[offsets[i]:offsets[i + 1]]`` are the words of text i, as rows of ``distinct``."""

    codes: np.ndarray
    offsets: np.ndarray
    distinct: pa.Array

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def owner(self) -> np.ndarray:
        """Text number of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def word_table(array: pa.Array) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text."""
    lists = pc.ascii_split_whitespace(array)
    flat, offsets = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    full = np.asarray(pc.binary_length(flat)) > 0
    if not full.all():
        flat = flat.filter(pa.array(full))
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
    coded = flat.dictionary_encode()
    return Words(np.asarray(coded.indices, dtype=np.int64), offsets, coded.dictionary)


def totals(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive offsets; empty runs give 0."""
    kind = np.float64 if values.dtype.kind == "f" else np.int64
    running = np.concatenate([[0], np.cumsum(values, dtype=kind)])
    return running[offsets[1:]] - running[offsets[:-1]]


def gather(parts: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate ``parts[begins[i]:begins[i] + lengths[i]]`` over all i."""
    ends = np.cumsum(lengths)
    step = np.arange(ends[-1] if len(ends) else 0, dtype=np.int64)
    return parts[step + np.repeat(begins - (ends - lengths), lengths)]


def answered(
    batches: Iterable[pa.RecordBatch],
    build: Callable[[pa.Table], object],
    answer: Callable[[object, pa.RecordBatch], pa.RecordBatch],
) -> Iterator[pa.RecordBatch]:
    """Answers to the questions of each shard, whose rows come first (sorted by ``shard``, then ``kind``: 0 rows, 1 questions).

    Memory holds one shard's index and one batch of questions.
    """
    shard, held, index = None, [], None
    for batch in batches:
        mark = batch.column("shard").to_numpy().astype(np.int64) * 2 + batch.column("kind").to_numpy()
        begins = [0, *(np.flatnonzero(np.diff(mark)) + 1).tolist(), len(mark)] if len(mark) else []
        for a, b in zip(begins, begins[1:]):
            now, kind = divmod(int(mark[a]), 2)
            if now != shard:
                shard, held, index = now, [], None
            if not kind:
                held.append(batch.slice(a, b - a))
                continue
            if held:
                index, held = build(pa.Table.from_batches(held)), []
            if index:
                yield answer(index, batch.slice(a, b - a))


def shard_count(rows: int, tasks: int, few: int, many: int) -> int:
    """How many shards: each of ``few`` rows at least while tasks go idle, and of ``many`` at most."""
    return max(1, -(-rows // many), min(-(-rows // few), 4 * tasks))
