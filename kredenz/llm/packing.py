"""Cost-balanced packing of token ids into sequences.

A batch of documents is tokenized and packed at once. The cost of a piece is
linear plus quadratic in its length (attention). A batch with t tokens opens
``ceil(t / capacity)`` sequences; pieces go, longest first, to the sequence of
lowest cost that still has room. A piece for which no sequence has room is cut
over the sequences with most room, so that only the last tokens of a batch are
padding (less than one sequence for each batch of about ``PACKED_BYTES`` of text).

Documents longer than a sequence are cut into full sequences and one rest.
Sequence ids are unique over the table: partition, batch and sequence in one long.
A task that runs again packs the same rows the same way. Nothing is shuffled.

Null and empty texts hold the end id alone. Repeated rows are packed as separate
documents. Ties in length keep input order. Other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from kredenz.llm.batches import gather, slices, texts, totals, word_table

#: Letters of ASCII and the Latin blocks that stay one letter in lower case.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
JOINED = 512  # words per call in the joined form
AT_ONCE = 8_192
WORDS_AT_ONCE = 131_072  # words of texts put together at a time
PIECES_AT_ONCE = 512  # rows in a batch of results
PACKED_BYTES = 10_000_000  # text packed at a time
PIECE_COST, PAIR_COST = 1.0, 1.0 / 1024  # per token, and per pair of tokens


def encode_each(tokenizer, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces one after another, and their numbers."""
    ids, counts = [], []
    for k in range(0, len(pieces), AT_ONCE):
        for e in tokenizer.encode_batch_fast(pieces[k : k + AT_ONCE], add_special_tokens=False):
            ids.extend(e.ids)
            counts.append(len(e.ids))
    return np.array(ids, np.int64), np.array(counts, np.int64)


def encode_words(tokenizer, words: list[str], closes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``encode_each`` for words of letters only, many words in one call.

    Each such word ends with the one id that closes a word, which tells the words
    apart again; a call whose closings don't match its words is encoded singly.
    """
    groups = [words[k : k + JOINED] for k in range(0, len(words), JOINED)]
    ids, counts = [], []
    for k in range(0, len(groups), 16):
        part = groups[k : k + 16]
        for group, e in zip(part, tokenizer.encode_batch_fast([" ".join(g) for g in part], add_special_tokens=False)):
            own = np.array(e.ids, np.int64)
            ends = np.flatnonzero(closes[own])
            if len(ends) == len(group) and ends[-1] == len(own) - 1:
                ids.append(own)
                counts.append(np.diff(ends, prepend=-1))
            else:
                for x in encode_each(tokenizer, group):
                    (ids if len(ids) == len(counts) else counts).append(x)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(ids or none), np.concatenate(counts or none)


def tokenize(tokenizer, closes: np.ndarray, array: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each followed by ``end_id``, and where each text begins.

    White space never is part of an id, so a text's ids are those of its words
    one after another; each distinct word is encoded once.
    """
    words = word_table(array)
    n = len(words.distinct)
    if not n:
        return np.full(len(array), end_id, "<u4"), np.arange(len(array) + 1)
    marked = np.asarray(pc.match_substring_regex(words.distinct, f"^[{LETTERS}]+[.,]$"))
    cores = pc.if_else(pa.array(marked), pc.utf8_slice_codeunits(words.distinct, 0, -1), words.distinct)
    cores = pc.ascii_lower(cores).dictionary_encode() if _lowers(tokenizer) else cores.dictionary_encode()
    simple = np.asarray(pc.match_substring_regex(cores.dictionary, f"^[{LETTERS}]+$"))
    a_ids, a_counts = encode_words(tokenizer, cores.dictionary.filter(pa.array(simple)).to_pylist(), closes)
    b_ids, b_counts = encode_each(tokenizer, cores.dictionary.filter(pa.array(~simple)).to_pylist())
    marks, m_counts = encode_each(tokenizer, [".", ","])
    # ids of every distinct core in one array, and where each begins
    pool = np.concatenate([a_ids, b_ids, marks])
    counts, begins = np.zeros(len(simple), np.int64), np.zeros(len(simple), np.int64)
    counts[simple], begins[simple] = a_counts, np.cumsum(a_counts) - a_counts
    counts[~simple], begins[~simple] = b_counts, len(a_ids) + np.cumsum(b_counts) - b_counts
    # distinct words: core, then the mark if there is one
    which = np.asarray(cores.indices)
    comma = np.asarray(pc.ends_with(words.distinct, ","))
    mark_at = np.where(comma, m_counts[0], 0) + len(a_ids) + len(b_ids)
    mark_n = np.where(marked, np.where(comma, m_counts[1], m_counts[0]), 0)
    lengths = np.column_stack([counts[which], mark_n]).ravel()
    pool = gather(pool, np.column_stack([begins[which], mark_at]).ravel(), lengths)
    per_word = lengths.reshape(-1, 2).sum(1)
    word_at = np.cumsum(per_word) - per_word
    # texts: their words, then the end id; put together some words at a time, so that nothing wide is held for all
    pool = np.append(pool, end_id).astype("<u4")
    per_word, word_at = np.append(per_word, 1), np.append(word_at, len(pool) - 1)
    codes, ends = np.insert(words.codes.astype(np.int32), words.offsets[1:], n), words.offsets + np.arange(len(words.offsets))
    del words, cores, which, comma, mark_at, mark_n, lengths
    lengths = per_word.astype(np.int32)[codes]
    begins = np.concatenate([[0], np.cumsum(totals(lengths, ends))])
    out, done = np.empty(begins[-1], "<u4"), 0
    for k in range(0, len(codes), WORDS_AT_ONCE):
        some = codes[k : k + WORDS_AT_ONCE]
        ids = gather(pool, word_at[some], per_word[some])
        out[done : done + len(ids)] = ids
        done += len(ids)
    return out, begins


def _lowers(tokenizer) -> bool:
    return tokenizer.encode("A", add_special_tokens=False).ids == tokenizer.encode("a", add_special_tokens=False).ids


def pack(sizes: list[int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Pieces ``(document, start, length, sequence)`` of documents with these token counts."""
    pieces, rests, full = [], [], 0
    for k, size in enumerate(sizes):
        whole = size // capacity
        for j in range(whole):
            pieces.append((k, j * capacity, capacity, full))
            full += 1
        if size % capacity:
            rests.append((k, whole * capacity, size % capacity))
    bins = -(-sum(r[2] for r in rests) // capacity)
    room = [capacity] * bins
    fits = [(0.0, b) for b in range(bins)]  # those with room for the piece at hand; pieces only get shorter
    parked: list[tuple[int, int, float]] = []  # the others, most room first
    late = []
    for k, start, length in sorted(rests, key=lambda r: -r[2]):
        while parked and -parked[0][0] >= length:
            _, b, cost = heapq.heappop(parked)
            heapq.heappush(fits, (cost, b))
        if not fits:
            late.append((k, start, length))
            continue
        cost, b = fits[0]
        pieces.append((k, start, length, full + b))
        room[b] -= length
        cost += PIECE_COST * length + PAIR_COST * length * length
        if room[b] >= length:
            heapq.heapreplace(fits, (cost, b))
        else:
            heapq.heappop(fits)
            if room[b]:
                heapq.heappush(parked, (-room[b], b, cost))
    free = sorted((b for b in range(bins) if room[b]), key=lambda b: (-room[b], b))
    for k, start, length in late:  # cut over what room there is
        while length:
            b = free[0]
            part = min(length, room[b])
            pieces.append((k, start, part, full + b))
            room[b] -= part
            if not room[b]:
                free.pop(0)
            start, length = start + part, length - part
    return pieces


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, and ``ids`` if wanted."""
    schema = f"{SCHEMA}, ids array<int>" if with_ids else SCHEMA
    if capacity < 1:
        raise ValueError("capacity must be positive")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        named = sorted(tokenizer.get_vocab().items(), key=lambda x: x[1])
        closes = np.zeros(named[-1][1] + 1, bool)
        closes[[i for word, i in named if word.endswith("</w>")]] = True
        base, used = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            for part in slices(batch, "text", PACKED_BYTES):
                ids, begins = tokenize(tokenizer, closes, texts(part), end_id)
                sizes = np.diff(begins)
                pieces = np.array(pack(sizes.tolist(), capacity), np.int64).reshape(-1, 4)
                pieces = pieces[np.lexsort((pieces[:, 1], pieces[:, 0], pieces[:, 3]))]
                k, start, length, sequence = pieces.T
                running = np.cumsum(length) - length
                new = np.concatenate([[True], sequence[1:] != sequence[:-1]])
                offset = running - running[new][np.cumsum(new) - 1]
                at = begins[k] + start
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())]
                for a in range(0, len(k), PIECES_AT_ONCE):
                    s = slice(a, a + PIECES_AT_ONCE)
                    columns = [
                        part.column("doc_id").cast(pa.int64()).take(pa.array(k[s])),
                        pa.array(start[s]),
                        pa.array(length[s]),
                        pa.array(crc[s], pa.int64()),
                        pa.array(sizes[k[s]]),
                        pa.array(base + used + sequence[s]),
                        pa.array(offset[s]),
                    ]
                    if with_ids:
                        flat = gather(ids, at[s], length[s]).astype(np.int32)
                        ends = np.concatenate([[0], np.cumsum(length[s])])
                        columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)))
                    yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in schema.split(", ")])
                used += int(sequence.max()) + 1

    return docs.select("doc_id", "text").mapInArrow(run, schema)


SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)
