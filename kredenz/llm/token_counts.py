"""Token counts of whole texts by a public byte-level tokenizer.

Batch encoding in Arrow functions that return lengths only. A text is cut at
every safe boundary: a single space between two printable characters, where
the tokenizer always starts a new piece, so counts of pieces add up to the
count of the text. Each distinct piece of a byte-balanced batch is encoded
once; long texts need no special case since they are cut the same way.

Nulls and empty texts have 0 bytes and 0 tokens. Repeated rows and ids give one
row each. Other columns of the input are not read, so clashing names do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from kredenz.llm.batches import slices, texts, totals

#: Printable characters of ASCII and of the Latin blocks; none is white space.
SAFE = "!-~¡-¬®-ɏ"
CUT = re.compile(f"(?<=[{SAFE}])(?= [{SAFE}])")
#: A word and one mark after it are two pieces of the tokenizer.
WORD_MARK = "^[A-Za-zÀ-ÖØ-öø-ɏ]+[.,;:!?]$"
AT_ONCE = 8_192  # pieces per call, so that only few encodings exist at a time


def library_counts(tokenizer, pieces: list[str]) -> np.ndarray:
    """Tokens of each piece, special strings as the library treats them by default."""
    found = np.zeros(len(pieces), np.int64)
    for k in range(0, len(pieces), AT_ONCE):
        part = tokenizer.encode_batch_fast(pieces[k : k + AT_ONCE], add_special_tokens=False)
        found[k : k + len(part)] = [len(e) for e in part]
    return found


def piece_counts(tokenizer, pieces: pa.Array, lead: str) -> np.ndarray:
    """Tokens of ``lead + piece`` for each piece; a mark after a word is counted apart."""
    marked = np.asarray(pc.match_substring_regex(pieces, WORD_MARK))
    cores = pc.if_else(pa.array(marked), pc.utf8_slice_codeunits(pieces, 0, -1), pieces).dictionary_encode()
    counts = library_counts(tokenizer, [lead + x for x in cores.dictionary.to_pylist()])[np.asarray(cores.indices)]
    marks = pc.utf8_slice_codeunits(pieces.filter(pa.array(marked)), -1).dictionary_encode()
    if len(marks):
        counts[marked] += library_counts(tokenizer, marks.dictionary.to_pylist())[np.asarray(marks.indices)]
    return counts


def count_texts(tokenizer, array: pa.Array) -> np.ndarray:
    """Token count of every text of ``array`` (no nulls)."""
    if not len(array):
        return np.zeros(0, np.int64)
    lists = pc.split_pattern(array, " ")
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    flat = lists.flatten()
    first = np.zeros(len(flat), bool)
    first[offsets[:-1]] = True  # every text has at least one piece
    result = np.zeros(len(flat), np.int64)
    plain = np.ones(len(flat), bool)
    for chosen, lead in ((first, ""), (~first, " ")):
        coded = flat.filter(pa.array(chosen)).dictionary_encode()
        if not len(coded):
            continue
        distinct = coded.dictionary
        edges = np.asarray(pc.match_substring_regex(distinct, f"(?s)^[{SAFE}](?:.*[{SAFE}])?$"))
        counts = np.zeros(len(distinct), np.int64)
        if edges.any():
            counts[edges] = piece_counts(tokenizer, distinct.filter(pa.array(edges)), lead)
        where = np.asarray(coded.indices)
        result[chosen], plain[chosen] = counts[where], edges[where]
    tokens = totals(result, offsets)
    odd = np.flatnonzero(totals(~plain, offsets))
    if len(odd):  # white space beside a space: cut these texts by the expression
        cut = [CUT.split(x) for x in array.take(pa.array(odd)).to_pylist()]
        coded = pa.array([x for pieces in cut for x in pieces], pa.string()).dictionary_encode()
        counts = library_counts(tokenizer, coded.dictionary.to_pylist())[np.asarray(coded.indices)]
        tokens[odd] = totals(counts, np.cumsum([0, *map(len, cut)]))
    return tokens


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, over_limit``."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        for batch in batches:
            for part in slices(batch, "text"):
                array = texts(part)
                tokens = count_texts(tokenizer, array)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()),
                        pc.binary_length(array).cast(pa.int64()),
                        pa.array(tokens, pa.int64()),
                        pa.array(tokens > limit),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    return docs.select("doc_id", "text").mapInArrow(count, schema)
