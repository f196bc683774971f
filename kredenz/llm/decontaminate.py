"""Benchmark decontamination: edit-similar passages by embedding, bit sampling and exact distance.

Texts are compared as words (lower case, without marks at their ends) under edit
distance. A passage matches an item of L words if its distance is at most
``floor((1 - similarity) * L)``.

* CGK embedding: a random walk copies the word under its pointer and moves on with a coin
  that depends on step and word, two steps per word on average. Walks over edit-similar
  texts meet again after an edit, so few steps differ: Hamming distance in place of
  edit distance.
* Bit sampling: each repetition samples ``SAMPLED`` steps of its own walk as a key.
  Windows as long as an item whose key equals the item's in any repetition are
  candidates. Repetitions follow from ``recall`` and the rates measured on items of each
  length, edited as far as the bound allows.
* Candidates are verified by exact edit distance, with the passage's end free.

Windows are embedded only where they can match at all: a passage within the bound shares
at least ``(L - q + 1) - q * edits`` q-grams with its item, so windows with fewer benchmark
q-grams are passed over. Candidates come from the keys alone.

The benchmark is the stated query set: it is read in blocks of ``BLOCK_WORDS`` words at most,
each block travels with its own pass over the documents, and nothing is shuffled.

Items under ``min_words`` words that hold a script written without spaces are compared by characters,
without white space and marks, in the same way: embedding, keys and exact distance. Other items under
``min_words`` words, and such texts under ``min_words`` characters, match exactly only. Items and documents
are split alike. Texts are whole, of any length; of other columns, whatever their names, none is read.

Null and empty texts never match. Equal items are reported each under their own id, equal
documents each with their own rows. A pair of document and item gives one row, its
nearest passage (ties to the first). An empty table gives no rows.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_64_intdigest

from kredenz.llm.batches import Words, slices, texts, word_table
from kredenz.llm.shards import scramble

BLOCK_WORDS = 1_000_000
SAMPLED = 2
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»‘’“”„…–—·"
#: Thai, Lao, Tibetan, Myanmar, Khmer, Japanese and Chinese: words without spaces between them.
UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
NO_MARKS = dict.fromkeys(map(ord, MARKS + "、。，！？；：（）「」『』【】《》"))
TABLE_BITS = 22
CHUNK = 20_000  # windows embedded at a time
TRIALS = 160  # edited items of a length to measure repetitions on
MOST = 4096  # repetitions; beyond them all windows are candidates


def symbol(word: str) -> int:
    """Lower case without marks at either end, as a number; a word of marks only stays as it is."""
    word = word.lower()
    return xxh3_64_intdigest((word.strip(MARKS) or word).encode()) or 1


def symbols(words: Iterable[str]) -> np.ndarray:
    return np.array([symbol(w) for w in words], np.uint64)


def edits_allowed(length: int, similarity: float) -> int:
    return int((1 - similarity) * length + 1e-9)


def gram(length: int) -> int:
    return 3 if length >= 8 else 2


def grams(text: np.ndarray, q: int) -> np.ndarray:
    n = max(0, len(text) - q + 1)
    value = np.zeros(n, np.uint64)
    for k in range(q):
        value = scramble(value + text[k : k + n])
    return value


def sampled_steps(length: int, repetition: int) -> list[int]:
    return sorted(random.Random(f"{length} {repetition}").sample(range(2 * length), SAMPLED))


def keys(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, repeat: int) -> np.ndarray:
    """Sampled steps of the embedding of each window ``[start, min(start + length, end))``, as one value.

    One row for each of ``repeat`` repetitions; each walks with coins of its own. Steps are
    sampled where walks still are inside the text on average; a key with a step past
    the end says nothing about words and is 0.
    """
    steps = np.array([sampled_steps(length, r) for r in range(repeat)])
    last = int(steps.max())
    coins = scramble(np.arange(repeat * (last + 1), dtype=np.uint64)).reshape(repeat, -1) | np.uint64(1)
    at = np.tile(starts, (repeat, 1))
    stop = np.minimum(starts + length, ends)
    key, past = np.zeros(at.shape, np.uint64), np.zeros(at.shape, bool)
    for step in range(last + 1):
        here = np.where(at < stop, text[np.minimum(at, len(text) - 1)], np.uint64(0))
        taken = (steps == step).any(1)
        if taken.any():
            key[taken] = scramble(key[taken] ^ here[taken]) + np.uint64(step)
            past[taken] |= here[taken] == 0
        at += ((here * coins[:, step : step + 1]) >> np.uint64(63)).astype(np.int64)
    key[past] = 0
    return key


def edit_distance(item: list, text: list, most: int) -> tuple[int, int] | None:
    """Least distance of ``item`` to a prefix of ``text``, and that prefix's length; None above ``most``."""
    if item == text[: len(item)]:
        return 0, len(item)
    wide = len(item) + most + 1
    row = list(range(len(text) + 1))
    for i, a in enumerate(item, 1):
        low, high = max(1, i - most), min(len(text), i + most)
        new = [wide] * (len(text) + 1)
        if low == 1:
            new[0] = i
        for j in range(low, high + 1):
            new[j] = min(row[j - 1] + (a != text[j - 1]), row[j] + 1, new[j - 1] + 1)
        row = new
    best = min(range(len(text) + 1), key=lambda j: (row[j], abs(j - len(item)), j))
    return (row[best], best) if row[best] <= most else None


def repetitions(items: list[np.ndarray], similarity: float, recall: float) -> int:
    """Repetitions that reach ``recall`` on items of one length, edited as far as the bound allows.

    That is the mean over edited items of finding each in any repetition, since a few
    edits in bad places need far more than the mean rate tells. 0 if ``MOST`` aren't enough.
    """
    dice = random.Random(1)
    n, trials, base = len(items[0]), [], []
    some = items[:: -(-len(items) // 20)]
    for item in some:
        first = len(trials)
        trials.append(item.tolist())
        for _ in range(-(-TRIALS // len(some))):
            edited = item.tolist()
            for _ in range(edits_allowed(n, similarity)):
                k, how = dice.randrange(len(edited)), dice.randrange(3)
                edited[k : k + (how != 1)] = [dice.getrandbits(63)] if how != 2 else []
            trials.append(edited)
            base.append((first, len(trials) - 1))
    ends = np.cumsum([len(t) for t in trials])
    starts = ends - [len(t) for t in trials]
    text, (own, other) = np.array([w for t in trials for w in t], np.uint64), np.array(base).T
    tried = 32
    while tried <= MOST:
        key = keys(text, starts, ends, n, tried)
        miss = 1 - ((key[:, other] == key[:, own]) & (key[:, own] > 0)).mean(0)
        reached = 1 - (miss ** np.arange(1, tried + 1)[:, None]).mean(1) >= recall
        if reached.any():
            return max(4, int(reached.argmax()) + 1)
        tried *= 2
    return 0


def length_class(n: int) -> int:
    """Lengths that share their repetitions: each its own below 64, then steps of a sixteenth to a thirty-second."""
    step = 1 << max(0, n.bit_length() - 6)
    return -(-n // step) * step


class Index:
    """Keys and q-grams of items, which are sequences of words or characters."""

    def __init__(self, items: dict[tuple, list[int]], similarity: float, recall: float):
        self.similarity = similarity
        self.texts = [np.array(t, np.uint64) for t in items]
        self.ids = list(items.values())
        self.lengths = sorted({len(t) for t in self.texts})
        longest = {length_class(n): n for n in self.lengths}
        measured = {c: repetitions([t for t in self.texts if len(t) == n], similarity, recall) for c, n in longest.items()}
        self.repeat = {n: measured[length_class(n)] for n in self.lengths}
        self.own: dict[int, list[int]] = {}
        self.grams = {
            q: np.unique(np.concatenate([grams(t, q) for t in self.texts if gram(len(t)) == q]))
            for q in {gram(n) for n in self.lengths}
        }
        self.bags = [frozenset(t.tolist()) for t in self.texts]
        self.own_grams: dict[int, np.ndarray] = {}
        self.keys: dict[int, list[dict[int, list[int]]]] = {}
        for n in self.lengths:
            own = [k for k, t in enumerate(self.texts) if len(t) == n]
            self.own[n] = own
            joined = np.concatenate([self.texts[k] for k in own])
            starts = np.arange(len(own)) * n
            self.own_grams[n] = np.unique(np.concatenate([grams(self.texts[k], gram(n)) for k in own]))
            self.keys[n] = []
            for row in keys(joined, starts, starts + n, n, self.repeat[n]).tolist() if self.repeat[n] else ():
                table = defaultdict(list)
                for k, key in zip(own, row):
                    if key:
                        table[key].append(k)
                self.keys[n].append(dict(table))

    def shared(self, text: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of ``text`` at which a benchmark q-gram begins, and its value there."""
        value, known = grams(text, q), self.grams[q]
        light = np.zeros(1 << TABLE_BITS, bool)
        light[known >> np.uint64(64 - TABLE_BITS)] = True
        found = np.flatnonzero(light[value >> np.uint64(64 - TABLE_BITS)])
        found = found[np.isin(value[found], known)]
        return found, value[found]

    def starts(self, n: int, found: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Starts of windows with as many q-grams of items of ``n`` words as a match must have."""
        most, q = edits_allowed(n, self.similarity), gram(n)
        starts = np.unique((found[:, None] - np.arange(n + most)).ravel())
        starts = starts[starts >= 0]
        reach = np.minimum(starts + n + most, end[starts]) - q + 1
        shared = np.searchsorted(found, reach) - np.searchsorted(found, starts)
        return starts[shared >= max(1, n - q + 1 - q * most)]

    def candidates(self, text: np.ndarray, end: np.ndarray) -> set[tuple[int, int]]:
        """Pairs of window start and item with one key in any repetition; ``end`` is each word's text end."""
        out: set[tuple[int, int]] = set()
        places = {q: self.shared(text, q) for q in self.grams}
        for n in self.lengths:
            found, value = places[gram(n)]
            if not len(found := found[np.isin(value, self.own_grams[n])]):
                continue
            starts = self.starts(n, found, end)
            if not self.repeat[n]:
                out.update((p, k) for p in starts.tolist() for k in self.own[n])
                continue
            for a in range(0, len(starts), CHUNK):
                some = starts[a : a + CHUNK]
                for table, row in zip(self.keys[n], keys(text, some, end[some], n, self.repeat[n])):
                    for p, key in zip(some.tolist(), row.tolist()):
                        out.update((p, k) for k in table.get(key, ()))
        return out

    def matches(self, text: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int]]:
        """``(text number, item, first symbol, symbols, distance, item's symbols)``, nearest passage of each pair."""
        if not self.texts or not len(text):
            return
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for p, k in sorted(self.candidates(text, offsets[1:][owner])):
            item, doc = self.texts[k].tolist(), int(owner[p])
            most = edits_allowed(len(item), self.similarity)
            window = text[p : min(p + len(item) + most, int(offsets[doc + 1]))].tolist()
            if best.get((doc, k), (most + 1,))[0] == 0 or sum(w in self.bags[k] for w in window) < len(item) - most:
                continue  # each word of the item that isn't there is an edit
            got = edit_distance(item, window, most)
            if got and (old := best.get((doc, k), (most + 1,)))[0] > got[0]:
                best[doc, k] = (got[0], p - int(offsets[doc]), got[1])
        for (doc, k), (distance, first, words) in best.items():
            for item_id in self.ids[k]:
                yield doc, item_id, first, words, distance, len(self.texts[k])


class Block:
    """A block of items: by words, by characters, and those that must be there exactly."""

    def __init__(self, rows: list[tuple[int, str]], similarity: float, recall: float, min_words: int):
        items: dict[tuple, list[int]] = defaultdict(list)
        unspaced: dict[tuple, list[int]] = defaultdict(list)
        self.short: dict[int, dict[tuple, list[int]]] = defaultdict(lambda: defaultdict(list))
        self.passages: dict[tuple, list[int]] = defaultdict(list)
        split = word_table(pa.array([text or "" for _, text in rows], pa.string()))
        distinct = split.distinct.to_pylist()
        for (item_id, _), a, b in zip(rows, split.offsets, split.offsets[1:]):
            words = [distinct[c] for c in split.codes[a:b]]
            key = tuple(symbols(words).tolist())
            if len(words) >= min_words:
                items[key].append(item_id)
            elif any(map(UNSPACED.search, words)):
                signs = tuple(characters(words)[0].tolist())
                (unspaced if len(signs) >= min_words else self.passages)[signs].append(item_id)
            elif words:
                self.short[len(words)][key].append(item_id)
        self.short = {n: dict(found) for n, found in self.short.items()}
        self.passages = dict(self.passages)
        self.words, self.signs = Index(items, similarity, recall), Index(unspaced, similarity, recall)

    def short_matches(self, text: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int]]:
        """As ``matches``, for items that must be there word by word: the first place of each."""
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        for n, items in self.short.items():
            yield from exact_matches(items, n, text, offsets, owner)

    def unspaced_matches(self, words: Words) -> Iterator[tuple[int, int, int, int, int, int]]:
        """As ``matches``, by characters, for the texts that hold a script without spaces; places are told in words."""
        if not self.signs.texts and not self.passages:
            return
        distinct = words.distinct.to_pylist()
        unspaced = np.array([bool(UNSPACED.search(w)) for w in distinct], bool)
        hit = unspaced[words.codes] if len(words.codes) else np.zeros(0, bool)
        for doc in np.unique(words.owner[hit]).tolist():
            text, word = characters([distinct[c] for c in words.codes[words.offsets[doc] : words.offsets[doc + 1]]])
            offsets = np.array([0, len(text)])
            found = list(self.signs.matches(text, offsets))
            for n in {len(t) for t in self.passages}:
                own = {t: ids for t, ids in self.passages.items() if len(t) == n}
                found += exact_matches(own, n, text, offsets, np.zeros(len(text), np.int64))
            for _, item_id, first, n, distance, length in found:
                begin, end = (int(word[k]) for k in (first, max(first, first + n - 1)))
                yield doc, item_id, begin, end - begin + 1, distance, length


def characters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of words in lower case, without marks, as numbers; and the word of each."""
    plain = [w.lower().translate(NO_MARKS) for w in words]
    signs = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    return scramble(signs) | np.uint64(1), np.repeat(np.arange(len(plain)), [len(w) for w in plain])


def exact_matches(
    items: dict[tuple, list[int]], n: int, text: np.ndarray, offsets: np.ndarray, owner: np.ndarray
) -> Iterator[tuple[int, int, int, int, int, int]]:
    """The first place of each item, all ``n`` symbols long, in each text."""
    if len(text) < n or not n:
        return
    known = np.concatenate([grams(np.array(t, np.uint64), n) for t in items])
    places = np.flatnonzero(np.isin(grams(text, n), known))
    seen = set()
    for p in places[places + n <= offsets[1:][owner[places]]].tolist():
        key, doc = tuple(text[p : p + n].tolist()), int(owner[p])
        if key in items and (doc, key) not in seen:
            seen.add((doc, key))
            for item_id in items[key]:
                yield doc, item_id, p - int(offsets[doc]), n, 0, n


def blocks_of(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    rows, words = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        size = len((row["text"] or "").split())
        if rows and words + size > BLOCK_WORDS:
            yield rows
            rows, words = [], 0
        rows.append((row["item_id"], row["text"]))
        words += size
    yield rows


SCHEMA = "doc_id long, item_id long, first_word long, n_words long, distance int, similarity double"


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = 0.99, min_words: int = 5) -> DataFrame:
    """One row per document and item found in it: ``doc_id, item_id, first_word, n_words, distance, similarity``."""

    def search(block: Block):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    words = word_table(texts(part))
                    text = symbols(words.distinct.to_pylist())[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
                    rows = [*block.words.matches(text, words.offsets), *block.short_matches(text, words.offsets), *block.unspaced_matches(words)]
                    ids = part.column("doc_id").cast(pa.int64()).take(pa.array([r[0] for r in rows], pa.int64()))
                    columns = [ids] + [pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 3)]
                    columns += [pa.array([r[4] for r in rows], pa.int32()), pa.array([1 - r[4] / r[5] for r in rows], pa.float64())]
                    yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in SCHEMA.split(", ")])

        return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)

    found = None
    for rows in blocks_of(benchmark):
        part = search(Block(rows, similarity, recall, min_words))
        found = part if found is None else found.unionByName(part)
    return found
