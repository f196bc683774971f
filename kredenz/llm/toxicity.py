"""Toxic spans by a linear-chain conditional random field over the words of a text.

Fitting uses a bounded sample of labelled documents (``SAMPLE`` of each label, of at most
``SAMPLE_BYTES`` bytes each; near copies once). Tokens get labels from the documents': a
word of a toxic document is toxic if one of its features (the word, its beginnings
and whether it goes on) stands in toxic documents far more often than in clean
ones; words of clean documents are clean. The chain (two tags, one weight for each
hashed feature, a transition matrix) is fitted to these tags by gradient ascent on its
conditional likelihood.

Scoring reads whole texts of any length: forward and backward messages are products
of 2 x 2 matrices, taken in blocks, so a long text is no long loop. The marginals of
"toxic" add up to a document's expected toxic words; a logistic curve over it and the
highest marginal gives the score. Words above 1/2 are the offending spans.

Labels, language, source and id are never inputs of a score. Nulls and empty texts score
by the curve at no words. Documents with several label rows are toxic if any row says
so; null labels and ids don't count. With no usable labels of both kinds every score is 0.
Repeated rows give one row each; an empty table gives none. Columns named in ``keep`` are handed through beside
the results; others are not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kredenz.llm.batches import Words, gather, slices, texts, totals, word_table

SAMPLE = 2_000  # documents of each label
SAMPLE_BYTES = 20_000  # longest document of the sample
SLICE_BYTES = 4_000_000  # text scored at a time
BITS = 18
BLOCK = 64
AT_ONCE = 200_000  # words whose messages are held at a time
STEPS = 30
RIDGE = 0.3
PRECISION, SURPRISE = 0.8, 6.0
WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(word: str) -> str:
    """Lower case without marks at either end."""
    word = word.lower()
    a, z = 0, len(word)
    while a < z and not word[a].isalnum():
        a += 1
    while z > a and not word[z - 1].isalnum():
        z -= 1
    return word[a:z] or word


def features(word: str) -> list[int]:
    """Hashed features of a word: itself, and its beginnings with whether it goes on."""
    word = plain(word)
    names = [word + "$"] + [word[:n] + ("+" if len(word) > n else ".") for n in range(4, min(8, len(word)) + 1)]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for x in names]


def feature_table(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all words one after another, and the word each belongs to."""
    flat, counts = [], []
    for k in range(0, len(words), 20_000):  # few Python lists at a time
        lists = [features(w) for w in words[k : k + 20_000]]
        counts.append(np.fromiter(map(len, lists), np.int64, len(lists)))
        flat.append(np.fromiter((f for own in lists for f in own), np.int32, int(counts[-1].sum())))
    if not flat:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(flat), np.repeat(np.arange(len(words), dtype=np.int32), np.concatenate(counts))


def spans_of_texts(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of whole texts with about ``AT_ONCE`` words each."""
    part = offsets[:-1] // AT_ONCE
    begins = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    return ((a, b) for a, b in zip(begins, begins[1:]) if offsets[b] > offsets[a])


def chain(matrices: np.ndarray) -> np.ndarray:
    """Normalized row vectors ``v[t] ~ v[t - 1] M[t]`` for (n, 2, 2) matrices, in blocks."""
    n = len(matrices)
    if n <= BLOCK:
        out, v = np.empty((n, 2)), np.array([0.5, 0.5])
        for t in range(n):
            v = v @ matrices[t]
            v = out[t] = v / v.sum()
        return out
    rows = -(-n // BLOCK)
    padded = np.broadcast_to(np.eye(2), (rows * BLOCK, 2, 2)).copy()
    padded[:n] = matrices
    blocks = padded.reshape(rows, BLOCK, 2, 2)
    running = np.empty((BLOCK, rows, 2, 2))
    now = blocks[:, 0].copy()
    for t in range(BLOCK):
        if t:
            m, old = blocks[:, t], now
            now = np.empty_like(old)
            for i in (0, 1):
                for j in (0, 1):
                    now[:, i, j] = old[:, i, 0] * m[:, 0, j] + old[:, i, 1] * m[:, 1, j]
        now /= now.sum((1, 2))[:, None, None]
        running[t] = now
    before = np.empty((rows, 2))
    before[0] = 0.5
    before[1:] = chain(now)[:-1]
    out = before[None, :, 0, None] * running[:, :, 0] + before[None, :, 1, None] * running[:, :, 1]
    out /= out.sum(2)[:, :, None]
    return out.transpose(1, 0, 2).reshape(-1, 2)[:n]


@dataclass
class Chain:
    """Weights: per hashed feature, a bias, tag transitions and the first tag (all as scores of a tag)."""

    weights: np.ndarray
    bias: float
    moves: np.ndarray
    start: np.ndarray

    def emissions(self, flat: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        return np.clip(np.bincount(owner, self.weights[flat], n) + self.bias, -30, 30)

    def messages(self, score: np.ndarray, offsets: np.ndarray):
        """Step matrices and forward and backward vectors of all words of all texts."""
        matrices = np.tile(np.exp(self.moves), (len(score), 1, 1))
        first = offsets[:-1][np.diff(offsets) > 0]
        matrices[first] = np.exp(self.start)[None, None, :]  # both rows equal: nothing passes from the text before
        matrices[:, :, 1] *= np.exp(score)[:, None]
        forward = chain(matrices)
        back = np.broadcast_to(np.eye(2), matrices.shape).copy()
        back[1:] = matrices[:0:-1].transpose(0, 2, 1)
        return matrices, forward, chain(back)[::-1]

    def marginals(self, score: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability that each word is toxic, given its whole text."""
        out = np.zeros(len(score))
        for a, b in spans_of_texts(offsets):
            words = slice(offsets[a], offsets[b])
            _, forward, backward = self.messages(score[words], offsets[a : b + 1] - offsets[a])
            both = forward * backward
            out[words] = both[:, 1] / both.sum(1)
        return out


def fit_chain(words: Words, tags: np.ndarray) -> Chain:
    """Gradient ascent (Adam) on the conditional log likelihood of ``tags``."""
    flat, owner = feature_table(words.distinct.to_pylist())
    n = len(words.distinct)
    toxic_words = np.bincount(words.codes, tags, n)
    rate = (tags.sum() + 1) / (len(tags) + 2)
    model = Chain(np.zeros(1 << BITS), float(np.log(rate / (1 - rate))), np.zeros((2, 2)), np.zeros(2))
    first = words.offsets[:-1][np.diff(words.offsets) > 0]
    inner = np.ones(len(tags), bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    parts = list(spans_of_texts(words.offsets))
    seen = np.bincount(2 * tags[at - 1] + tags[at], minlength=4).reshape(2, 2).astype(float)
    seen_first = np.bincount(tags[first], minlength=2).astype(float)
    state = [np.concatenate([model.weights, [model.bias], model.moves.ravel(), model.start])]
    speed = np.zeros_like(state[0])
    force = np.zeros_like(state[0])
    for step in range(1, STEPS + 1):
        v = state[0]
        model = Chain(v[: 1 << BITS], float(v[1 << BITS]), v[-6:-2].reshape(2, 2), v[-2:])
        emission = model.emissions(flat, owner, n)
        p, pairs = np.zeros(len(tags)), np.zeros((2, 2))
        for a, b in parts:
            own = slice(words.offsets[a], words.offsets[b])
            matrices, forward, backward = model.messages(emission[words.codes[own]], words.offsets[a : b + 1] - own.start)
            both = forward * backward
            p[own] = both[:, 1] / both.sum(1)
            later = np.flatnonzero(inner[own])
            pair = forward[later - 1][:, :, None] * matrices[later] * backward[later][:, None, :]
            pairs += (pair / pair.sum((1, 2))[:, None, None]).sum(0)
        missing = toxic_words - np.bincount(words.codes, p, n)
        gradient = np.concatenate(
            [
                np.bincount(flat, missing[owner], 1 << BITS) - RIDGE * v[: 1 << BITS],
                [missing.sum()],
                (seen - pairs).ravel(),
                seen_first - np.array([(1 - p[first]).sum(), p[first].sum()]),
            ]
        )
        speed = 0.9 * speed + 0.1 * gradient
        force = 0.99 * force + 0.01 * gradient**2
        state[0] = v + 0.4 * (speed / (1 - 0.9**step)) / (np.sqrt(force / (1 - 0.99**step)) + 1e-6)
    v = state[0]
    return Chain(v[: 1 << BITS], float(v[1 << BITS]), v[-6:-2].reshape(2, 2), v[-2:])


def evidence(marginals: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text: 1, log of the expected toxic words, logits of the two highest marginals."""
    counts = np.diff(offsets)
    order = np.lexsort((marginals, np.repeat(np.arange(len(counts)), counts)))
    tops = []
    for rank in (1, 2):
        top = np.zeros(len(counts))
        top[counts >= rank] = marginals[order[offsets[1:][counts >= rank] - rank]]
        top = np.clip(top, 1e-6, 1 - 1e-6)
        tops.append(np.log(top / (1 - top)))
    expected = np.maximum(totals(marginals, offsets), 0)
    return np.column_stack([np.ones(len(counts)), np.log(expected + 1e-2), *tops])


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(25):
        p = logistic(x @ beta)
        slope = x.T @ (y - p) - 0.1 * beta
        curve = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(beta))
        beta = beta + np.linalg.solve(curve, slope)
    return beta


def toxic_features(words: Words, toxic: np.ndarray) -> np.ndarray:
    """Which hashed features stand in toxic documents far more often than in clean ones."""
    flat, owner = feature_table(words.distinct.to_pylist())
    order = np.argsort(owner, kind="stable")
    begin = np.searchsorted(owner[order], np.arange(len(words.distinct) + 1))
    counts = np.zeros((2, 1 << BITS))
    for k in range(len(toxic)):
        own = np.unique(words.codes[words.offsets[k] : words.offsets[k + 1]])
        mine = np.unique(np.concatenate([flat[begin[w] : begin[w + 1]] for w in own.tolist()] or [flat[:0]]))
        counts[int(toxic[k]), mine] += 1
    clean, bad = counts
    share = toxic.mean()
    seen = np.maximum(clean + bad, 1)
    with np.errstate(divide="ignore", invalid="ignore"):  # 0 log 0 counts as 0
        deviance = np.nan_to_num(bad * np.log(bad / (seen * share))) + np.nan_to_num(clean * np.log(clean / (seen * (1 - share))))
    surprise = np.sqrt(np.maximum(2 * deviance, 0))
    precision = (bad / toxic.sum()) / (bad / toxic.sum() + (clean + 0.1) / (~toxic).sum())
    return (bad >= 3) & (surprise >= SURPRISE) & (precision >= PRECISION)


def first_of_copies(words: Words, shingle: int = 5) -> np.ndarray:
    """Documents that share none of three smallest word-shingle values with one before."""
    keep, seen = [], [set(), set(), set()]
    plain_codes = words.codes.astype(np.uint64)
    for k in range(len(words.offsets) - 1):
        own = plain_codes[words.offsets[k] : words.offsets[k + 1]]
        if len(own) < shingle:
            keep.append(len(own) > 0)
            continue
        least = []
        for which in range(3):
            value = np.zeros(len(own) - shingle + 1, np.uint64)
            for j in range(shingle):
                value = (value ^ own[j : j + len(value)]) * np.uint64(0x9E3779B97F4A7C15 + 2 * which)
                value ^= value >> np.uint64(29)
            least.append(int(value.min()))
        keep.append(not any(x in s for x, s in zip(least, seen)))
        for x, s in zip(least, seen):
            s.add(x)
    return np.array(keep, bool)


def chosen_words(words: Words, chosen: np.ndarray, tags: np.ndarray) -> tuple[Words, np.ndarray]:
    """The words and tags of some documents, with distinct words of their own."""
    begin, counts = words.offsets[chosen], words.counts[chosen]
    distinct, codes = np.unique(gather(words.codes, begin, counts), return_inverse=True)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    return Words(codes, offsets, words.distinct.take(pa.array(distinct))), gather(tags, begin, counts)


@dataclass
class Model:
    chain: Chain
    curve: np.ndarray


def fit(sample: list[tuple[str, bool]]) -> Model | None:
    """The model of a bounded list of texts and labels; None without both labels."""
    words = word_table(pa.array([t for t, _ in sample], pa.string()))
    keep = first_of_copies(words) if sample else np.zeros(0, bool)
    toxic = np.array([y for _, y in sample], bool)
    if not (toxic & keep).any() or not (~toxic & keep).any():
        return None
    words = word_table(pa.array([t for (t, _), k in zip(sample, keep) if k], pa.string()))
    toxic = toxic[keep]
    marked = toxic_features(words, toxic)
    flat, owner = feature_table(words.distinct.to_pylist())
    bad_word = np.bincount(owner, marked[flat], len(words.distinct)) > 0
    suspect = bad_word[words.codes]
    # The chain learns from the toxic documents, the clean ones with suspect words, and as many others.
    holds = totals(suspect, words.offsets) > 0
    others = np.flatnonzero(~toxic & ~holds)[: int(toxic.sum())]
    chosen = np.union1d(np.flatnonzero(toxic | holds), others)
    fitted = fit_chain(*chosen_words(words, chosen, (suspect & toxic[words.owner]).astype(np.int64)))
    score = fitted.emissions(flat, owner, len(words.distinct))[words.codes]
    curve = fit_curve(evidence(fitted.marginals(score, words.offsets), words.offsets), toxic.astype(float))
    return Model(fitted, curve)


def held_out(doc_id: Column) -> Column:
    """The fold that fitting never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame) -> list[tuple[str, bool]]:
    """Up to ``SAMPLE`` documents of each label, by a hash of their id."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    known = known.where(~held_out(F.col("doc_id")))
    fitting = docs.select("doc_id", "text").where(F.octet_length("text").between(1, SAMPLE_BYTES))
    out: list[tuple[str, bool]] = []
    for label in (True, False):
        order = (F.xxhash64("doc_id"), "doc_id")
        ids = known.where(F.col("toxic") == label).orderBy(*order).limit(SAMPLE).select("doc_id")
        one = fitting.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("of"))
        rows = one.select("doc_id", "of.text").toArrow()
        out += [(text, label) for _, text in sorted(zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()))]
    return out


SCHEMA = "doc_id long, score double, toxic_words double, spans array<struct<start:int,stop:int>>"


def spans_of(text: str, bad: np.ndarray) -> list[dict[str, int]]:
    """Character ranges of runs of offending words."""
    out: list[dict[str, int]] = []
    last = -2
    for k, m in enumerate(WORD.finditer(text)):
        if bad[k]:
            if last == k - 1:
                out[-1]["stop"] = m.end()
            else:
                out.append({"start": m.start(), "stop": m.end()})
            last = k
    return out


def score_toxicity(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``doc_id, score, toxic_words, spans`` (character ranges), then ``keep`` columns."""
    names = ["doc_id", "text"]
    kept = [F.col(c).alias(f"keep_{k}") for k, c in enumerate(keep)]
    kept_schema = "".join(f", keep_{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(keep))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                array = texts(part)
                words = word_table(array)
                n = len(words.offsets) - 1
                score, p = np.zeros(n), np.zeros(len(words.codes))
                if model:
                    flat, owner = feature_table(words.distinct.to_pylist())
                    p = model.chain.marginals(model.chain.emissions(flat, owner, len(words.distinct))[words.codes], words.offsets)
                    score = logistic(evidence(p, words.offsets) @ model.curve)
                bad = p > 0.5
                hit = totals(bad, words.offsets) > 0
                spans = [
                    spans_of(array[k].as_py(), bad[words.offsets[k] : words.offsets[k + 1]]) if hit[k] else [] for k in range(n)
                ]
                span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
                columns = {
                    "doc_id": part.column("doc_id").cast(pa.int64()),
                    "score": pa.array(score),
                    "toxic_words": pa.array(totals(p, words.offsets)),
                    "spans": pa.array(spans, span),
                }
                columns |= {f"keep_{k}": part.column(f"keep_{k}") for k in range(len(keep))}
                yield pa.RecordBatch.from_pydict(columns)

    scored = docs.select(*names, *kept).mapInArrow(run, SCHEMA + kept_schema)
    return scored.select(
        "doc_id", "score", "toxic_words", "spans", *[F.col(f"keep_{k}").alias(c) for k, c in enumerate(keep) if c != "doc_id"]
    )


def toxicity(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Fit on the labelled rows outside the held-out fold, score every document."""
    return score_toxicity(docs, fit(training_sample(docs, labels)), keep)
