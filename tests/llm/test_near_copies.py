"""The pipeline's near-duplicate stage against Jaccard similarity of all pairs."""

import random
from collections import Counter

import corpus_pipeline
import kredenz.llm.near_copies as near_copies_module
from kredenz.llm.near_copies import BANDS, ROWS, shingle_sets, sketches
from kredenz.llm.simhash import Forest
from tests.llm.fixtures import awkward_documents, documents, words


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def alike(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9


def wanted(rows):
    """Kept ``doc_id, text`` where no two rows of a group tie."""
    sets = [shingles(r[1]) for r in rows]
    forest = Forest(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                forest.join(i, j)
    best = {}
    for k, r in enumerate(rows):
        best.setdefault(forest.root(k), []).append((r[0] is None, r[0] or 0))
    return Counter(None if none else i for none, i in map(min, best.values()))


def near_copies(seed, groups=40):
    dice = random.Random(seed)
    out = []
    for _ in range(groups):
        text = words(dice, dice.randint(60, 250))
        for _ in range(dice.randint(1, 5)):
            out.append(" ".join(text))
            text = list(text)
            for _ in range(dice.randint(1, max(1, len(text) // 40))):  # chains: each is like the one before
                text[dice.randrange(len(text))] = "changed"
    dice.shuffle(out)
    return [(k, t, "en", "s", len(t), 0.5, "n") for k, t in enumerate(out)]


def test_stage_keeps_one_of_each_group_at_similarity_0_8(spark):
    for rows in (near_copies(1), awkward_documents()):
        got = corpus_pipeline.drop_near_copies(spark, documents(spark, rows), "").collect()
        assert Counter(r.doc_id for r in got) == wanted(rows)


def test_large_group_and_its_neighbours(spark):
    dice = random.Random(4)
    base = words(dice, 200)
    rows = []
    for k in range(400):
        text = list(base)
        for _ in range(k % 12):
            text[dice.randrange(200)] = f"w{dice.randrange(10**6)}"
        rows.append((k, " ".join(text), "en", "s", 0, 0.5, "n"))
    got = corpus_pipeline.drop_near_copies(spark, documents(spark, rows), "").collect()
    assert Counter(r.doc_id for r in got) == wanted(rows)


def test_a_passage_that_texts_have_in_common_makes_no_pairs(spark, monkeypatch):
    """Pairs verified stay in proportion to the rows, whether texts share a long passage or are edits of one text."""
    made = []
    check = near_copies_module.verified
    monkeypatch.setattr(near_copies_module, "verified", lambda pairs, *rest: made.append(pairs.count()) or check(pairs, *rest))
    dice = random.Random(6)
    passage, base = words(dice, 60), words(dice, 140)
    rows = [(k, " ".join(words(dice, 15) + passage + words(dice, 15)), "en", "s", 0, 0.5, "n") for k in range(2_000)]
    for k in range(600):
        text = list(base)
        for at in dice.sample(range(140), k % 9):
            text[at] = f"edit{dice.randrange(10**6)}"
        rows.append((5_000 + k, " ".join(text), "en", "s", 0, 0.5, "n"))
    got = corpus_pipeline.drop_near_copies(spark, documents(spark, rows), "").collect()
    assert Counter(r.doc_id for r in got if r.doc_id >= 5_000) == wanted(rows[2_000:])
    assert sum(r.doc_id < 5_000 for r in got) == 2_000
    assert sum(made) < 10 * len(rows)


def test_rows_are_picked_alike_by_broadcast_and_by_join(spark, monkeypatch):
    rows = spark.range(0, 3_000, 1, 7).selectExpr("id * 7919 % 100003 + (id % 5) * (1L << 33) AS _row", "cast(id AS string) AS text")
    picked = rows.where("_row % 3 = 0").select("_row")
    want = sorted(map(tuple, rows.where("_row % 3 = 0").collect()))
    for most in (1 << 18, 0):
        monkeypatch.setattr(near_copies_module, "MASKS", most)
        assert sorted(map(tuple, near_copies_module.chosen(rows, picked).collect())) == want
    assert near_copies_module.chosen(rows, picked.limit(0)).count() == 0


def test_null_and_repeated_ids(spark):
    dice = random.Random(7)
    a, b, c, d = (" ".join(words(dice, 80)) for _ in range(4))
    rows = [(1, a), (1, b), (1, a), (None, b), (None, c), (None, c), (2, c), (None, d), (None, d), (3, None), (None, "")]
    rows = [(i, t, "en", "s", 0, 0.5, "n") for i, t in rows]
    for _ in range(2):
        got = corpus_pipeline.drop_near_copies(spark, documents(spark, rows), "").collect()
        assert Counter((r.doc_id, r.text) for r in got) == Counter([(1, a), (1, b), (2, c), (None, d), (3, None)])


def test_buckets_reach_recall():
    import pyarrow as pa

    dice, found, total = random.Random(9), 0, 0
    assert 1 - (1 - 0.8**ROWS) ** BANDS > 0.999
    pairs = []
    for _ in range(600):
        one = words(dice, 240)
        two = list(one)
        for _ in range(5):
            two[dice.randrange(240)] = "changed"
        a, b = shingles(" ".join(one)), shingles(" ".join(two))
        if 0.8 <= len(a & b) / len(a | b) < 0.85:
            pairs += [" ".join(one), " ".join(two)]
    _, buckets = sketches(*shingle_sets(pa.array(pairs), 5))
    for k in range(0, len(pairs), 2):
        total += 1
        found += bool((buckets[k] == buckets[k + 1]).any())
    assert total >= 100 and found >= 0.995 * total


def test_prints_are_majorities_of_the_sets_bits(monkeypatch):
    import numpy as np
    import pyarrow as pa

    dice = random.Random(3)
    values, offsets = shingle_sets(pa.array([" ".join(words(dice, n)) for n in (0, 3, 90, 400, 1)]), 5)
    want = [
        sum(1 << b for b in range(64) if 2 * sum(int(v) >> b & 1 for v in values[x:y]) > y - x) for x, y in zip(offsets, offsets[1:])
    ]
    for chunk in (65_536, 7):
        monkeypatch.setattr(near_copies_module, "CHUNK", chunk)
        assert near_copies_module.prints(values, offsets).astype(np.uint64).tolist() == want


def test_tries_of_fingerprints_find_the_groups(spark, monkeypatch):
    """What operator 7's join finds is enough, without the steps for the rest; buckets too crowded for it take those."""
    rows = near_copies(2)
    docs = documents(spark, rows)
    walked, join = [], near_copies_module.joined
    with monkeypatch.context() as patch:
        patch.setattr(near_copies_module, "joined", lambda *a: walked.append(a[1:]) or join(*a))
        patch.setattr(near_copies_module, "met", lambda *_: spark.createDataFrame([], "u long, v long"))
        got = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert walked == [(near_copies_module.NEAR, 0)]
    missed = Counter(r.doc_id for r in got) - wanted(rows)
    assert not wanted(rows) - Counter(r.doc_id for r in got) and sum(missed.values()) <= 0.02 * len(rows)
    monkeypatch.setattr(near_copies_module, "CROWD", 2)
    got = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert Counter(r.doc_id for r in got) == wanted(rows)
