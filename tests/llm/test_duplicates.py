import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings, strategies as st
from xxhash import xxh64_intdigest

from kredenz.llm.components import components
from kredenz.llm.simhash import Forest, fingerprint, forest_links, linked, near_duplicates
from kredenz.llm.substrings import remove_repeats
from tests.llm.fixtures import awkward_documents, documents


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    runs = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    votes = [0] * 64
    for run in runs:
        h = xxh64_intdigest(run, 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(runs))


def plain_components(values, budget=2):
    forest = Forest(len(values))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= budget:
                forest.join(i, j)
    return [forest.root(i) for i in range(len(values))]


def test_fingerprints_equal_a_plain_count():
    for _, text, *_ in awkward_documents()[:30]:
        assert fingerprint(text) == plain_fingerprint(text)


def test_near_duplicates_equal_all_pairs(spark):
    rows = [r for r in awkward_documents() if len(r[1] or "") < 50_000]
    values = [plain_fingerprint(r[1]) for r in rows]
    root = plain_components(values)
    least = defaultdict(lambda: None)
    for r, k in zip(rows, root):
        if r[0] is not None:
            least[k] = r[0] if least[k] is None else min(least[k], r[0])
    want = Counter((r[0], f"{v:016x}", least[k]) for r, v, k in zip(rows, values, root))
    assert Counter(map(tuple, near_duplicates(documents(spark, rows)).collect())) == want


def clustered(dice, n):
    centres = [dice.getrandbits(64) for _ in range(max(1, n // 10))]
    out = set()
    while len(out) < n:
        x = dice.choice(centres)
        for _ in range(dice.randint(0, 5)):
            x ^= 1 << dice.randrange(64)
        out.add(x)
    return sorted(out)


def test_trie_walk_finds_every_link():
    for seed in range(20):
        values = clustered(random.Random(seed), 300)
        forest = Forest(len(values))
        for x, y in forest_links(np.array(values, np.uint64), None, 63, 2, 0):
            assert (values[x] ^ values[y]).bit_count() <= 2
            forest.join(x, y)
        assert [forest.root(k) for k in range(len(values))] == plain_components(values)


def test_walk_over_pairs_of_subtrees_finds_every_link(spark):
    values = clustered(random.Random(5), 400)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    table = spark.createDataFrame([(v,) for v in signed], "fp long")
    place = {v: k for k, v in enumerate(signed)}
    for depth in (0, 1, 5):
        forest = Forest(len(values))
        for r in linked(table, 2, depth).collect():
            forest.join(place[r.u], place[r.v])
        assert [forest.root(k) for k in range(len(values))] == plain_components(values)


def test_components_of_paths_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (200, None)]
    edges += [(300, 301), (301, 300), (300, 301)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {k: 1 for k in range(1, 41)} | {k: 100 for k in range(100, 160)} | {300: 300, 301: 300}
    assert got == want
    assert components(spark.createDataFrame([], "u string, v string")).count() == 0


def plain_removal(rows, window=13):
    first = {}
    texts = [(-1 if i is None else i, (t or "").encode().split()) for i, t, *_ in rows]
    for i, w in texts:
        for k in range(len(w) - window + 1):
            run = tuple(w[k : k + window])
            first[run] = min(first.get(run, i), i)
    out = []
    for i, w in texts:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((None if i == -1 else i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_removal_equals_a_plain_search(spark):
    rows = awkward_documents()
    got = remove_repeats(documents(spark, rows), with_text=False).collect()
    assert Counter(map(tuple, got)) == plain_removal(rows)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=40), min_size=1, max_size=8))
def test_removal_in_repetitive_texts(spark, texts):
    rows = [(k // 2 * 2, " ".join(t), "", "", 0, 0.0, "") for k, t in enumerate(texts)]
    got = remove_repeats(documents(spark, rows), window=5, with_text=False).collect()
    assert Counter(map(tuple, got)) == plain_removal(rows, 5)


def test_removal_over_many_groups(spark, monkeypatch):
    import kredenz.llm.substrings as module

    monkeypatch.setattr(module, "GROUP_BYTES", 20_000)
    rows = awkward_documents(4)
    got = remove_repeats(documents(spark, rows), keep=("score", "node"), with_text=True)
    assert got.columns == ["score", "node", "doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
    found = got.collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found) == plain_removal(rows)
    texts = {r[0]: r[1] for r in rows}
    assert all(r.kept_text == texts[r.doc_id] for r in found if not r.n_removed)


def test_empty_tables(spark):
    none = documents(spark, [])
    assert near_duplicates(none).count() == remove_repeats(none).count() == 0


def test_small_frontier_blocks_find_the_same_links(monkeypatch):
    import kredenz.llm.simhash as module

    monkeypatch.setattr(module, "FRONTIER", 50)
    values = clustered(random.Random(9), 500)
    forest = Forest(len(values))
    for x, y in forest_links(np.array(values, np.uint64), None, 63, 2, 0):
        forest.join(x, y)
    assert [forest.root(k) for k in range(len(values))] == plain_components(values)


def test_crowded_prefixes_are_split(spark, monkeypatch):
    """Values under few prefixes: no group is left large, and no link is lost."""
    import numpy as np

    from kredenz.llm import simhash

    dice = np.random.default_rng(5)
    shared = np.uint64(0xABCDE00000000000)
    values = (dice.integers(0, 1 << 26, 1_500, dtype=np.uint64) << np.uint64(18)) | shared
    near = values[:600] ^ (np.uint64(1) << dice.integers(0, 64, 600, dtype=np.uint64)) ^ (np.uint64(1) << dice.integers(0, 64, 600, dtype=np.uint64))
    values = np.unique(np.concatenate([values, near, dice.integers(0, 1 << 63, 200, dtype=np.uint64)]))
    monkeypatch.setattr(simhash, "SUBTREE", 40)
    sizes, join = [], simhash.joined
    monkeypatch.setattr(simhash, "joined", lambda rows, *rest: sizes.extend(r["count"] for r in rows.groupBy("p", "q").count().collect()) or join(rows, *rest))
    table = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    links = [(r.u, r.v) for r in simhash.linked(table, 2, 4).collect()]
    assert max(sizes) <= 2 * 40 and len(sizes) > 20
    signed = values.view(np.int64).tolist()
    place = {v: k for k, v in enumerate(signed)}
    got, want = simhash.Forest(len(values)), simhash.Forest(len(values))
    for u, v in links:
        assert (np.uint64(u & (2**64 - 1)) ^ np.uint64(v & (2**64 - 1))).item().bit_count() <= 2
        got.join(place[u], place[v])
    for k in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[k + 1 :] ^ values[k]) <= 2):
            want.join(k, k + 1 + int(j))
    assert [got.root(k) for k in range(len(values))] == [want.root(k) for k in range(len(values))]
