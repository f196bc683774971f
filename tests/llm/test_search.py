import math
import random
from collections import Counter

import numpy as np
import pytest

from kredenz.llm.decontaminate import edit_distance, edits_allowed, leaks, symbols
from kredenz.llm.neighbours import nearest
from kredenz.llm.queries import URL_RULES
from kredenz.llm.url_filter import judge_urls
from tests.llm.fixtures import documents, words


def edited(dice, item, edits):
    item = list(item)
    for _ in range(edits):
        k = dice.randrange(len(item))
        how = dice.randrange(3)
        item[k : k + (how != 1)] = [f"new{dice.randrange(999)}"] if how != 2 else []
    return item


def full_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return row


def test_edit_distance_with_free_end():
    dice = random.Random(3)
    for _ in range(300):
        a = [dice.choice("abcd") for _ in range(dice.randint(1, 12))]
        b = [dice.choice("abcd") for _ in range(dice.randint(0, 16))]
        most = dice.randint(0, 5)
        got, least = edit_distance(a, b, most), min(full_distance(a, b))
        assert (got is None and least > most) or got[0] == least


def test_planted_passages_are_found_and_others_are_not(spark):
    dice = random.Random(2)
    items = [words(dice, dice.randint(10, 50)) for _ in range(40)]
    bench = [(k, " ".join(t)) for k, t in enumerate(items)] + [(900, None), (901, ""), (902, "too short"), (903, " ".join(items[0]))]
    rows, planted = [], {}
    for n in range(300):
        k = n % 40
        most = edits_allowed(len(items[k]), 0.8)
        body = edited(dice, items[k], dice.randint(0, most)) if n % 3 else [f"«{w.upper()}»," for w in items[k]]
        if n % 5:
            planted[n] = k
            body = words(dice, dice.randint(0, 80)) + body + words(dice, dice.randint(0, 80))
        else:
            body = words(dice, 150)
        rows.append((n, " \n".join(body), None, None, 0, 0.0, ""))
    rows += [(1000, None, None, None, 0, 0.0, ""), (1001, "", None, None, 0, 0.0, ""), (1002, "x", None, None, 0, 0.0, "")]
    got = leaks(documents(spark, rows), spark.createDataFrame(bench, "item_id long, text string")).collect()
    texts = {r[0]: symbols((r[1] or "").split()).tolist() for r in rows}
    for r in got:
        item = symbols(items[r.item_id % 903]).tolist()
        piece = texts[r.doc_id][r.first_word : r.first_word + r.n_words]
        assert full_distance(item, piece)[-1] == r.distance <= edits_allowed(len(item), 0.8)
        assert r.similarity == pytest.approx(1 - r.distance / len(item))
    found = {(r.doc_id, r.item_id) for r in got if r.item_id < 900}
    assert {d for d, _ in found} <= set(planted)
    assert len(found & set(planted.items())) >= 0.98 * len(planted)
    assert {r.doc_id for r in got if r.item_id == 0} == {r.doc_id for r in got if r.item_id == 903}


def test_leaks_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert leaks(documents(spark), none).count() == 0
    assert leaks(documents(spark, []), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


def brute(rows, every, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, x in ok:
        if q % every == 0:
            scores = [
                (-float((x * y).sum() / (math.sqrt((x * x).sum()) * math.sqrt((y * y).sum()))), i) for i, y in ok if i != q and len(y) == len(x)
            ]
            out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def test_nearest_reaches_recall(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    want = brute(rows, 50, 5)
    got = {}
    for r in nearest(table).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hits += len({i for _, i, _ in found} & {i for i, _ in want[q]})
    assert hits >= 0.9 * 5 * len(want)


def test_probes_name_every_code_within_the_radius():
    from kredenz.llm.neighbours import Coder, Index

    dice = np.random.default_rng(6)
    middle = dice.normal(size=(12, 16))
    x = middle[dice.integers(0, 12, 900)] + 0.25 * dice.normal(size=(900, 16))
    coder = Coder(x, 5, 0.95)
    index = Index(np.arange(900), x, coder, 5)
    shares = []
    for code in index.codes[::30]:
        far = np.bitwise_count(index.codes ^ code).sum(1)
        for radius in (0, 3, coder.radius):
            assert np.array_equal(index.within(code, radius), np.flatnonzero(far <= radius))
        shares.append(len(index.probed(code, coder.radius)) / 900)
    assert np.mean(shares) < 0.5  # vectors with structure: probes leave most rows out


def test_nearest_over_many_shards(spark, monkeypatch):
    from kredenz.llm import neighbours

    monkeypatch.setattr(neighbours, "SHARD_ROWS", (50, 100))
    dice = np.random.default_rng(7)
    rows = [(k, v.tolist()) for k, v in enumerate(dice.normal(size=(700, 6)))]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), recall=1.0).collect()
    want = brute(rows, 50, 5)
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert {q: [i for _, i in sorted(f)] for q, f in found.items()} == {q: [i for i, _ in w] for q, w in want.items()}


def test_nearest_with_copies_ties_and_unusable_vectors(spark):
    dice = random.Random(1)
    rows = [(k, [dice.gauss(0, 1) for _ in range(8)]) for k in range(1, 40)]
    hot = [1.0] * 8
    rows += [(k, hot) for k in range(100, 160)] + [(0, [2.0] * 8)]
    rows += [(50, None), (200, [0.0] * 8), (250, [None, 1.0] + [0.0] * 6), (300, [float("nan")] * 8), (350, [float("inf")] * 8)]
    rows += [(400, [1.0, 2.0]), (None, hot), (103, hot)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", __import__("pyspark").sql.functions.lit(1)).repartition(4)
    got = {}
    for r in nearest(table).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {0, 100, 150}
    assert [i for _, i, _ in sorted(got[0])] == [100, 101, 102, 103, 104]
    assert [i for _, i, _ in sorted(got[100])] == [0, 101, 102, 103, 104]
    assert nearest(table.where("vec_id < 0")).count() == 0
    assert nearest(table.where("vec_id = 100")).count() == 0
    assert [(r.query_id, r.vec_id) for r in nearest(table.where("vec_id in (100, 7)")).collect()] == [(100, 7)]


def test_url_rules_and_aliases(spark):
    link = '<head><link href="{}" rel="canonical"></head>'
    pages = [
        (1, "https://a.example.net/en/x", None),
        (2, "https://a.example.net/de/x", ""),
        (3, "http://example.com/de/1?x=1", link.format("https://plain.info/a/")),
        (4, "https://www.plain.info/a.html#top", "<p>"),
        (5, "https://m.plain.info/b?utm_source=q", '<META http-equiv=refresh content="0; URL=//plain.info/a">'),
        (6, "http://x.org/fr/1", link.format("http://plain.info/b")),
        (7, "http://x.org/de/1", link.format("/other")),
        (8, None, link.format("http://plain.info/b")),
        (9, "no scheme", link.format("http://plain.info/b")),
        (10, "http://EXAMPLE.NET", None),
        (11, "http://notexample.net/en/", None),
        (11, "http://notexample.net/en/", None),
        (12, "http://plain.info/a?page=2", None),
    ]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("node", __import__("pyspark").sql.functions.lit(1))
    got = sorted(tuple(r) for r in judge_urls(table, URL_RULES).collect())
    assert got == sorted(
        [
            (1, "a.example.net", "/en/x", "example.net/en/", "allow"),
            (2, "a.example.net", "/de/x", "net/", "block"),
            (3, "example.com", "/de/1", "example.com/de/", "block"),
            (4, "www.plain.info", "/a.html", None, "block"),
            (5, "m.plain.info", "/b", None, "block"),
            (6, "x.org", "/fr/1", "org/fr/", "allow"),
            (7, "x.org", "/de/1", None, "allow"),
            (8, "", "", None, "allow"),
            (9, "", "", None, "allow"),
            (10, "example.net", "", None, "allow"),
            (11, "notexample.net", "/en/", "net/", "block"),
            (11, "notexample.net", "/en/", "net/", "block"),
            (12, "plain.info", "/a", None, "allow"),
        ],
        key=lambda r: r,
    )
    assert judge_urls(table.limit(0), URL_RULES).count() == 0
    assert {r.verdict for r in judge_urls(table, ()).collect()} == {"allow"}
