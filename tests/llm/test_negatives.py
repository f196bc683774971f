import math
import random

import numpy as np
import pytest

from kredenz.llm import negatives
from kredenz.llm.negatives import Best, Index, Layout, hard_negatives
from kredenz.llm.queries import ORACLE, op12_hard_negatives
from check_oracle import tables

SCHEMA = "vec_id long, label int, x array<double>, score long, id string, key string"


def plain(rows, every=100, positives=5, negatives=10, low=30, high=90):
    rows = sorted({(i, l, tuple(x)) for i, l, x in rows if i is not None and l is not None and x is not None})
    anchors = {}
    for r in rows:
        if r[0] % every == 0:
            anchors.setdefault(r[0], r)
    out = set()
    for i, label, x in anchors.values():
        scored = sorted({(-sum(int(a) * int(b) for a, b in zip(x, y)), j, m == label) for j, m, y in rows if j != i and len(y) == len(x)})
        for p, j, _ in [s for s in scored if s[2]][:positives]:
            fit = [(s, k) for s, k, same in scored if not same and low * -p <= 100 * -s <= high * -p][:negatives]
            out |= {(i, j, n + 1, k, -p, -s) for n, (s, k) in enumerate(fit)}
    return out


def vectors(dice, n, d, centres, spread):
    middle = dice.normal(size=(centres, d)) * 40
    return np.floor(middle[dice.integers(0, centres, n)] + dice.normal(size=(n, d)) * spread)


@pytest.mark.parametrize("d, centres, spread", [(6, 5, 4), (1, 1, 30), (3, 2, 0.6), (8, 40, 10)])
def test_all_rows_scanned(spark, monkeypatch, d, centres, spread):
    monkeypatch.setattr(negatives, "SHARD_ROWS", (60, 300))
    dice = np.random.default_rng(d)
    x = vectors(dice, 600, d, centres, spread)
    labels = dice.integers(0, 3, 600)
    rows = [(k, int(labels[k]), x[k].tolist()) for k in range(600)]
    rows += [(1000 + k, int(labels[7]), x[7].tolist()) for k in range(200)]  # one vector, a quarter of all rows
    rows += [rows[20], rows[20], (100, 2, x[3].tolist()), (None, 1, x[4].tolist()), (1300, None, x[4].tolist()), (1301, 1, None)]
    frame = spark.createDataFrame([(*r, 1, "id", "key") for r in rows], SCHEMA).repartition(6)
    got = hard_negatives(frame, every=50).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == plain(rows, every=50)


def test_given_vectors_and_sql(spark):
    for folder in ("/root/testdata/sf0.001", "/root/testdata/sf0.1"):
        want = tables(folder).execute(ORACLE["op12_hard_negatives"]).fetchall()
        assert sorted(map(tuple, op12_hard_negatives(spark, folder).collect())) == sorted(want)


def test_null_and_infinite_components(spark, tmp_path):
    dice = random.Random(4)
    rows = [(k, k % 4, [dice.uniform(-1, 1) for _ in range(4)]) for k in range(120)]
    rows += [(200, 1, None), (300, 1, [None, 0.1, 0.1, 0.1]), (400, 1, [math.nan] * 4), (500, 1, [math.inf, 0.0, 0.0, 0.0]), (600, None, [0.5] * 4), (700, 3, [0.0] * 4)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = tables(str(tmp_path)).execute(ORACLE["op12_hard_negatives"].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, op12_hard_negatives(spark, str(tmp_path)).collect())) == sorted(want)


@pytest.mark.parametrize("rows", [[], [(100, 1, [2.0])], [(100, 1, [2.0]), (101, 1, [3.0])], [(1, 1, [2.0]), (2, 2, [2.0])], [(0, 1, []), (1, 1, []), (2, 2, [])]])
def test_small_tables(spark, rows):
    got = hard_negatives(spark.createDataFrame(rows, "vec_id long, label int, x array<double>")).collect()
    assert {tuple(r) for r in got} == plain(rows)


def test_lengths_do_not_meet_and_huge_scores(spark):
    rows = [(0, 1, [3e9, 0.0]), (1, 1, [3e9, 5.0]), (2, 2, [2e9, 1.0]), (3, 2, [9e8, 1.0]), (100, 1, [4.0]), (101, 1, [6.0]), (102, 2, [4.0]), (103, 2, [7.0])]
    got = hard_negatives(spark.createDataFrame(rows, "vec_id long, label int, x array<double>")).collect()
    assert {tuple(r) for r in got} == plain(rows)


def test_cells_are_visited_by_bound_and_most_are_not_visited():
    import pyarrow as pa

    dice = np.random.default_rng(8)
    x = vectors(dice, 4_000, 8, 60, 2)
    books = tuple(negatives.centres(h, 30) for h in (x[:, :4], x[:, 4:]))
    layout = Layout(8, books, (np.zeros(30), np.zeros(30)), np.zeros(900, int), np.ones(900, int), 1)
    cell, _, _ = layout.cells(x)
    held = pa.table({"cell": cell, "label": np.arange(4_000) % 3, "x": x.tolist(), "ids": [[k] for k in range(4_000)]})
    index = Index(held, layout)
    scored = 0
    count = index.scores

    def counting(rows, q):
        nonlocal scored
        scored += len(rows)
        return count(rows, q)

    index.scores = counting
    for k in range(0, 4_000, 100):
        ups = [negatives.half_scores(h[k : k + 1], b[c], r)[1][0] for h, b, c, r in zip(layout.halves(x), books, index.codes, index.radii)]
        bounds = [b for b, _ in index.visits(tuple(ups))]
        assert bounds == sorted(bounds, reverse=True) and len(bounds) == len(index.codes[0]) * len(index.codes[1])
        best = Best(5, -np.inf, np.inf)
        index.search(x[k], tuple(ups), k, k % 3, True, [best])
        exact = sorted((-int(x[j] @ x[k]), j) for j in range(4_000) if j != k and j % 3 == k % 3)[:5]
        assert best.found == exact
    assert scored < 40 * 4_000 / 3 / 2
