"""Benchmark items of mixed lengths and forms."""

import random

import numpy as np
import pytest

from kredenz.llm.decontaminate import Block, edits_allowed, leaks, symbols
from tests.llm.fixtures import documents, words
from tests.llm.test_search import edited


@pytest.mark.parametrize("length", [20, 150, 300])
def test_candidates_reach_recall_at_each_length(length):
    dice = random.Random(5)
    items = [words(dice, 20) for _ in range(180)] + [words(dice, n) for n in [150] * 10 + [300] * 10]
    block = Block([(k, " ".join(t)) for k, t in enumerate(items)], 0.8, 0.99, 5)
    own = [t for t in items if len(t) == length]
    found, trials = 0, 200
    for n in range(trials):
        item = own[n % len(own)]
        text = symbols(edited(dice, item, edits_allowed(length, 0.8)))
        number = next(k for k, t in enumerate(block.words.texts) if t.tolist() == symbols(item).tolist())
        found += any(k == number for _, k in block.words.candidates(text, np.full(len(text), len(text))))
    assert found >= 0.95 * trials


def test_spaces_of_other_kinds_and_short_items(spark):
    dice = random.Random(6)
    body = words(dice, 13)
    wide = " ".join(body[:6]) + "\u00a0? " + " ".join(body[6:]) + "\u3000!"
    bench = [(1, wide), (2, "Red fox"), (3, "法国的首都是哪里？"), (4, "เมืองหลวง"), (5, None), (6, " "), (7, "red  FOX!"), (8, "東京 大阪")]
    texts = [
        " ".join(words(dice, 20)) + " " + wide + " tail",
        "a red, fox; and a Red Fox",
        "red",
        "fox red",
        "问：法国的首都是哪里？答：巴黎",
        "x นี่คือเมืองหลวงของเรา",
        "法国的首都",
        "a 東京\n大阪 b",
        None,
        "",
        "the red",
        "fox",
    ]
    rows = [(k, t, None, None, 0, 0.0, "") for k, t in enumerate(texts)]
    got = leaks(documents(spark, rows), spark.createDataFrame(bench, "item_id long, text string")).collect()
    places = sorted((r.doc_id, r.item_id, r.first_word, r.n_words, r.distance) for r in got)
    assert places == [(0, 1, 20, 13, 0), (1, 2, 1, 2, 0), (1, 7, 1, 2, 0), (4, 3, 0, 1, 0), (5, 4, 1, 1, 0), (7, 8, 1, 2, 0)]
