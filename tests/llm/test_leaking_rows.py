"""The pipeline's decontamination stage on rows with null and repeated ids."""

import random

import corpus_pipeline
from kredenz.llm.queries import table
from tests.llm.fixtures import documents, words


def test_each_row_is_judged_by_itself(spark, folder):
    dice = random.Random(3)
    item = table(spark, folder, "benchmark").first().text
    clean = [" ".join(words(dice, 60)) for _ in range(3)]
    rows = [(None, f"{clean[0]} {item}"), (None, clean[0]), (5, f"{item} {clean[1]}"), (5, clean[1]), (6, clean[2]), (6, clean[2]), (7, None), (None, None)]
    docs = documents(spark, [(i, t, "en", "s", 0, 0.5, "n") for i, t in rows])
    got = corpus_pipeline.drop_leaks(spark, docs, folder).collect()
    want = [(None, clean[0]), (5, clean[1]), (6, clean[2]), (6, clean[2]), (7, None), (None, None)]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got))) == sorted(map(repr, want))
