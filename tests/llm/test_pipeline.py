"""The pipeline against its stages' plain versions, and the catalog."""

from collections import Counter

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from kredenz.llm.queries import ORACLE, QUERIES, table, vocabulary
from tests.llm.fixtures import documents
from tests.llm.test_duplicates import plain_removal
from tests.llm.test_near_copies import wanted


def test_catalog():
    assert set(QUERIES) <= set(queries()) and set(ORACLE) <= set(oracle_sql())
    assert [f"op{n}_" for n in range(1, 14)] == [next(q for q in QUERIES if q.startswith(f"op{n}_")).split("_")[0] + "_" for n in range(1, 14)]


LABELLED = "/root/testdata/sf0.01"  # the smallest table with enough labels to learn from


def test_stages_keep_the_columns_and_do_their_work(spark, tmp_path):
    folder = LABELLED
    docs = table(spark, folder, "documents")
    names, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        path = str(tmp_path / name)
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        seen.append(name)
        if name != "packing":
            assert docs.columns == names
        ids = {r.doc_id: r for r in docs.collect()}
        old = before.collect()
        if name == "toxicity":
            labels = {r.doc_id: r.toxic for r in table(spark, folder, "labels").collect()}
            known = [(r.doc_id in ids, labels[r.doc_id]) for r in old if r.doc_id in labels]
            assert sum(kept != toxic for kept, toxic in known) >= 0.95 * len(known)
            assert sum(kept for kept, toxic in known if not toxic) >= 0.98 * sum(not t for _, t in known)
        elif name == "simhash":
            assert Counter(list(ids)) == wanted([(r.doc_id, r.text) for r in old])
        elif name == "substrings":
            want = plain_removal([(r.doc_id, r.text) for r in old])
            assert Counter(len((r.text or "").split()) for r in ids.values()) == Counter(n - gone for _, n, gone, _ in want.elements())
            assert all(r.n_chars == len(r.text) for r in ids.values())
        elif name == "decontamination":
            for item in table(spark, folder, "benchmark").collect():
                assert not any(item.text in r.text for r in ids.values())
            assert len(ids) >= 0.9 * len(old)
        else:
            assert {r.doc_id for r in old} == set(ids)
    assert seen == ["toxicity", "simhash", "substrings", "decontamination", "packing"]


def test_run_gives_the_last_stage(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns[:3] == ["doc_id", "start", "length"] and got.count() > 0


def test_stages_on_awkward_and_empty_tables(spark, folder, tmp_path):
    for k, rows in enumerate((None, [])):
        docs = documents(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{k}-{name}")
            stage(spark, docs, folder).write.parquet(path)
            docs = spark.read.parquet(path)
        assert (docs.count() > 0) == (k == 0)


def test_vocabulary_is_a_path():
    assert vocabulary("word_bpe_49k.json").endswith(".json")
