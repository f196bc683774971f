"""From raw documents to packed sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``. All stages but the last return
the columns of ``documents``. Null ids, empty tables and repeated rows are handled as the
operators state; columns beyond those of ``documents`` are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kredenz.llm.decontaminate import leaks
from kredenz.llm.near_copies import first_of_near_copies
from kredenz.llm.packing import packed
from kredenz.llm.queries import table, vocabulary
from kredenz.llm.substrings import remove_repeats
from kredenz.llm.toxicity import toxicity
from kredenz.runtime import drop_scratch, scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half."""
    scored = toxicity(docs, table(spark, sf_dir, "labels"), keep=COLUMNS)
    return scored.where("score < 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of documents that share 0.8 of their five-word shingles: the smallest id, null ids last."""
    return first_of_near_copies(docs, COLUMNS, similarity=0.8, shingle=5)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat an earlier one; ``n_chars`` follows the text."""
    cut = remove_repeats(docs, keep=("doc_id", "lang", "source", "n_chars"))
    length = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", length.alias("n_chars"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; each row is judged by its own id and text, null ids too."""
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")
    found = leaks(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.withColumn("_key", key).join(found.withColumnRenamed("doc_id", "_key"), "_key", "left_anti").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, with their ids."""
    return packed(docs, vocabulary("word_bpe_49k.json"), 2048, 1)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("substrings", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack_sequences),
]

#: No stage but the third can be stated in SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written under the shared folder, and removed once the next is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = scratch_path(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_scratch(spark, before)
        before = path
    return docs
