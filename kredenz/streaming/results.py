"""Stored results on a stream: latest per key, committed per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from kredenz.operators.results import result_upsert
from kredenz.streaming.log import BatchLog


def result_upsert_stream(results: DataFrame, target: str, writer: str = "main") -> DataStreamWriter:
    """Reduce each micro-batch to its latest rows and commit them to the log at ``target``.

    A batch that was cut off is not seen and is written again; a committed one is skipped.
    Readers settle batches against each other.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        BatchLog(batch.sparkSession, target).write(result_upsert(batch), writer, batch_id)

    return results.writeStream.foreachBatch(write)


def read_results(spark: SparkSession, target: str) -> DataFrame:
    """The latest row of each key among all committed batches."""
    return result_upsert(BatchLog(spark, target).read())


def compact_results(spark: SparkSession, target: str) -> bool:
    """Replace committed batches by their settled rows; readers are not disturbed."""
    return BatchLog(spark, target).compact(result_upsert)
