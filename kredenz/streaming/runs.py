"""Running a streaming query over what has arrived."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep keyed state in RocksDB; the session's own setting returns after."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def drain(spark: SparkSession, writer: DataStreamWriter, checkpoint: str) -> None:
    """Process everything that has arrived, then stop; the checkpoint keeps state."""
    with rocksdb(spark):
        query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()


def to_files(rows: DataFrame, target: str) -> DataStreamWriter:
    return rows.writeStream.format("parquet").outputMode("append").option("path", target)
