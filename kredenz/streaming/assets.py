"""Chunked uploads on a stream: chunks become pieces of files, block by block.

Each micro-batch is dealt out by ``(path, block of seq)`` and its chunks are joined to one piece for each
block, cut where an upload completes or a path is deleted. Pieces are committed to a log at once, so
no task ever holds more than the chunks of one block and micro-batch, and no payload is kept
as state. A file is there as soon as the batch of its completing chunk is committed: pieces are
chunks of a coarser log, which ``asset_assemble`` reads like any other.

The chunks of a path must arrive in order of ``seq`` from micro-batch to micro-batch; inside one they may
stand in any order. A row with ``deleted`` removes the path's file and its unfinished
upload; the column may be missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import DataStreamWriter

from kredenz.operators.assets import asset_assemble, asset_pending, block_of, upload_bounds
from kredenz.streaming.log import BatchLog


def pieces(chunks: DataFrame) -> DataFrame:
    """Chunks of one block and upload as one: ``path, block, mime_type, first, seq, n, complete, deleted, chunk``.

    ``seq`` is that of the last chunk, whose ``mime_type`` the piece has.
    """
    if "deleted" not in chunks.columns:
        chunks = chunks.withColumn("deleted", F.lit(False))
    before = Window.partitionBy("path", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ends = (F.col("complete") | F.col("deleted")).cast("int")
    rows = chunks.withColumn("deleted", F.coalesce("deleted", F.lit(False))).withColumn("block", block_of("seq"))
    cut = rows.withColumn("part", F.coalesce(F.sum(ends).over(before), F.lit(0)))
    return cut.groupBy("path", "block", "part").agg(
        F.max_by("mime_type", "seq").alias("mime_type"),
        F.min("seq").alias("first"),
        F.max("seq").alias("seq"),
        F.count(F.when(~F.col("deleted"), 1)).alias("n"),
        F.bool_or("complete").alias("complete"),
        F.bool_or("deleted").alias("deleted"),
        F.expr("listagg(CASE WHEN NOT deleted THEN chunk END) WITHIN GROUP (ORDER BY seq)").alias("chunk"),
    ).drop("part")


def asset_stream(chunks: DataFrame, target: str, writer: str = "main") -> DataStreamWriter:
    """Commit the pieces of each micro-batch to the log at ``target``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        BatchLog(batch.sparkSession, target).write(pieces(batch), writer, batch_id)

    return chunks.writeStream.foreachBatch(write)


def read_assets(spark: SparkSession, target: str) -> DataFrame:
    """The file each path shows now: ``path, mime_type, n_chunks, content``."""
    return asset_assemble(BatchLog(spark, target).read())


def read_pending(spark: SparkSession, target: str) -> DataFrame:
    """Unfinished uploads now: ``path, n_chunks``."""
    return asset_pending(BatchLog(spark, target).read())


def needed(log: DataFrame) -> DataFrame:
    """The pieces of each path's last completed upload and of its unfinished one."""
    bounds = upload_bounds(log)
    start = F.when(F.col("removed"), F.col("done")).otherwise(F.col("prior"))
    bounds = bounds.select("path", start.alias("start"))
    blocks = log.select("path", "block").distinct().join(bounds, "path", "left")
    kept = log.join(blocks, ["path", "block"]).where("start IS NULL OR seq > start")
    return kept.select(*log.columns)


def compact_assets(spark: SparkSession, target: str) -> bool:
    """Drop pieces of replaced and deleted files from the log; readers are not disturbed."""
    return BatchLog(spark, target).compact(needed)
