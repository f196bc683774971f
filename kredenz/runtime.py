"""Session helpers: the shared scratch folder, pinned tables and total order.

Nothing here schedules or plans work; it wraps the few Spark calls the
operators share (``checkpoint``, ``repartitionByRange``, Parquet scratch
tables).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window

ROW_BITS = 33  # monotonically_increasing_id keeps the row index in the low 33 bits


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    That is ``spark.checkpoint.dir``; a session without it gets a folder of its own
    beside its tables, in ``spark.sql.warehouse.dir``, deleted when the session's
    process ends. The session's settings stay as they are.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch-{spark.sparkContext.applicationId}"
    _passing(spark, folder)
    return folder


def _passing(spark: SparkSession, folder: str) -> None:
    """Make a folder that is deleted when the session's process ends."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(context._jsc.hadoopConfiguration())
    if not store.exists(path) and store.mkdirs(path):
        store.deleteOnExit(path)


def pin(df: DataFrame) -> DataFrame:
    """Checkpoint ``df``: rows, partitions and row order are fixed from here on."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name under the shared folder; what is written there goes when the session's process ends."""
    folder = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _passing(spark, folder)
    return f"{folder}/rows"


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder that is not read any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def in_order(df: DataFrame, *order: Column | str) -> DataFrame:
    """Sort ``df`` globally and pin it, adding ``_block`` and ``_row``.

    Range partitioning on the full sort key spreads one hot leading key over
    many blocks. ``_block`` counts the blocks in sort order and ``_row`` the
    rows inside a block, both from 0.
    """
    tagged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_tag", F.monotonically_increasing_id())
    )
    return pin(tagged).select(
        *df.columns,
        F.shiftright("_tag", ROW_BITS).alias("_block"),
        F.col("_tag").bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("_row"),
    )


def with_position(df: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """Dense 0-based position in a total order, without a one-partition window.

    Blocks are counted first; each block's offset is the number of rows before
    it. The offset table has one row per shuffle partition, so its broadcast is
    bounded by the partition count and not by the data.
    """
    ordered = in_order(df, *order)
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ordered.groupBy("_block")
        .agg(F.count("*").alias("_rows"))
        .select("_block", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    )
    return ordered.join(F.broadcast(offsets), "_block").select(
        *df.columns, (F.col("_before") + F.col("_row")).alias(name)
    )


RANK_BITS = 16  # values in a block, and blocks in a span, of a whole-number order


def with_rank(df: DataFrame, order: str, name: str) -> DataFrame:
    """Dense 0-based rank by a whole-number column, in one plan. Rows that tie get neighbouring ranks in any order.

    Rows are numbered inside blocks of neighbouring values; a block starts after all
    rows of earlier blocks of its span and all earlier spans. Only the spans, one row
    for every 2**32 values in use, are summed up in one task.
    """
    block = F.shiftright(F.col(order).cast("bigint"), RANK_BITS)
    keyed = df.withColumn("_block", block)
    counts = keyed.groupBy("_block").agg(F.count("*").alias("_rows"))
    counts = counts.withColumn("_span", F.shiftright("_block", RANK_BITS))

    def before(*keys: str, by: str) -> Column:
        window = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_rows").over(window), F.lit(0))

    spans = counts.groupBy("_span").agg(F.sum("_rows").alias("_rows"))
    spans = spans.select("_span", before(by="_span").alias("_earlier"))
    starts = counts.select("_block", "_span", before("_span", by="_block").alias("_within"))
    starts = starts.join(spans, "_span").select("_block", (F.col("_earlier") + F.col("_within")).alias("_before"))
    row = F.row_number().over(Window.partitionBy("_block").orderBy(order))
    numbered = keyed.withColumn("_row", row).join(starts, "_block")
    return numbered.select(*df.columns, (F.col("_before") + F.col("_row") - 1).alias(name))
