"""Chunked uploads: assembling, listing, looking up and deleting files.

A chunk log has ``path, mime_type, seq, chunk, complete``; ``seq`` is unique
and gives the arrival order. A log may have a column ``deleted``: such a row removes the
path's file and its unfinished upload. A row may stand for ``n`` chunks that were joined
already. One path may own a large part of the log, so the
log is never grouped or joined on the path alone: it is cut into blocks of
``BLOCK`` consecutive ``seq`` values and joined on ``(path, block)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from kredenz.functions.text import size_label
from kredenz.runtime import with_rank

BLOCK_BITS = 12
BLOCK = 1 << BLOCK_BITS

# Refusals of a payload, and the least bytes of an image.
EMPTY_PAYLOAD = "No image data provided"
SMALL_PAYLOAD = "Data too small to be a valid image"
MINIMUM_BYTES = 100


def block_of(seq: Column | str) -> Column:
    return F.shiftright(seq, BLOCK_BITS)


def _chunks(rows: DataFrame) -> Column:
    """How many chunks the rows of a group stand for."""
    return F.sum("n") if "n" in rows.columns else F.count("*")


def upload_bounds(chunks: DataFrame) -> DataFrame:
    """Per path: ``done``, the seq at which its last upload completed or it was deleted last,
    ``prior``, the one before, whether it was ``removed`` at ``done``, and the MIME type named there.

    Only those rows matter and only two per path; Spark keeps two per path
    in every map task before it shuffles.
    """
    newest = Window.partitionBy("path").orderBy(F.desc("seq"))
    last = F.col("rank") == 1
    deleted = F.coalesce("deleted", F.lit(False)) if "deleted" in chunks.columns else F.lit(False)
    return (
        chunks.where(F.col("complete") | deleted)
        .select("path", "seq", "mime_type", deleted.alias("removed"), F.row_number().over(newest).alias("rank"))
        .where("rank <= 2")
        .groupBy("path")
        .agg(
            F.max(F.when(last, F.col("seq"))).alias("done"),
            F.max(F.when(~last, F.col("seq"))).alias("prior"),
            F.max(F.when(last, F.col("mime_type"))).alias("mime_type"),
            F.bool_or(last & F.col("removed")).alias("removed"),
        )
    )


def _with_bounds(chunks: DataFrame, bounds: DataFrame, how: str, keep: Column) -> DataFrame:
    """Join the log with its paths' bounds block by block.

    ``keep`` says which blocks of a path are needed, given the bounds. Only
    keys and flags are read to find the blocks; payloads of other blocks meet
    no partner.
    """
    blocks = chunks.select("path", block_of("seq").alias("block")).distinct()
    needed = blocks.join(bounds, "path", how).where(keep)
    log = chunks.drop("mime_type", "deleted").withColumn("block", block_of("seq"))
    return log.join(needed, ["path", "block"])


def _published(chunks: DataFrame, bounds: DataFrame) -> DataFrame:
    """The chunks of the last completed upload of every path in ``bounds``."""
    before_end = F.col("block") <= block_of(F.col("done"))
    after_start = F.col("prior").isNull() | (F.col("block") >= block_of(F.col("prior")))
    shown = bounds.where("NOT removed")
    return _with_bounds(chunks, shown, "inner", before_end & after_start).where(
        "seq <= done AND (prior IS NULL OR seq > prior)"
    )


def asset_assemble(
    chunks: DataFrame,
    carry_over: bool = False,
    only: DataFrame | None = None,
    without: DataFrame | None = None,
) -> DataFrame:
    """Published files: ``path, mime_type, n_chunks, content``.

    The last completed upload of a path wins and the completing chunk names the
    MIME type. By default an upload starts after the previous completing chunk;
    with ``carry_over`` it also inherits every earlier chunk that did not
    complete an upload. ``only`` and ``without`` are tables of paths to build or
    to leave out; they meet one row per path, before any content is read.
    """
    bounds = upload_bounds(chunks)
    if only is not None:
        bounds = only_keys(bounds, only, "path")
    if without is not None:
        bounds = delete_by_key(bounds, without, "path")
    if carry_over:
        early = F.col("block") <= block_of(F.col("done"))
        if "deleted" in chunks.columns:
            gone = chunks.where("deleted").groupBy("path").agg(F.max("seq").alias("gone"))
            bounds = bounds.join(gone, "path", "left")
        else:
            bounds = bounds.withColumn("gone", F.lit(None).cast("bigint"))
        rows = _with_bounds(chunks, bounds.where("NOT removed"), "inner", early).where(
            "(seq = done OR (seq < done AND NOT complete)) AND (gone IS NULL OR seq > gone)"
        )
    else:
        rows = _published(chunks, bounds)
    # The join has dealt rows out by path and block, so pieces are made where they are.
    pieces = rows.groupBy("path", "block", "mime_type").agg(
        _chunks(rows).alias("n"),
        F.expr("listagg(chunk) WITHIN GROUP (ORDER BY seq)").alias("piece"),
    )
    return pieces.groupBy("path", "mime_type").agg(
        F.sum("n").alias("n_chunks"),
        F.expr("listagg(piece) WITHIN GROUP (ORDER BY block)").alias("content"),
    )


def asset_pages(chunks: DataFrame) -> DataFrame:
    """Chunks of published files by their place: ``path, mime_type, chunk_index, chunk, next_index``.

    ``next_index`` is where a paged read goes on, null after the last chunk. A path's chunks are numbered
    inside their block, after the chunks of its earlier blocks; only block counts meet in one window.
    """
    rows = _published(chunks, upload_bounds(chunks))
    keys = rows.select("path", "block").groupBy("path", "block").agg(F.count("*").alias("_rows"))
    path = Window.partitionBy("path")
    earlier = path.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = keys.select(
        "path", "block", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"), F.sum("_rows").over(path).alias("_all")
    )
    place = F.row_number().over(Window.partitionBy("path", "block").orderBy("seq")) - 1
    index = (F.col("_before") + F.col("_place")).cast("bigint")
    placed = rows.withColumn("_place", place).join(starts, ["path", "block"])
    return placed.select("path", "mime_type", index.alias("chunk_index"), "chunk", F.when(index + 1 < F.col("_all"), index + 1).alias("next_index"))


def recognition_input(chunks: DataFrame) -> DataFrame:
    """What recognition is sent of each file: its first chunk, and whether that cuts the file off."""
    first = asset_pages(chunks).where("chunk_index = 0")
    return first.select("path", "mime_type", "chunk", F.col("next_index").isNotNull().alias("cut_off"))


def asset_pending(chunks: DataFrame, without: DataFrame | None = None) -> DataFrame:
    """Unfinished uploads: ``path, n_chunks`` after the last completing chunk.

    Deleting a path drops its unfinished upload as well: ``without`` is a table of paths.
    """
    if without is not None:
        chunks = delete_by_key(chunks, without, "path")
    unfinished = F.col("done").isNull() | (F.col("block") >= block_of(F.col("done")))
    return (
        _with_bounds(chunks, upload_bounds(chunks), "left", unfinished)
        .where("done IS NULL OR seq > done")
        .groupBy("path")
        .agg(_chunks(chunks).alias("n_chunks"))
    )


def asset_sizes(chunks: DataFrame) -> DataFrame:
    """``path, mime_type, size`` straight from the chunk log; contents are not built."""
    lengths = chunks.select("path", "mime_type", "seq", "complete", F.length("chunk").alias("n"))
    return _published(lengths, upload_bounds(chunks)).groupBy("path", "mime_type").agg(
        F.sum("n").cast("bigint").alias("size")
    )


def asset_list(sizes: DataFrame) -> DataFrame:
    """File listing in path order, each size with its label."""
    return sizes.withColumn("size_label", size_label(F.col("size"))).orderBy("path")


def only_keys(table: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """The rows of the given keys."""
    return table.join(keys.select(*on), list(on), "left_semi")


def get_by_key(table: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """Point lookup: every key once, with nulls where the table has no row.

    The semi join goes first because Catalyst can move it below an aggregate
    that builds the table, which it cannot do with the outer join.
    """
    found = only_keys(table, keys, *on)
    return keys.select(*on).distinct().join(found, list(on), "left")


def delete_by_key(table: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """The table without the given keys; unknown keys change nothing."""
    return table.join(keys.select(*on), list(on), "left_anti")


def chunk_split(files: DataFrame, size: int = 2_000_000) -> DataFrame:
    """Cut ``content`` into chunks of ``size``; an empty file yields none."""
    n = F.ceil(F.length("content") / size).cast("int")
    return (
        files.withColumn("n_chunks", n)
        .where("n_chunks > 0")
        .withColumn("chunk_index", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
        .select(
            *[c for c in files.columns if c != "content"],
            "chunk_index",
            F.substring("content", F.col("chunk_index") * size + 1, F.lit(size)).alias("chunk"),
            (F.col("chunk_index") + 1 == F.col("n_chunks")).alias("complete"),
            ((F.col("chunk_index") + 1) / F.col("n_chunks") * 100).alias("progress_pct"),
        )
    )


def doc_id_assign(uploads: DataFrame, order: str = "seq") -> DataFrame:
    """Dense 0-based document ids in arrival order."""
    return with_rank(uploads, order, name="doc_id")


def image_files(assets: DataFrame) -> DataFrame:
    return assets.where(F.col("mime_type").startswith("image/"))


def upload_guard(payloads: DataFrame, minimum: int = MINIMUM_BYTES) -> DataFrame:
    """Why a payload is refused, or null. Passports have no minimum size."""
    n = F.length("content")
    return payloads.withColumn(
        "guard_error",
        F.when(F.coalesce(n, F.lit(0)) == 0, EMPTY_PAYLOAD)
        .when((F.col("doc_type") == "live") & (n < minimum), SMALL_PAYLOAD)
        .when(
            (F.col("doc_type") == "id") & (n < minimum),
            F.concat(F.lit(f"{SMALL_PAYLOAD}: "), n.cast("string"), F.lit(" bytes")),
        ),
    )
