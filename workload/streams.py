"""Queries whose input must first arrive: streams over files, stores for lookups, and the image scan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from kredenz.functions.images import resize_plan
from kredenz.operators import assets, otp, results
from kredenz.plans.catalog import OUTCOME, STATE_AS_OF, TEST_TTL, _facts
from kredenz.runtime import scratch_path
from kredenz.sources.images import image_scan, image_sizes
from kredenz.sources.stores import look_up, write_store
from kredenz.sources.tables import Inputs, image_struct
from kredenz.streaming.assets import asset_stream, read_assets
from kredenz.streaming.capture import capture_stream
from kredenz.streaming.otp import otp_state_live, otp_stream
from kredenz.streaming.results import read_results, result_upsert_stream
from kredenz.streaming.runs import drain, to_files
from workload.pictures import picture_folder

FILES_PER_BATCH = 16


def arrive(
    table: DataFrame, order: str, key: str, consume: Callable[[DataFrame, str], None], slices: int = 2
) -> str:
    """Let ``table`` arrive in time slices and consume each as a stream of bounded batches.

    After a slice is written the stream is drained, so state crosses restarts as well
    as micro-batches. A slice has the rows of a ``key`` in one file, so they come in
    order however its files fall into batches. Returns the working folder.
    """
    spark = table.sparkSession
    folder = scratch_path(spark, "stream")
    shares = [i / slices for i in range(1, slices)]
    inner = sorted(set(table.approxQuantile(order, shares, 0.01)))
    for low, high in zip([None, *inner], [*inner, None]):
        part = table if low is None else table.where(F.col(order) > low)
        part = part if high is None else part.where(F.col(order) <= high)
        part.repartition(key).write.mode("append").parquet(f"{folder}/in")
        reader = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", FILES_PER_BATCH)
        consume(reader.parquet(f"{folder}/in"), folder)
    return folder


def _streamed(t: Inputs, table: DataFrame, order: str, key: str, operator) -> DataFrame:
    """Drain ``table`` through a streaming operator into Parquet and read it back."""
    def consume(stream: DataFrame, folder: str) -> None:
        drain(t.spark, to_files(operator(stream), f"{folder}/out"), f"{folder}/checkpoint")

    return t.spark.read.parquet(f"{arrive(table, order, key, consume)}/out")


def _otp_stream(t: Inputs) -> DataFrame:
    events = t.otp_events().withColumn("arrival", otp.micros())
    return _streamed(t, events, "arrival", "phone", lambda s: otp_stream(s, TEST_TTL)).select(*OUTCOME)


def _otp_state_live(t: Inputs) -> DataFrame:
    """What the stream holds once it has read everything up to a moment."""
    as_of = F.unix_micros(F.lit(STATE_AS_OF).cast("timestamp"))
    events = t.otp_events().withColumn("arrival", otp.micros()).where(F.col("arrival") <= as_of)

    def consume(stream: DataFrame, folder: str) -> None:
        drain(t.spark, to_files(otp_stream(stream, TEST_TTL), f"{folder}/out"), f"{folder}/checkpoint")

    return otp_state_live(t.spark, f"{arrive(events, 'arrival', 'phone', consume)}/checkpoint", as_of)


def _asset_stream(t: Inputs) -> DataFrame:
    def consume(stream: DataFrame, folder: str) -> None:
        drain(t.spark, asset_stream(stream, f"{folder}/out"), f"{folder}/checkpoint")

    return read_assets(t.spark, f"{arrive(t.asset_chunks(), 'seq', 'path', consume)}/out")


def _capture_stream(t: Inputs) -> DataFrame:
    """Slices arrive session by session, so frames are late by a slice at most."""
    facts = _facts(t).drop("missing_labels", "ready_for_capture").withColumn("arrival", otp.micros())
    operator = lambda s: capture_stream(s, idle="400 days", late="400 days")
    return _streamed(t, facts, "arrival", "session_id", operator).select("session_id", "frame_id", otp.micros().alias("micros"))


def _result_upsert_stream(t: Inputs) -> DataFrame:
    def consume(stream: DataFrame, folder: str) -> None:
        drain(t.spark, result_upsert_stream(stream, f"{folder}/out"), f"{folder}/checkpoint")

    return read_results(t.spark, f"{arrive(t.ocr_results(), 'seq', 'path', consume)}/out")


def _asset_get_stored(t: Inputs) -> DataFrame:
    store = scratch_path(t.spark, "assets")
    write_store(assets.asset_assemble(t.asset_chunks()), store, "path")
    return look_up(t.spark, store, t.lookup_keys(), "path")


def _result_get_stored(t: Inputs) -> DataFrame:
    """By the type and path of a result, as one key."""
    store, key = scratch_path(t.spark, "results"), F.concat_ws("/", "doc_type", "path").alias("key")
    latest = results.result_upsert(t.ocr_results())
    write_store(latest.select(key, "result_json"), store, "key")
    keys = t.result_keys().select("doc_type", "path").distinct()
    return keys.select("*", key).join(look_up(t.spark, store, keys.select(key), "key"), "key").drop("key")


def _image_scan(t: Inputs) -> DataFrame:
    scanned = image_scan(t.spark, picture_folder(image_struct(t.pixels())))
    return scanned.select(
        F.regexp_extract("path", r"(\d+)\.png$", 1).cast("bigint").alias("image_id"),
        "height", "width", F.hex("data").alias("pixels"), "error",
    )


def _image_sizes(t: Inputs) -> DataFrame:
    """Sizes of stored pictures, and what they are resized to before text is read."""
    sizes = image_sizes(t.spark, picture_folder(image_struct(t.pixels())), "*.png")
    plan = resize_plan(F.col("width"), F.col("height"))
    return sizes.select(
        F.regexp_extract("path", r"(\d+)\.png$", 1).cast("bigint").alias("image_id"), "width", "height", "error",
        *[c.alias(name) for name, c in plan.items() if name.startswith("new_")],
    )


def _over(build: Callable[[Inputs], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: build(Inputs(spark, folder))


QUERIES = {
    build.__name__.lstrip("_"): _over(build)
    for build in (_otp_stream, _otp_state_live, _asset_stream, _capture_stream, _result_upsert_stream, _asset_get_stored, _result_get_stored, _image_scan, _image_sizes)
}
