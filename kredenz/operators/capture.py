"""Live capture: facts per frame, readiness, messages and the frame to keep."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from kredenz.dims import ID_DIGITS
from kredenz.operators.detections import (
    found_counts, missing_labels, presence_columns, rounded_mean, rounded_mean_columns,
)
from kredenz.operators.quality import PHOTO_SEEN

MIN_CONFIDENCE = 0.4

# What the person is told. {found}, {digits} and {missing} are filled in.
MESSAGES = {
    "nothing": "No ID card detected. Show your ID to camera.",
    "missing_of_five": "{found}/5 fields. Missing: {missing}",
    "missing_of_four": "{found}/4 required. Missing: {missing} (First Name optional)",
    "digits_with_five": "All 5 fields detected! ID digits: {digits}/14. Adjust angle.",
    "digits_with_four": "4/4 required fields. ID digits: {digits}/14. Adjust angle.",
    "no_photo": "All fields + digits detected. Adjust angle to show photo clearly.",
    "blurry": "All required fields detected but image is blurry. Hold steady.",
    "dark": "All required fields detected but too dark. Find better lighting.",
    "ready_with_five": "Perfect! All 5 fields + photo + 14 digits detected.",
    "ready_with_four": "Perfect! All required fields + photo + 14 digits. Ready!",
    "other": "All required fields detected. Improve image quality.",
}


def _say(kind: str, **values: Column) -> Column:
    """A message with its values put in, as one concatenation."""
    parts = re.split(r"\{(\w+)\}", MESSAGES[kind])
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def frame_facts(frames: DataFrame, fields: DataFrame, digits: DataFrame) -> DataFrame:
    """Frames with everything readiness and messages need.

    ``fields`` and ``digits`` are reduced to one row per frame before they meet
    the frames; frames without any are kept.
    """
    seen = fields.groupBy("frame_id").agg(*presence_columns("field"), *rounded_mean_columns())
    counted = digits.groupBy("frame_id").agg(F.count("*").alias("n_digits"))
    joined = frames.join(seen, "frame_id", "left").join(counted, "frame_id", "left")
    extra = {
        **found_counts(),
        "has_firstName": F.coalesce("has_firstName", F.lit(False)),
        "missing_labels": missing_labels(),
        "n_detections": F.coalesce("n_detections", F.lit(0)),
        "n_digits": F.coalesce("n_digits", F.lit(0)),
        "mean_confidence": rounded_mean(),
        "photo_detected": F.col("card_found") & (F.col("photo_variance") > PHOTO_SEEN),
    }
    return joined.select(*frames.columns, *[c.alias(n) for n, c in extra.items()])


def is_ready() -> Column:
    return (
        (F.col("n_detections") > 0)
        & F.col("all_required")
        & (F.col("n_digits") == ID_DIGITS)
        & F.col("photo_detected")
        & (F.col("mean_confidence") > MIN_CONFIDENCE)
        & F.col("quality_level").isin("good", "medium")
        & ~F.col("is_blurry")
    )


def capture_ready(facts: DataFrame) -> DataFrame:
    return facts.withColumn("ready_for_capture", is_ready())


def capture_message(facts: DataFrame) -> DataFrame:
    """What the person is told about a frame: the first reason that applies."""
    found, digits = F.col("fields_found").cast("string"), F.col("n_digits").cast("string")
    missing = F.array_join("missing_labels", ", ")

    def by_first_name(five: str, four: str, **values: Column) -> Column:
        return F.when(F.col("has_firstName"), _say(five, **values)).otherwise(_say(four, **values))

    message = (
        F.when(F.col("n_detections") == 0, _say("nothing"))
        .when(
            ~F.col("all_required"),
            by_first_name("missing_of_five", "missing_of_four", found=found, missing=missing),
        )
        .when(
            F.col("n_digits") < ID_DIGITS,
            by_first_name("digits_with_five", "digits_with_four", digits=digits),
        )
        .when(~F.col("photo_detected"), _say("no_photo"))
        .when(F.col("is_blurry"), _say("blurry"))
        .when(F.col("is_too_dark"), _say("dark"))
        .when(F.col("ready_for_capture"), by_first_name("ready_with_five", "ready_with_four"))
        .otherwise(_say("other"))
    )
    return facts.withColumn("message", message)


def capture_pick(ready_frames: DataFrame) -> DataFrame:
    """First ready frame of each session; only its id and time are carried."""
    return (
        ready_frames.where("ready_for_capture")
        .groupBy("session_id")
        .agg(F.min(F.struct("ts", "frame_id")).alias("pick"))
        .select("session_id", "pick.frame_id", "pick.ts")
    )
