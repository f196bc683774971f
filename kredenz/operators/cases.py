"""Verification cases: assembling, reviewing, status and ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kredenz.dims import RATING_LABELS
from kredenz.functions.text import field_label, or_else
from kredenz.operators.assets import image_files
from kredenz.runtime import with_position

MISSING = "—"


def rating_latest(ratings: DataFrame) -> DataFrame:
    """Last rating per document, whatever its value, in id order."""
    return ratings.groupBy("doc_id").agg(F.max_by("rating", "seq").alias("rating")).orderBy("doc_id")


def rating_join(assets: DataFrame, ratings: DataFrame, key: str = "position") -> DataFrame:
    """Images with their rating and its label; unrated images get 0.

    Ratings belong to the position of an image in the path-ordered listing of
    images. ``key='doc_id'`` joins on a ``doc_id`` column instead.
    """
    images = image_files(assets)
    if key == "position":
        listing = with_position(images.select("path", "mime_type"), "path")
    else:
        listing = images
    latest = ratings.groupBy("doc_id").agg(F.max_by("rating", "seq").alias("rating"))
    joined = listing.join(latest.withColumnRenamed("doc_id", key), key, "left")
    rating = F.coalesce("rating", F.lit(0))
    label = F.coalesce(
        *[F.when(rating == value, text) for value, text in RATING_LABELS.items()], F.lit("No rating")
    )
    return joined.withColumns({"rating": rating, "rating_label": label})


def status_latest(events: DataFrame) -> DataFrame:
    return events.groupBy("case_id").agg(
        F.max_by("status", F.struct("ts", "event_id")).alias("status")
    )


def case_assemble(phones: DataFrame, docs: DataFrame, faces: DataFrame) -> DataFrame:
    """One case per person with whatever parts exist.

    Skipping the face step also counts as verified; ``face_skipped`` tells the
    two apart. Only a national ID is a required document.
    """
    everyone = (
        phones.select("case_id").union(docs.select("case_id")).union(faces.select("case_id")).distinct()
    )
    joined = (
        everyone.join(phones, "case_id", "left")
        .join(docs, "case_id", "left")
        .join(faces, "case_id", "left")
    )
    skipped = F.coalesce("face_skipped", F.lit(False))
    return joined.select(
        "case_id",
        F.coalesce("phone", F.lit("")).alias("phone"),
        "document_type",
        "document_name",
        "ocr_fields",
        "edited_fields",
        F.nullif(F.col("face_image"), F.lit("")).alias("face_image"),
        (F.coalesce("face_verified", F.lit(False)) | skipped).alias("face_verified"),
        skipped.alias("face_skipped"),
        F.coalesce(F.col("document_type") == "national_id", F.lit(False)).alias("documents_complete"),
    )


def review_unpivot(cases: DataFrame) -> DataFrame:
    """Labelled lines of a case: phone, document, then one per field; edited data replaces scanned data.

    Every case has the first two lines. They show a dash only where there is no value at
    all, fields also where it is empty.
    """
    shown = F.map_filter(F.coalesce("edited_fields", "ocr_fields"), lambda k, _: k != "face_image")
    heads = [
        F.struct(F.lit(label).alias("label"), F.coalesce(c, F.lit(MISSING)).alias("value"))
        for label, c in (("Phone", "phone"), ("Document", "document_name"))
    ]
    fields = F.transform(
        F.map_entries(shown),
        lambda e: F.struct(field_label(e["key"]).alias("label"), or_else(e["value"], MISSING).alias("value")),
    )
    lines = F.concat(F.array(*heads), F.coalesce(fields, F.array().cast("array<struct<label:string,value:string>>")))
    return cases.select("case_id", F.inline(lines))
