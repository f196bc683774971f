"""Stored recognition results: latest JSON per document, summaries, artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kredenz.functions.numbers import exact_round
from kredenz.functions.text import or_else

ID, PASSPORT, DOCUMENTS = "id", "passport", "documents"

# What the store keeps for a failed call and for an answer that is no text.
CALL_FAILED = '{"status":"error","message":"HTTP outcall failed","data":null}'
NOT_DECODED = '{"status":"error","message":"Failed to decode OCR response","data":null}'

# What debug records and face records say when nothing was found.
NO_MRZ, NO_ID_FACE = "No MRZ detected", "No face detected in ID image"

# debug_info keys that name an artifact, and their kinds.
ARTIFACTS = {
    "preprocessed_image": "preprocessed_image_path",
    "annotated_detection": "debug_image_path",
    "cropped_document": "cropped_image_path",
    "detector_output": "yolo_output_path",
    "mrz_region": "mrz_roi_path",
}

# File names of the artifacts of a national ID and of a passport.
ID_ARTIFACTS = {
    "debug_image_path": "egyptian_id_debug.jpg",
    "cropped_image_path": "cropped_id_card.jpg",
    "yolo_output_path": "d2.jpg",
    "preprocessed_image_path": "preprocessed_image.jpg",
}
MRZ_ARTIFACT = "mrz_roi.jpg"

# Record fields of a national ID and of a passport, in the order they are written.
ID_FIELDS = [
    "first_name", "second_name", "full_name", "national_id", "address",
    "birth_date", "governorate", "gender", "serial", "face_image",
]
PASSPORT_FIELDS = [
    "surname", "name", "sex", "date_of_birth", "nationality", "passport_type",
    "passport_number", "issuing_country", "expiration_date",
]


def result_upsert(log: DataFrame) -> DataFrame:
    """Latest result per ``(doc_type, path)``; failures are results too."""
    return log.groupBy("doc_type", "path").agg(
        F.max("seq").alias("seq"), F.max_by("result_json", "seq").alias("result_json")
    )


def outcall_results(answers: DataFrame) -> DataFrame:
    """Rows to store from the answers of recognition calls.

    ``answers`` has ``doc_type, path, seq, answer`` (bytes) and ``failed``. A failed call, and an
    answer that is no UTF-8, are stored as the store's own error text.
    """
    text = F.try_validate_utf8(F.col("answer").cast("string"))
    failed = F.coalesce("failed", F.lit(False))
    stored = F.when(failed, CALL_FAILED).otherwise(F.coalesce(text, F.lit(NOT_DECODED)))
    return answers.select("doc_type", "path", "seq", stored.alias("result_json"))


def result_list(results: DataFrame) -> DataFrame:
    return results.orderBy("doc_type", "path")


def result_counts(results: DataFrame, documents: DataFrame) -> DataFrame:
    """How many results each store and how many files the document store holds; 0 for an empty one."""
    stores = F.explode(F.array(*[F.lit(s) for s in (ID, PASSPORT, DOCUMENTS)])).alias("store")
    held = results.select(F.col("doc_type").alias("store")).unionAll(documents.select(F.lit(DOCUMENTS).alias("store")))
    counted = held.groupBy("store").agg(F.count("*").alias("n"))
    every = results.sparkSession.range(1).select(stores).join(counted, "store", "full")
    return every.select("store", F.coalesce("n", F.lit(0)).alias("n"))


def _parsed(results: DataFrame) -> DataFrame:
    """Parse each JSON once; ``doc`` is null where the text is no JSON object."""
    doc = F.expr("try_parse_json(result_json)")
    return results.withColumn("doc", F.when(~F.expr("is_variant_null(try_parse_json(result_json))"), doc))


def _text(path: str) -> Column:
    return F.expr(f"try_variant_get(doc, '$.{path}', 'string')")


def result_summary(results: DataFrame) -> DataFrame:
    """One line per stored result; bad JSON is reported for its own row only."""
    passport_name = F.concat(
        F.coalesce(_text("data.surname"), F.lit("")), F.lit(" "),
        F.coalesce(_text("data.name"), F.lit("")),
    )
    is_id = F.col("doc_type") == ID
    readable = F.col("doc").isNotNull()
    number = F.when(is_id, _text("extracted_data.national_id")).otherwise(_text("data.passport_number"))
    name = F.when(is_id, or_else(_text("extracted_data.full_name"), "N/A")).otherwise(passport_name)
    return _parsed(results).select(
        "doc_type",
        "path",
        F.expr("try_variant_get(doc, '$.processing_time', 'double')").alias("processing_time"),
        F.when(readable, name).alias("name"),
        F.when(readable, or_else(number, "N/A")).alias("document_no"),
        F.when(~readable, F.concat(F.lit("Error parsing "), F.col("path"))).alias("parse_error"),
    )


def artifact_unpivot(results: DataFrame) -> DataFrame:
    """One row per artifact file named in a result's debug_info."""
    pairs = F.array(
        *[
            F.struct(F.lit(kind).alias("artifact_kind"), _text(f"debug_info.{key}").alias("filename"))
            for kind, key in ARTIFACTS.items()
        ]
    )
    return (
        _parsed(results)
        .select("doc_type", "path", F.inline(pairs))
        .where("filename IS NOT NULL AND filename <> ''")
    )


def _json(**fields: Column) -> Column:
    return F.to_json(
        F.struct(*[c.alias(name) for name, c in fields.items()]), {"ignoreNullFields": "false"}
    )


def passport_envelope(
    seconds: Column, error: Column, zone_found: Column, fields: list[str] = PASSPORT_FIELDS
) -> Column:
    """Response text of a passport: data only on success, error only on failure.

    The debug record is about the zone alone: a found zone whose lines could not be
    read still names its artifact.
    """
    ok, zone = error.isNull(), F.coalesce(zone_found, F.lit(False))
    return _json(
        success=ok,
        processing_time=exact_round(seconds, 2),
        data=F.when(ok, F.struct(*fields)),
        error=error,
        debug_info=F.struct(
            zone.alias("mrz_detected"),
            F.when(zone, MRZ_ARTIFACT).alias("mrz_roi_path"),
            F.when(~zone, NO_MRZ).alias("error"),
        ),
    )


def id_envelope(seconds: Column, error: Column, fields: list[str] = ID_FIELDS) -> Column:
    """Response text of a national ID; a failed request holds only its error."""
    body = _json(
        success=F.lit(True),
        processing_time=exact_round(seconds, 2),
        method=F.lit("egyptian_id"),
        extracted_data=F.struct(*fields),
        face_verification=F.struct(
            F.col("face_image").isNotNull().alias("face_detected"),
            F.col("face_image"),
            F.when(F.col("face_image").isNull(), NO_ID_FACE).alias("face_error"),
        ),
        debug_info=F.struct(
            "detected_fields", *[F.lit(name).alias(key) for key, name in ID_ARTIFACTS.items()]
        ),
        total_fields=F.lit(8),
    )
    return F.when(error.isNull(), body).otherwise(_json(error=error))


def envelope_write(rows: DataFrame, doc_type: str) -> DataFrame:
    """``doc_type, path, seq, result_json`` from decoded rows.

    Rows carry the record fields plus ``path, seq, processing_time, error``, those of
    passports ``zone_found`` and those of IDs ``detected_fields`` too.
    """
    common = F.col("processing_time"), F.col("error")
    body = id_envelope(*common) if doc_type == ID else passport_envelope(*common, F.col("zone_found"))
    return rows.select(
        F.lit(doc_type).alias("doc_type"),
        "path",
        "seq",
        body.alias("result_json"),
    )
