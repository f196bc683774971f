"""Every operator as a query over the tables of a folder.

Arrays and boxes are flattened to plain columns here, so results compare value
by value with SQL.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kredenz.dims import FIELDS
from kredenz.functions.boxes import bbox_expand, bbox_globalize, bbox_pad_card, nid_band, photo_region
from kredenz.functions.images import compress_plan, fit_within, resize_plan
from kredenz.functions.mrz import mrz_clean, mrz_date, mrz_read_error, mrz_sex
from kredenz.functions.numbers import exact_round
from kredenz.functions.sql import STAND_INS, register as register_functions
from kredenz.functions.status import progress_pct, status_flags, stepper_pct
from kredenz.functions.text import (
    confidence_band, field_fallback, path_sanitize, path_valid, phone_mask,
)
from kredenz.operators import assets, capture, cases, detections, documents, faces, otp, quality, results
from kredenz.plans import flows
from kredenz.sources.images import apply_detector, image_adjust
from kredenz.sources.tables import Inputs, image_struct

TEST_TTL = 14_400  # seconds; events are sparse, so the usual 30 would never collide
STATE_AS_OF = "2024-01-20 00:00:00"
PLACES = 9

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    """Register ``build`` under its own name, without leading underscores."""
    QUERIES[build.__name__.lstrip("_")] = lambda spark, folder: build(Inputs(spark, folder))
    return build


def _joined(c: str | Column) -> Column:
    return F.array_join(c, ",")


def _fixed(c: str | Column) -> Column:
    return F.round(c, PLACES)


# -- files ----------------------------------------------------------------


@query
def asset_assemble(t: Inputs) -> DataFrame:
    return assets.asset_assemble(t.asset_chunks())


@query
def asset_assemble_carry_over(t: Inputs) -> DataFrame:
    return assets.asset_assemble(t.asset_chunks(), carry_over=True)


@query
def asset_pending(t: Inputs) -> DataFrame:
    return assets.asset_pending(t.asset_chunks())


@query
def asset_list(t: Inputs) -> DataFrame:
    return assets.asset_list(assets.asset_sizes(t.asset_chunks()))


@query
def asset_get(t: Inputs) -> DataFrame:
    keys = t.lookup_keys()
    return assets.get_by_key(assets.asset_assemble(t.asset_chunks(), only=keys), keys, "path")


@query
def asset_pages(t: Inputs) -> DataFrame:
    return assets.asset_pages(t.asset_chunks())


@query
def recognition_input(t: Inputs) -> DataFrame:
    return assets.recognition_input(t.asset_chunks())


@query
def asset_delete(t: Inputs) -> DataFrame:
    return assets.asset_assemble(t.asset_chunks(), without=t.delete_paths())


@query
def asset_delete_pending(t: Inputs) -> DataFrame:
    """Unfinished uploads that deleting the same paths leaves."""
    return assets.asset_pending(t.asset_chunks(), without=t.delete_paths())


@query
def chunk_split(t: Inputs) -> DataFrame:
    return assets.chunk_split(t.files(), size=700).withColumn(
        "progress_pct", F.round("progress_pct", PLACES)
    )


@query
def doc_id_assign(t: Inputs) -> DataFrame:
    return assets.doc_id_assign(t.asset_chunks().select("path", "seq"))


@query
def upload_guard(t: Inputs) -> DataFrame:
    return assets.upload_guard(t.payloads()).select("payload_id", "doc_type", "guard_error")


@query
def image_files(t: Inputs) -> DataFrame:
    return assets.image_files(assets.asset_sizes(t.asset_chunks()))


# -- stored results -------------------------------------------------------


@query
def result_upsert(t: Inputs) -> DataFrame:
    return results.result_upsert(t.ocr_results())


@query
def outcall_results(t: Inputs) -> DataFrame:
    """Stored texts of recognition calls, the failed and the undecodable among them."""
    return results.result_upsert(results.outcall_results(t.outcalls()))


@query
def result_get(t: Inputs) -> DataFrame:
    latest = results.result_upsert(t.ocr_results())
    return assets.get_by_key(latest, t.result_keys(), "doc_type", "path").drop("seq")


@query
def result_list(t: Inputs) -> DataFrame:
    return results.result_list(results.result_upsert(t.ocr_results()))


@query
def result_counts(t: Inputs) -> DataFrame:
    latest = results.result_upsert(t.ocr_results())
    return results.result_counts(latest, assets.upload_bounds(t.asset_chunks()))


@query
def result_delete(t: Inputs) -> DataFrame:
    latest = results.result_upsert(t.ocr_results())
    return assets.delete_by_key(latest, t.result_keys(), "doc_type", "path")


@query
def result_summary(t: Inputs) -> DataFrame:
    return results.result_summary(results.result_upsert(t.ocr_results()))


@query
def artifact_unpivot(t: Inputs) -> DataFrame:
    return results.artifact_unpivot(results.result_upsert(t.ocr_results()))


@query
def envelope_write(t: Inputs) -> DataFrame:
    read_error = mrz_read_error(F.col("zone_found"), F.col("line1"), F.col("line2"))
    rows = documents.parse_passports(t.mrz_lines()).withColumn("error", read_error).selectExpr(
        "*", "concat('passports/', passport_id, '.jpg') AS path",
        "passport_id AS seq", "passport_id % 40 / 4D AS processing_time",
    )
    return results.envelope_write(rows, results.PASSPORT)


# -- documents ------------------------------------------------------------


@query
def decode_national_id(t: Inputs) -> DataFrame:
    decoded = documents.decode_ids(t.national_ids())
    return decoded.withColumn("birth_date_valid", F.col("birth_date_valid").cast("string"))


@query
def decode_national_id_sql(t: Inputs) -> DataFrame:
    """The same rule as an SQL function with a struct for its results."""
    register_functions(t.spark, "decode_national_id")
    decoded = t.national_ids().selectExpr("person_id", "id_number", "decode_national_id(id_number) AS d").select("person_id", "id_number", "d.*")
    return decoded.withColumn("birth_date_valid", F.col("birth_date_valid").cast("string"))


@query
def governorate_lookup(t: Inputs) -> DataFrame:
    return documents.governorate_lookup(documents.decode_ids(t.national_ids())).select(
        "person_id", "governorate_code", "governorate"
    )


@query
def mrz_parse(t: Inputs) -> DataFrame:
    return documents.parse_passports(t.mrz_lines()).drop("line1", "line2", "zone_found")


@query
def _mrz_clean(t: Inputs) -> DataFrame:
    return t.mrz_lines().select("passport_id", mrz_clean(F.col("line1")).alias("cleaned"))


@query
def _mrz_sex(t: Inputs) -> DataFrame:
    code = F.substring("line2", 21, 1)
    return t.mrz_lines().select(
        "passport_id", code.alias("code"), mrz_sex(code).alias("sex")
    )


@query
def _mrz_date(t: Inputs) -> DataFrame:
    text = F.substring("line2", 14, 6)
    return t.mrz_lines().select(
        "passport_id", text.alias("raw"), mrz_date(text).alias("date_text"),
        mrz_date(text, pivot=30).alias("pivoted"),
    )


@query
def country_lookup(t: Inputs) -> DataFrame:
    parsed = documents.parse_passports(t.mrz_lines())
    return documents.country_lookup(parsed, t.countries()).select(
        "passport_id", "nationality", "issuing_country"
    )


@query
def doc_type_dispatch(t: Inputs) -> DataFrame:
    return documents.doc_type_dispatch(t.mixed_payloads())


@query
def record_defaults(t: Inputs) -> DataFrame:
    return documents.record_defaults(t.records())


@query
def detection_rate(t: Inputs) -> DataFrame:
    return documents.detection_rate(t.structured_docs()).select("doc_id", "rate", "band")


# -- detections -----------------------------------------------------------


@query
def detection_filter(t: Inputs) -> DataFrame:
    stage = F.expr(
        "CASE class_name WHEN 'card' THEN 'card' WHEN 'photo' THEN 'digit' ELSE 'field' END"
    )
    return detections.detection_filter(t.detections(), stage).select(
        "image_id", "l_linenumber", "l_partkey", "l_suppkey", "class_name", "confidence"
    )


@query
def orientation_score(t: Inputs) -> DataFrame:
    rows = detections.orientation_score(t.detections(), t.images())
    return rows.select(
        "image_id", "angle", "field_count", _fixed("avg_conf").alias("avg_conf"),
        _fixed("score").alias("score"), _joined("fields").alias("fields"),
        *[f"n_{name}" for name in FIELDS],
    )


@query
def orientation_best(t: Inputs) -> DataFrame:
    return detections.orientation_best(t.detections(), t.images()).withColumn("score", _fixed("score"))


@query
def field_counts(t: Inputs) -> DataFrame:
    return detections.field_counts(detections.detection_filter(t.detections(), "field"), t.images())


@query
def field_presence(t: Inputs) -> DataFrame:
    return detections.field_presence(detections.detection_filter(t.detections(), "field"), t.images())


@query
def avg_confidence(t: Inputs) -> DataFrame:
    return detections.avg_confidence(detections.detection_filter(t.detections(), "field"), t.images())


@query
def missing_fields(t: Inputs) -> DataFrame:
    rows = detections.missing_fields(detections.detection_filter(t.detections(), "field"), t.images())
    return rows.select(
        "image_id", _joined("missing").alias("missing"), _joined("missing_labels").alias("missing_labels")
    )


@query
def digit_assemble(t: Inputs) -> DataFrame:
    return detections.digit_assemble(t.digit_boxes())


@query
def field_last_wins(t: Inputs) -> DataFrame:
    return detections.field_last_wins(detections.detection_filter(t.detections(), "field"), t.images())


@query
def field_first_wins(t: Inputs) -> DataFrame:
    rows = detections.field_first_wins(t.detections(), t.images())
    boxes = {"nid": "nid_box", "card": "card_box", "crop": "crop_box"}
    return rows.select(
        "image_id",
        *[
            F.col(f"{box}.{c}").alias(f"{name}_{c}")
            for name, box in boxes.items() for c in ("x1", "y1", "x2", "y2")
        ],
        "error",
    )


KEYS = ["image_id", "l_linenumber", "l_partkey", "l_suppkey"]


def _box(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def _named(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(name) for name, c in columns.items()]


@query
def _bbox_expand(t: Inputs) -> DataFrame:
    return t.detections().select(*KEYS, *_named(bbox_expand(*_box("y1", "y2", "img_height"))))


@query
def _bbox_pad_card(t: Inputs) -> DataFrame:
    sides = _box("x1", "y1", "x2", "y2", "img_width", "img_height")
    live = {f"live_{name}": c for name, c in bbox_pad_card(*sides, flat=20).items()}
    return t.detections().select(*KEYS, *_named(bbox_pad_card(*sides)), *_named(live))


@query
def _bbox_globalize(t: Inputs) -> DataFrame:
    offsets = [F.expr("cast(l_suppkey % 40 AS INT)"), F.expr("cast(l_partkey % 30 AS INT)")]
    sides = _box("x1", "y1", "x2", "y2")
    size = _box("img_width", "img_height")
    return t.detections().select(*KEYS, *_named(bbox_globalize(*sides, *offsets, *size)))


@query
def _photo_region(t: Inputs) -> DataFrame:
    sides, size = _box("x1", "y1", "x2", "y2"), _box("img_width", "img_height")
    crops = t.detections().withColumns(bbox_pad_card(*sides, *size, flat=20))
    return crops.select(*KEYS, *_named(photo_region(*sides, *size)))


@query
def _nid_band(t: Inputs) -> DataFrame:
    return t.detections().select(*KEYS, *_named(nid_band(*_box("y1", "y2", "img_height"))))


@query
def _resize_plan(t: Inputs) -> DataFrame:
    return t.file_sizes().select("p_partkey", *_named(resize_plan(*_box("width", "height"))))


@query
def _compress_plan(t: Inputs) -> DataFrame:
    sizes = t.file_sizes()
    plan = compress_plan(F.col("bytes"), F.floor(F.col("bytes") / 3))
    planned = sizes.select("p_partkey", "width", "height", *_named(plan))
    fit = fit_within(*_box("width", "height", "max_w", "max_h"))
    rounded = {
        name: F.round(name, 6) for name in ("saved_pct", "shrink_factor", "kept_share", "fit_w", "fit_h")
    }
    return planned.select("*", *_named(fit)).withColumns(rounded).drop("width", "height")


@query
def _path_sanitize(t: Inputs) -> DataFrame:
    return t.paths().select("page_id", path_sanitize(F.col("path")).alias("clean"))


@query
def _path_valid(t: Inputs) -> DataFrame:
    both = {"raw_ok": F.col("path"), "clean_ok": path_sanitize(F.col("path"))}
    return t.paths().select("page_id", *[path_valid(c).alias(n) for n, c in both.items()])


@query
def _phone_mask(t: Inputs) -> DataFrame:
    return t.phones().select("event_id", phone_mask(F.col("phone")).alias("masked"))


@query
def phone_mask_sql(t: Inputs) -> DataFrame:
    """The same rule as an SQL function."""
    register_functions(t.spark, "phone_mask")
    return t.phones().selectExpr("event_id", "phone_mask(phone) AS masked")


@query
def _confidence_band(t: Inputs) -> DataFrame:
    return t.detections().select(*KEYS, *_named(confidence_band(F.col("confidence"))))


@query
def _field_fallback(t: Inputs) -> DataFrame:
    fields = F.col("ocr_fields")
    return t.case_docs().select(
        "case_id", *[field_fallback(fields, k, v).alias(k) for k, v in STAND_INS.items()],
        field_fallback(fields, "full_name").alias("built_name"),
    )


@query
def _status_steps(t: Inputs) -> DataFrame:
    rows = t.status_events().selectExpr(
        "event_id", "status", "cast(event_id % 8 AS INT) AS step", "cast(event_id % 7 AS INT) AS n"
    )
    return rows.select(
        "event_id", *_named(status_flags(F.col("status"))),
        progress_pct(F.greatest(F.col("step"), F.lit(1))).cast("bigint").alias("progress_pct"),
        stepper_pct(F.col("step"), F.col("n")).cast("bigint").alias("stepper_pct"),
    )


# -- quality and capture --------------------------------------------------


@query
def photo_variance(t: Inputs) -> DataFrame:
    rows = quality.photo_variance(t.image_rows()).withColumn("variance", _fixed("variance"))
    return rows.select(F.col("path").cast("bigint").alias("image_id"), "variance", "detected", "is_clear", "error")


@query
def image_quality(t: Inputs) -> DataFrame:
    return quality.image_quality(t.image_rows()).withColumn("image_id", F.col("path").cast("bigint")).drop("path")


@query
def image_rows_quality(t: Inputs) -> DataFrame:
    """Quality and photo contrast from one pass over the images."""
    return quality.image_rows_quality(t.image_rows()).select(
        F.col("path").cast("bigint").alias("image_id"), "quality_score", "blur_score", "card_found",
        _fixed("variance").alias("variance"), "detected", "error",
    )


def _facts(t: Inputs) -> DataFrame:
    fields = detections.detection_filter(t.frame_fields(), "field")
    return capture.capture_ready(capture.frame_facts(t.frames(), fields, t.frame_digits()))


@query
def capture_ready(t: Inputs) -> DataFrame:
    return _facts(t).select("frame_id", "fields_found", "n_digits", "ready_for_capture")


@query
def capture_message(t: Inputs) -> DataFrame:
    return capture.capture_message(_facts(t)).select("frame_id", "message")


@query
def capture_pick(t: Inputs) -> DataFrame:
    return capture.capture_pick(_facts(t)).select(
        "session_id", "frame_id", otp.micros().alias("micros")
    )


@query
def capture_readiness(t: Inputs) -> DataFrame:
    rows = flows.capture_readiness(t.frames(), t.frame_fields(), t.frame_digits())
    return rows.select(
        "frame_id", "session_id", "required_found", "optional_found", "fields_found",
        "n_detections", "n_digits", exact_round(F.col("mean_confidence"), 3).alias("confidence"),
        "photo_detected", "quality_level", "ready_for_capture", "message",
    )


@query
def capture_from_pixels(t: Inputs) -> DataFrame:
    """Frames whose pictures are the embeddings' images; the others failed to load."""
    rows = flows.capture_from_pixels(_shots(t), t.image_rows(), t.frame_fields(), t.frame_digits())
    return rows.select(
        "frame_id", "error", "quality_level", "photo_detected", "ready_for_capture", "message"
    )


def _shots(t: Inputs) -> DataFrame:
    return t.frames().select("frame_id", "session_id", "ts", F.col("frame_id").cast("string").alias("path"))


@query
def capture_result(t: Inputs) -> DataFrame:
    rows = flows.capture_result(_shots(t), t.image_rows(), t.frame_fields(), t.frame_digits())
    box = ["x1", "y1", "x2", "y2", "x1_norm", "y1_norm", "x2_norm", "y2_norm", "width", "height", "is_clear"]
    return rows.select(
        "frame_id", "session_id", "detected", "error", F.col("photo.detected").alias("photo_detected"),
        *[F.col(f"photo.bbox.{c}").alias(f"photo_{c}") for c in box],
        _fixed("photo.bbox.variance").alias("photo_variance"),
        "field_count", "total_detections", "confidence", *[F.col(f"quality.{c}") for c in flows.QUALITY],
        "ready_for_capture", "message", *[F.col(f"field_summary.{c}").alias(f"n_{c}") for c in FIELDS],
    )


# -- faces ----------------------------------------------------------------


@query
def face_pair_join(t: Inputs) -> DataFrame:
    rows = faces.face_pair_join(t.id_faces(), t.live_faces())
    return rows.select(
        "case_id",
        F.col("id_embedding").isNotNull().alias("has_id"),
        F.col("live_embedding").isNotNull().alias("has_live"),
        "error",
    )


@query
def face_similarity(t: Inputs) -> DataFrame:
    pairs = faces.face_pair_join(t.id_faces(), t.live_faces())
    return faces.face_similarity(pairs).withColumn("similarity_score", F.round("similarity_score", 6))


@query
def face_verification(t: Inputs) -> DataFrame:
    return flows.face_verification(t.id_faces(), t.live_faces()).withColumn(
        "similarity_score", F.round("similarity_score", 6)
    )


@query
def face_response(t: Inputs) -> DataFrame:
    verified = flows.face_verification(t.id_faces(), t.live_faces())
    rows = faces.face_response(verified, F.expr("case_id * 0.5D + 1700000000"))
    return rows.select(
        "case_id", "success", F.round("verification_result.similarity_score", 6).alias("similarity_score"),
        "verification_result.is_match", "verification_result.confidence", "request_timestamp", "error",
    )


# -- one-time codes -------------------------------------------------------

OUTCOME = ["event_id", "phone", "action", "success", "message"]


@query
def otp_replay(t: Inputs) -> DataFrame:
    return otp.otp_replay(t.otp_events(), TEST_TTL).select(*OUTCOME)


@query
def verified_phones(t: Inputs) -> DataFrame:
    return otp.verified_phones(otp.otp_replay(t.otp_events(), TEST_TTL))


@query
def otp_state(t: Inputs) -> DataFrame:
    as_of = F.unix_micros(F.lit(STATE_AS_OF).cast("timestamp"))
    return otp.otp_state(otp.otp_replay(t.otp_events(), TEST_TTL), as_of, TEST_TTL)


# -- ratings and cases ----------------------------------------------------


@query
def rating_latest(t: Inputs) -> DataFrame:
    return cases.rating_latest(t.ratings())


@query
def rating_join(t: Inputs) -> DataFrame:
    return cases.rating_join(assets.asset_sizes(t.asset_chunks()), t.ratings())


@query
def status_latest(t: Inputs) -> DataFrame:
    return cases.status_latest(t.status_events())


def _cases(t: Inputs) -> DataFrame:
    return cases.case_assemble(t.case_phones(), t.case_docs(), t.case_faces())


@query
def case_assemble(t: Inputs) -> DataFrame:
    return _cases(t).select(
        "case_id", "phone", "document_type", F.size("ocr_fields").alias("n_fields"),
        F.try_element_at("ocr_fields", F.lit("full_name")).alias("scanned_name"),
        F.try_element_at("edited_fields", F.lit("full_name")).alias("edited_name"),
        "face_image", "face_verified", "face_skipped", "documents_complete",
    )


@query
def review_unpivot(t: Inputs) -> DataFrame:
    return cases.review_unpivot(_cases(t))


@query
def case_review(t: Inputs) -> DataFrame:
    at_step = _cases(t).withColumn("step", F.expr("cast(case_id % 5 + 1 AS INT)"))
    return flows.case_review(at_step, t.status_events())


@query
def rating_get(t: Inputs) -> DataFrame:
    """Ratings of all document ids; most ids were never rated."""
    ids = t.table("documents").select("doc_id")
    return assets.get_by_key(cases.rating_latest(t.ratings()), ids, "doc_id")


# -- records end to end ---------------------------------------------------


@query
def national_id_records(t: Inputs) -> DataFrame:
    return flows.national_id_records(t.detections(), t.digit_boxes(), t.images()).select(
        "image_id", "angle", "error", "full_name", "national_id", "birth_date", "governorate", "gender",
        "address", "serial", "decode_status", "crop_x1", "crop_y1", "crop_x2", "crop_y2",
    )


def _stored_ids(t: Inputs) -> DataFrame:
    records = flows.national_id_records(t.detections(), t.digit_boxes(), t.images(), with_boxes=True)
    return flows.stored_id_results(
        records, F.expr("image_id % 40 / 4D"),
        F.expr("concat('cards/', image_id div 2, '.jpg')"), F.col("image_id"),
    )


@query
def national_id_results(t: Inputs) -> DataFrame:
    return _stored_ids(t)


@query
def national_id_summary(t: Inputs) -> DataFrame:
    """Overview of the stored ID results."""
    return results.result_summary(_stored_ids(t))


@query
def passport_records(t: Inputs) -> DataFrame:
    return flows.passport_records(t.mrz_lines(), t.countries()).drop("line1", "line2", "zone_found")


@query
def passport_results(t: Inputs) -> DataFrame:
    return flows.stored_passport_results(
        flows.passport_records(t.mrz_lines(), t.countries()), F.expr("passport_id % 40 / 4D"),
        F.expr("concat('passports/', passport_id div 2, '.jpg')"), F.col("passport_id"),
    )


# -- images ---------------------------------------------------------------


@query
def _image_adjust(t: Inputs) -> DataFrame:
    adjusted = image_adjust(image_struct(t.pixels()), True, brightness=10, contrast=20, sharpness=50)
    return adjusted.selectExpr("cast(path AS BIGINT) AS image_id", "width", "height", "hex(data) AS pixels")


def _bright_box():
    """Stand-in detector: the box around the pixels brighter than the mean."""
    def detect(batch: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in batch.itertuples(index=False):
            g = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)[..., 0]
            ys, xs = np.nonzero(g.astype(np.int64) * g.size > g.sum(dtype=np.int64))
            if len(xs):
                rows.append((int(r.path), "card", xs.min(), ys.min(), xs.max(), ys.max()))
        return pd.DataFrame(rows, columns=["image_id", "class_name", "x1", "y1", "x2", "y2"])

    return detect


@query
def _apply_detector(t: Inputs) -> DataFrame:
    return apply_detector(
        image_struct(t.pixels()), _bright_box,
        "image_id bigint, class_name string, x1 int, y1 int, x2 int, y2 int",
    )
