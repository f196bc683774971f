"""End-to-end flows: from detections, lines and events to stored results and cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kredenz.dims import FIELDS, STAGE_FLOORS
from kredenz.functions.boxes import bbox_pad_card, photo_region
from kredenz.functions.mrz import mrz_read_error
from kredenz.functions.numbers import exact_mean, exact_round, exact_sum
from kredenz.functions.status import progress_pct
from kredenz.operators.capture import capture_message, capture_ready, frame_facts
from kredenz.operators.cases import review_unpivot, status_latest
from kredenz.operators.detections import LAST_TEXTS, detection_filter, digit_assemble, last_texts
from kredenz.operators.documents import (
    country_lookup, decode_ids, governorate_lookup, parse_passports,
)
from kredenz.operators.faces import face_pair_join, face_similarity
from kredenz.operators.quality import CROP, PHOTO_CLEAR, image_rows_quality
from kredenz.operators.results import ID, PASSPORT, envelope_write, result_upsert
from kredenz.sources.images import LOAD_ERROR


# The quality values of a response.
QUALITY = [
    "quality_score", "quality_level", "blur_score", "brightness", "is_blurry", "is_too_dark",
    "is_too_bright", "size_ok", "width", "height", "feedback",
]

# Fixed value: the error of a request whose number has a wrong century digit.
BAD_CENTURY = "Invalid century digit"


def national_id_records(
    detections: DataFrame, digits: DataFrame, images: DataFrame, with_boxes: bool = False
) -> DataFrame:
    """One decoded record per image, read at its best orientation.

    ``images`` has ``image_id, width, height``; ``digits`` carry ``angle`` and ``nid_seq``, the
    ``det_seq`` of the number box they were read in. The number is that of the last number
    box at the chosen angle, and empty without one. Texts that were not read are
    empty; showing them otherwise is up to the reader (``record_defaults``).
    ``with_boxes`` adds ``detected_fields``, the usable boxes in order. Everything an orientation could
    contribute is reduced per ``(image, angle)`` first, so the boxes are
    shuffled once, as partial aggregates, and choosing the angle works on at
    most four rows per image. Digits are shuffled once, dealt by number box: an image with very many
    boxes goes to many tasks, and blocks of a box, its number and its record meet where they are.
    An image without a card box at its best angle gets an error row in place of a record.
    """
    usable = F.col("class_name").isin(FIELDS) & (F.col("confidence") >= STAGE_FLOORS["field"])
    box = F.struct("x1", "y1", "x2", "y2")
    is_card = F.col("class_name") == "card"
    per_angle = detections.groupBy("image_id", "angle").agg(
        F.count_if(usable).alias("n"),
        exact_sum(F.when(usable, F.col("confidence"))).alias("total"),
        F.max_by(F.when(is_card, box), F.when(is_card, F.col("det_seq"))).alias("crop_box"),
        F.max(F.when(usable & (F.col("class_name") == "nid"), F.col("det_seq"))).alias("nid_seq"),
        *last_texts(usable),
        *([detected_boxes(usable).alias("detected_fields")] if with_boxes else []),
    )
    score = F.col("n") + F.coalesce(exact_mean(F.col("total"), F.col("n")), F.lit(0.0))
    boxes = ["detected_fields"] * with_boxes
    payload = F.struct("crop_box", "nid_seq", *LAST_TEXTS, *boxes).alias("payload")
    best = per_angle.groupBy("image_id").agg(
        F.max(F.struct(score.alias("score"), (-F.col("angle")).alias("order"), payload)).alias("top")
    )
    # Without any usable field the image stays at angle 0.
    upright = F.when((F.col("top.score") > 0) | (F.col("top.order") == 0), F.col("top.payload"))
    angle = F.when(F.col("top.score") > 0, -F.col("top.order")).otherwise(0)
    box_key = ["image_id", "angle", "nid_seq"]
    numbers = digit_assemble(digits.repartition(*box_key), *box_key)
    joined = (
        images.select("image_id", "width", "height")
        .join(best, "image_id", "left")
        .withColumns({"p": upright, "angle": angle})
        .withColumn("nid_seq", F.col("p.nid_seq"))
        .join(numbers, box_key, "left")
    )
    crop = bbox_pad_card(
        *[F.col(f"p.crop_box.{c}") for c in ("x1", "y1", "x2", "y2")], F.col("width"), F.col("height")
    )
    has_card = F.col("p.crop_box").isNotNull()
    fields = joined.select(
        "image_id", "angle",
        F.when(~has_card, "No ID card detected").alias("error"),
        F.when(has_card, F.coalesce("id_number", F.lit(""))).alias("id_number"),
        *[F.when(has_card, F.coalesce(f"p.{c}", F.lit(""))).alias(c) for c in LAST_TEXTS],
        *[F.when(has_card, c).alias(f"crop_{name}") for name, c in crop.items()],
        *[F.when(has_card, F.col(f"p.{c}")).alias(c) for c in boxes],
    )
    return governorate_lookup(decode_ids(fields)).withColumns(
        {
            "national_id": F.col("id_number"),
            "full_name": F.concat("first_name", F.lit(" "), "second_name"),
            "face_image": F.lit(None).cast("string"),
        }
    )


def detected_boxes(usable: Column) -> Column:
    """Aggregate with an image's usable boxes in order, as an envelope lists them."""
    box = F.array(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    entry = F.struct("det_seq", F.struct(F.col("class_name").alias("class"), "confidence", box.alias("bbox")).alias("box"))
    return F.transform(F.array_sort(F.collect_list(F.when(usable, entry))), lambda e: e["box"])


def stored_id_results(records: DataFrame, seconds: Column, path: Column, seq: Column) -> DataFrame:
    """Latest stored envelope per path from decoded ID records with their boxes.

    A number with a wrong century digit fails the request.
    """
    error = F.coalesce("error", F.when(F.col("decode_status") == "bad_century", BAD_CENTURY))
    rows = records.withColumns({"processing_time": seconds, "path": path, "seq": seq, "error": error})
    return result_upsert(envelope_write(rows, ID))


def passport_records(lines: DataFrame, countries: DataFrame) -> DataFrame:
    """Parsed passports with country names."""
    return country_lookup(parse_passports(lines), countries)


def stored_passport_results(
    records: DataFrame, seconds: Column, path: Column, seq: Column
) -> DataFrame:
    """Latest stored envelope per path; records keep ``zone_found`` and both lines."""
    error = mrz_read_error(F.col("zone_found"), F.col("line1"), F.col("line2"))
    rows = records.withColumns({"processing_time": seconds, "path": path, "seq": seq, "error": error})
    return result_upsert(envelope_write(rows, PASSPORT))


def capture_readiness(frames: DataFrame, fields: DataFrame, digits: DataFrame) -> DataFrame:
    """Frames with their facts, readiness and message."""
    usable = detection_filter(fields, "field")
    return capture_message(capture_ready(frame_facts(frames, usable, digits)))


def capture_from_pixels(shots: DataFrame, images: DataFrame, fields: DataFrame, digits: DataFrame) -> DataFrame:
    """Readiness of camera shots whose quality is measured from their images.

    ``shots`` has ``frame_id, session_id, ts, path``; ``images`` are image rows with the card's
    padded box. Quality is that of the whole frame, photo contrast that of the card. A
    shot without a readable image is not judged and carries an error.
    """
    facts = image_rows_quality(images).withColumnRenamed("error", "load_error")
    frames = (
        shots.join(facts, "path", "left")
        .withColumn("photo_variance", F.coalesce("variance", F.lit(0.0)))
        .withColumn("error", F.when(F.col("quality_level").isNull(), F.coalesce("load_error", F.lit(LOAD_ERROR))))
    )
    judged = capture_readiness(frames, fields, digits)
    results = ["photo_detected", "ready_for_capture", "message"]
    return judged.withColumns({c: F.when(F.col("error").isNull(), F.col(c)) for c in results})


def capture_result(shots: DataFrame, images: DataFrame, fields: DataFrame, digits: DataFrame) -> DataFrame:
    """The response record of every shot: what was found, photo box, quality and field summary.

    An unreadable image gives its error with nothing detected.
    """
    boxes = images.select("path", F.col("width").alias("frame_w"), F.col("height").alias("frame_h"), *CROP)
    counts = [F.count_if(F.col("field") == name).alias(name) for name in FIELDS]
    seen = detection_filter(fields, "field").groupBy("frame_id").agg(F.struct(*counts).alias("seen"))
    joined = (
        capture_from_pixels(shots, images, fields, digits)
        .join(boxes, "path", "left")
        .join(seen, "frame_id", "left")
    )
    read = F.col("error").isNull()
    region = photo_region(*[F.col(c) for c in CROP], F.col("frame_w"), F.col("frame_h"))
    photo = F.struct(
        *[c.alias(name) for name, c in region.items()], "variance", (F.col("variance") > PHOTO_CLEAR).alias("is_clear")
    )
    summary = F.struct(*[F.coalesce(F.col(f"seen.{name}"), F.lit(0)).alias(name) for name in FIELDS])
    return joined.select(
        "frame_id",
        "session_id",
        (read & (F.col("n_detections") > 0)).alias("detected"),
        "error",
        F.when(read, F.struct(F.col("photo_detected").alias("detected"), F.when(F.col("photo_detected"), photo).alias("bbox"))).alias("photo"),
        F.when(read, F.col("fields_found")).otherwise(0).alias("field_count"),
        F.when(read, F.col("n_detections")).alias("total_detections"),
        F.when(read, exact_round(F.col("mean_confidence"), 3)).alias("confidence"),
        F.when(read, F.struct(*QUALITY)).alias("quality"),
        "ready_for_capture",
        "message",
        F.when(read, summary).alias("field_summary"),
    )


def face_verification(id_faces: DataFrame, live_faces: DataFrame, threshold: float = 0.7) -> DataFrame:
    return face_similarity(face_pair_join(id_faces, live_faces), threshold)


def case_review(cases: DataFrame, status_events: DataFrame) -> DataFrame:
    """Review lines of every case with its current status and progress.

    ``cases`` has the ``step`` its person is at; progress follows from it alone.
    """
    progress = cases.select("case_id", progress_pct(F.col("step")).cast("bigint").alias("progress_pct"))
    return (
        review_unpivot(cases)
        .join(status_latest(status_events), "case_id", "left")
        .join(progress, "case_id", "left")
    )
