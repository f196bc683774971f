"""The inputs reach every branch of the rules, so matching SQL means something."""

from pyspark.sql import functions as F

from kredenz.operators import capture, documents, otp, quality, results
from kredenz.plans import flows
from kredenz.plans.catalog import QUERIES, TEST_TTL, _facts
from kredenz.sources.tables import Inputs

FOLDER = "/root/testdata/sf0.01"


def counts(df, column):
    return {r[0]: r[1] for r in df.groupBy(column).count().collect()}


def test_national_ids(spark):
    ids = documents.governorate_lookup(documents.decode_ids(Inputs(spark, FOLDER).national_ids())).cache()
    assert counts(ids, "decode_status") == {"ok": 1500 - 30 - 25 - 16, "short": 30, "unparsable": 25, "bad_century": 16}
    assert set(counts(ids, "gender")) == {"Male", "Female", "Unknown"}
    assert ids.where("governorate <> 'Unknown'").count() > 300
    assert not ids.where("decode_status = 'ok' AND birth_date_valid IS NULL").isEmpty()


def test_passports(spark):
    rows = documents.parse_passports(Inputs(spark, FOLDER).mrz_lines()).cache()
    assert rows.where("parse_error IS NOT NULL").count() > 30
    assert set(counts(rows.where("parse_error IS NULL"), "sex")) == {"M", "F"}
    for condition in ("name = ''", "name LIKE '%  %'", "length(date_of_birth) = 6", "length(date_of_birth) = 10",
                      "expiration_date = '<<<<<<'"):
        assert not rows.where(condition).isEmpty(), condition
    named = documents.country_lookup(rows, Inputs(spark, FOLDER).countries())
    assert not named.where("nationality LIKE 'NATION%'").isEmpty()
    assert not named.where("length(nationality) = 3").isEmpty()
    assert named.where("nationality = 'SECOND ENTRY'").isEmpty()


def test_images(spark):
    t = Inputs(spark, FOLDER)
    rows = quality.image_quality(t.image_rows()).cache()
    assert counts(rows, "quality_level") == {"good": 301, "medium": 91, "poor": 92, None: 16}
    assert counts(rows, "size_ok") == {True: 20, False: 464, None: 16}
    assert len(counts(rows, "feedback")) >= 5
    photo = quality.photo_variance(t.image_rows()).where("variance IS NOT NULL")
    bands = photo.selectExpr("CASE WHEN variance > 200 THEN 2 WHEN variance > 100 THEN 1 ELSE 0 END AS b")
    assert counts(bands, "b") == {2: 55, 1: 26, 0: 306}


def test_frames(spark):
    rows = capture.capture_message(_facts(Inputs(spark, FOLDER))).cache()
    kinds = rows.selectExpr("regexp_replace(message, '[0-9]+/|Missing: [A-Za-z, ]+', '') AS kind", "frame_id")
    assert len(counts(kinds, "kind")) >= 11
    assert set(counts(rows, "ready_for_capture")) == {True, False}
    assert rows.where("n_detections = 0").count() == 436


def test_low_confidence_is_not_ready(spark):
    facts = _facts(Inputs(spark, FOLDER)).where("ready_for_capture")
    low = capture.capture_ready(facts.withColumn("mean_confidence", F.lit(0.4)))
    high = capture.capture_ready(facts.withColumn("mean_confidence", F.lit(0.401)))
    assert low.where("ready_for_capture").isEmpty() and high.where("NOT ready_for_capture").isEmpty()


def test_faces(spark):
    t = Inputs(spark, FOLDER)
    rows = flows.face_verification(t.id_faces(), t.live_faces()).cache()
    assert set(counts(rows, "confidence")) == {"high", "medium", "low", None}
    assert set(counts(rows, "is_match")) == {True, False, None}
    # no score close enough to a threshold for float order to matter
    assert rows.where("least(abs(similarity_score - 0.6), abs(similarity_score - 0.7), abs(similarity_score - 0.8)) < 1e-6").isEmpty()


def test_codes(spark):
    rows = otp.otp_replay(Inputs(spark, FOLDER).otp_events(), TEST_TTL)
    kinds = rows.selectExpr("regexp_replace(message, '[0-9]+', 'N') AS kind")
    assert counts(kinds, "kind") == {
        "OTP sent successfully!": 4398, "Twilio error N: {}": 360, "HTTP request failed: Timeout": 188, "OTP already sent. Please wait N seconds.": 1059, "OTP expired.": 2924,
        "OTP verified successfully!": 493, "Invalid OTP.": 157, "No OTP requested for this phone.": 421,
    }


def test_records(spark):
    rows = QUERIES["national_id_records"](spark, FOLDER).cache()
    assert {"ok", "short", "bad_century"} <= set(counts(rows, "decode_status"))
    assert set(counts(rows, "angle")) == {0, 90, 180, 270}
    assert rows.where("error IS NULL").count() > 1000 and rows.where("error IS NOT NULL").count() > 1000
    assert rows.where("error IS NULL AND governorate <> 'Unknown'").count() > 10
    assert rows.where("error IS NULL AND national_id = ''").count() > 1000
    stored = QUERIES["national_id_results"](spark, FOLDER).cache()
    assert not stored.where("result_json LIKE '%Invalid century digit%'").isEmpty()
    assert not stored.where("result_json LIKE '%detected_fields\":[{%'").isEmpty()
    names = counts(QUERIES["national_id_summary"](spark, FOLDER), "document_no")
    assert names["N/A"] > 100 and len(names) > 20


def test_rows_that_have_nothing_are_kept(spark):
    """Rows without a type, a line, a box, a face or a field."""
    t = Inputs(spark, FOLDER)
    sizes = {
        "doc_type_dispatch": 3000, "field_last_wins": 15000, "face_similarity": 500, "face_verification": 500,
        "mrz_sex": 1500, "mrz_date": 1500, "upload_guard": 2000, "result_counts": 3, "capture_result": 10000,
    }
    for name, size in sizes.items():
        assert QUERIES[name](spark, FOLDER).count() == size, name
    assert not t.mixed_payloads().where("doc_type IS NULL").isEmpty()
    assert QUERIES["field_last_wins"](spark, FOLDER).where("full_name = ' '").count() > 100
    errors = counts(QUERIES["face_similarity"](spark, FOLDER), "error")
    assert len(errors) == 3 and min(errors.values()) > 10
    assert len(counts(QUERIES["outcall_results"](spark, FOLDER).where("result_json LIKE '%status%'"), "result_json")) == 2
    review = QUERIES["review_unpivot"](spark, FOLDER).cache()
    assert review.where("label = 'Phone'").count() == review.select("case_id").distinct().count()
    assert not review.where("label = 'Document' AND value = '—'").isEmpty()
    empty = results.result_counts(t.ocr_results().limit(0), t.asset_chunks().limit(0)).collect()
    assert {(r.store, r.n) for r in empty} == {("id", 0), ("passport", 0), ("documents", 0)}


def test_passport_failures(spark):
    stored = QUERIES["envelope_write"](spark, FOLDER).cache()
    for text, zone in (("Could not detect Machine", "false"), ("Insufficient OCR results", "true")):
        rows = stored.where(F.col("result_json").contains(text))
        assert rows.count() > 10
        assert rows.where(~F.col("result_json").contains(f'"mrz_detected":{zone}')).isEmpty()


def test_capture_records(spark):
    rows = QUERIES["capture_result"](spark, FOLDER).cache()
    kinds = counts(rows.where("error IS NULL"), "photo_is_clear")
    assert set(kinds) == {True, False, None}
    assert rows.where("error IS NOT NULL AND (detected OR field_count > 0 OR quality_score IS NOT NULL)").isEmpty()


def test_results(spark):
    rows = QUERIES["result_summary"](spark, FOLDER).cache()
    for condition in ("name = 'N/A'", "document_no = 'N/A'", "parse_error IS NOT NULL", "processing_time IS NULL", "name = ' '"):
        assert not rows.where(condition).isEmpty(), condition
    assert len(counts(QUERIES["artifact_unpivot"](spark, FOLDER), "artifact_kind")) == 5


def test_scalars(spark):
    assert set(counts(QUERIES["resize_plan"](spark, FOLDER), "action")) == {"shrink", "enlarge", "keep"}
    assert set(counts(QUERIES["compress_plan"](spark, FOLDER), "target_kb")) == {500, 800, 1000}
    assert set(counts(QUERIES["detection_rate"](spark, FOLDER), "band")) == {"high", "medium", "low"}
    assert set(counts(QUERIES["confidence_band"](spark, FOLDER), "band")) == {"green", "yellow", "red"}
    assert set(counts(QUERIES["path_valid"](spark, FOLDER), "raw_ok")) == {True, False}
    assert len(counts(QUERIES["rating_join"](spark, FOLDER), "rating_label")) == 6
    assert len(counts(QUERIES["status_latest"](spark, FOLDER), "status")) == 7
    assert len(counts(QUERIES["upload_guard"](spark, FOLDER), "guard_error")) >= 5
