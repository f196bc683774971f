"""Boundary tables of the scalar rules, written by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from kredenz.dims import GOVERNORATES
from kredenz.functions import boxes, faces, images, mrz, national_id, status, text
from kredenz.operators import assets, cases, documents, results


def one(spark, columns, **values):
    """Evaluate named columns over a single row of values."""
    schema = ", ".join(
        f"{k} {'int' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}"
        for k, v in values.items()
    )
    row = spark.createDataFrame([tuple(values.values())], schema)
    return row.select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


@pytest.mark.parametrize(
    "number, expected",
    [
        (None, ("short", "Unknown", None, "Unknown")),
        ("", ("short", "Unknown", None, "Unknown")),
        ("2900101011234", ("short", "Unknown", None, "Unknown")),
        ("29001010112345", ("ok", "1990-01-01", "01", "Female")),
        ("29001010112335", ("ok", "1990-01-01", "01", "Male")),
        ("290010101123459", ("ok", "1990-01-01", "01", "Female")),
        ("30513402112395", ("ok", "2005-13-40", "21", "Male")),
        ("19001010112345", ("bad_century", "Unknown", None, "Unknown")),
        ("49001010112345", ("bad_century", "Unknown", None, "Unknown")),
        ("X9001010112345", ("unparsable", "Unknown", None, "Unknown")),
        ("290010101123X5", ("unparsable", "Unknown", None, "Unknown")),
        ("290010101X2345", ("ok", "1990-01-01", "01", "Female")),
        ("٢٩٠٠١٠١٠١١٢٣٤٥", ("ok", "1990-01-01", "01", "Female")),
        ("39001010112305", ("ok", "2090-01-01", "01", "Female")),
    ],
)
def test_decode_national_id(spark, number, expected):
    got = one(spark, national_id.decode_national_id(F.col("n")), n=number)
    assert (got["decode_status"], got["birth_date"], got["governorate_code"], got["gender"]) == expected


def test_decoded_date_only_when_it_exists(spark):
    good = one(spark, national_id.decode_national_id(F.col("n")), n="29002280112345")
    bad = one(spark, national_id.decode_national_id(F.col("n")), n="29002300112345")
    assert good["birth_date_valid"] == datetime.date(1990, 2, 28)
    assert bad["birth_date"] == "1990-02-30" and bad["birth_date_valid"] is None


def test_governorates(spark):
    codes = spark.createDataFrame([(c,) for c in [*GOVERNORATES, "99", None]], "governorate_code string")
    rows = {r.governorate_code: r.governorate for r in documents.governorate_lookup(codes).collect()}
    assert len(GOVERNORATES) == 28
    assert rows == {**GOVERNORATES, "99": "Unknown", None: "Unknown"}


LINE1 = "P<EGYIBRAHIM<<AHMED<ALI<<<<<<<<<<<<<<<<<<<<<<"
LINE2 = "A1234567<8EGY9002285M3001019<<<<<<<<<<<<<<02"


def test_mrz_parse(spark):
    got = one(spark, mrz.mrz_parse(F.col("a"), F.col("b")), a=LINE1, b=LINE2)
    assert got == {
        "surname": "IBRAHIM", "name": "AHMED ALI", "sex": "M", "date_of_birth": "28/02/2090",
        "nationality": "EGY", "passport_type": "P", "passport_number": "A1234567",
        "issuing_country": "EGY", "expiration_date": "01/01/2030", "parse_error": None,
    }


def test_mrz_short_and_missing_lines(spark):
    short = one(spark, mrz.mrz_parse(F.col("a"), F.col("b")), a="P<EGYalone", b="a1")
    assert (short["surname"], short["name"], short["passport_number"]) == ("ALONE", "", "A1")
    assert (short["sex"], short["date_of_birth"], short["nationality"]) == ("F", "<<<<<<", "")
    missing = one(spark, mrz.mrz_parse(F.col("a"), F.col("b")), a=LINE1, b=None)
    assert missing["parse_error"] and missing["surname"] is None


def test_mrz_name_splits_once(spark):
    got = one(spark, mrz.mrz_parse(F.col("a"), F.col("b")), a="P<EGYone<<two<<three", b=LINE2)
    assert (got["surname"], got["name"]) == ("ONE", "TWO  THREE")


@pytest.mark.parametrize(
    "raw, expected",
    [("900228", "28/02/2090"), ("901301", "901301"), ("990230", "990230"), ("<<<<<<", "<<<<<<"),
     ("20000229", "29/02/2000"), ("000229", "29/02/2000"), ("", "")],
)
def test_mrz_date(spark, raw, expected):
    assert one(spark, {"d": mrz.mrz_date(F.col("r"))}, r=raw)["d"] == expected


def test_mrz_date_pivot(spark):
    assert one(spark, {"d": mrz.mrz_date(F.col("r"), pivot=30)}, r="900228")["d"] == "28/02/1990"
    assert one(spark, {"d": mrz.mrz_date(F.col("r"), pivot=30)}, r="300228")["d"] == "28/02/2030"


def test_mrz_sex_and_clean(spark):
    got = {c: one(spark, {"s": mrz.mrz_sex(F.col("c"))}, c=c)["s"] for c in ["M", "m", "0", "F", "f", "<", "x", ""]}
    assert got == {"M": "M", "m": "M", "0": "M", "F": "F", "f": "F", "<": "F", "x": "F", "": "F"}
    assert one(spark, {"c": mrz.mrz_clean(F.col("t"))}, t="a-é 9<_")["c"] == "AÉ9"


def test_country_first_entry_wins(spark):
    countries = spark.createDataFrame(
        [(1, "EGY", "Egypt"), (5, "EGY", "Other"), (2, "FRA", "France")], "list_pos int, alpha3 string, name string"
    )
    people = spark.createDataFrame(
        [(1, "EGY", "FRA"), (2, "XXX", "EGY")], "id int, nationality string, issuing_country string"
    )
    rows = {r.id: (r.nationality, r.issuing_country) for r in documents.country_lookup(people, countries).collect()}
    assert rows == {1: ("EGYPT", "FRANCE"), 2: ("XXX", "EGYPT")}
    empty = documents.country_lookup(people, countries.limit(0))
    assert {r.id: r.nationality for r in empty.collect()} == {1: "EGY", 2: "XXX"}


def test_boxes(spark):
    grown = one(spark, boxes.bbox_expand(F.col("y1"), F.col("y2"), F.lit(100)), y1=10, y2=31)
    assert grown == {"y1": 5, "y2": 35}  # height 21 -> 31, half 15, centre 20
    clipped = one(spark, boxes.bbox_expand(F.col("y1"), F.col("y2"), F.lit(100)), y1=0, y2=99)
    assert clipped == {"y1": 0, "y2": 100}
    sides = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    card = one(spark, boxes.bbox_pad_card(*sides, F.lit(800), F.lit(600)), x1=100, y1=100, x2=500, y2=500)
    assert card == {"x1": 80, "y1": 60, "x2": 520, "y2": 560}
    live = one(spark, boxes.bbox_pad_card(*sides, F.lit(800), F.lit(600), flat=20), x1=5, y1=100, x2=790, y2=595)
    assert live == {"x1": 0, "y1": 80, "x2": 800, "y2": 600}
    band = one(spark, boxes.nid_band(F.col("y1"), F.col("y2"), F.lit(600)), y1=100, y2=143)
    assert band == {"y1": 90, "y2": 153}


@pytest.mark.parametrize(
    "w, h, expected",
    [(1500, 1500, (1500, 1500, "keep")), (1501, 1000, (1000, 666, "shrink")), (1000, 3000, (400, 1000, "shrink")),
     (2000, 2000, (1000, 1000, "shrink")), (200, 300, (400, 600, "enlarge")), (400, 299, (401, 300, "enlarge")),
     (400, 300, (400, 300, "keep")), (4000, 100, (1000, 300, "shrink"))],
)
def test_resize_plan(spark, w, h, expected):
    got = one(spark, images.resize_plan(F.col("w"), F.col("h")), w=w, h=h)
    assert (got["new_width"], got["new_height"], got["action"]) == expected


@pytest.mark.parametrize(
    "size, target, needs",
    [(0, 1000, False), (1024 * 1000, 1000, False), (1024 * 1000 + 1, 1000, True), (1 << 20, 1000, True),
     ((1 << 20) + 1, 1000, True), ((2 << 20) + 1, 800, True), (4 << 20, 800, True), ((4 << 20) + 1, 500, True)],
)
def test_compress_plan(spark, size, target, needs):
    got = one(spark, images.compress_plan(F.col("b")), b=size)
    assert (got["target_kb"], got["needs"]) == (target, needs)
    assert got["recommended"] == (size > 1 << 20)


def test_chosen_sizes_go_first(spark):
    got = one(spark, images.compress_plan(F.col("b"), target_kb=500, quality=0.6), b=600 * 1024)
    assert (got["needs"], got["target_kb"], got["quality"], got["max_w"]) == (True, 500, 0.6, 1600)


def test_empty_sizes_do_not_fail(spark):
    plan = images.compress_plan(F.col("b"), F.lit(0))
    assert one(spark, plan, b=0)["saved_pct"] is None
    assert one(spark, images.resize_plan(F.col("w"), F.col("h")), w=0, h=0)["action"] == "enlarge"


def test_photo_region(spark):
    sides = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    got = one(spark, boxes.photo_region(*sides, F.lit(800), F.lit(600)), x1=80, y1=60, x2=589, y2=360)
    assert [got[c] for c in ("x1", "y1", "x2", "y2", "width", "height")] == [80, 60, 232, 360, 152, 300]
    assert [got[f"{c}_norm"] for c in ("x1", "y1", "x2", "y2")] == [0.1, 0.1, 0.29, 0.6]


def test_fit_within(spark):
    fit = images.fit_within(F.col("w"), F.col("h"), F.lit(1200), F.lit(1200))
    assert one(spark, fit, w=2400, h=1200) == {"fit_w": 1200.0, "fit_h": 600.0}
    assert one(spark, fit, w=1200, h=2400) == {"fit_w": 600.0, "fit_h": 1200.0}
    assert one(spark, fit, w=100, h=50) == {"fit_w": 100.0, "fit_h": 50.0}


@pytest.mark.parametrize(
    "lap, grey, w, h, level, score",
    [(100.0, 128.0, 640, 480, "good", 100), (50.0, 128.0, 640, 480, "good", 75), (49.9, 128.0, 640, 480, "medium", 74),
     (0.0, 128.0, 640, 480, "medium", 50), (0.0, 50.0, 640, 480, "poor", 35), (0.0, 200.0, 640, 480, "poor", 35),
     (100.0, 49.0, 399, 300, "good", 75), (60.0, 201.0, 399, 300, "medium", 54), (50.0, 10.0, 400, 299, "medium", 50)],
)
def test_quality_band(spark, lap, grey, w, h, level, score):
    got = one(spark, images.quality_band(*[F.col(c) for c in "lgwh"]), l=lap, g=grey, w=w, h=h)
    assert (got["quality_level"], got["quality_score"]) == (level, score)
    assert (got["is_blurry"], got["is_too_dark"], got["is_too_bright"]) == (lap < 50, grey < 50, grey > 200)


@pytest.mark.parametrize(
    "raw, clean, ok",
    [(" a  b", "a-b", False), ("../x", "x", False), ("a//b/", "a/b", False), ("-/a", "a", True),
     ("...", ".", False), ("docs/x_1.png", "docs/x_1.png", True), ("/a", "a", False), ("a b", "a-b", False),
     ("--a--b--", "a-b", True), ("é!", "", False), ("a/-/", "a", False)],
)
def test_paths(spark, raw, clean, ok):
    got = one(spark, {"c": text.path_sanitize(F.col("p")), "ok": text.path_valid(F.col("p"))}, p=raw)
    assert got == {"c": clean, "ok": ok}


def test_phone_mask(spark):
    got = {p: one(spark, {"m": text.phone_mask(F.col("p"))}, p=p)["m"] for p in ["", "1234", "12345", "+20 1001", "+201001234567"]}
    assert got == {"": "", "1234": "1234", "12345": "*2345", "+20 1001": "+** 1001", "+201001234567": "+********4567"}


@pytest.mark.parametrize(
    "size, label",
    [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1280, "1.3 KB"), (1048575, "1024.0 KB"), (1048576, "1.0 MB"),
     (5 * 1048576 + 524288, "5.5 MB")],
)
def test_size_label(spark, size, label):
    assert one(spark, {"s": text.size_label(F.col("b"))}, b=size)["s"] == label


def test_confidence_band(spark):
    got = {c: tuple(one(spark, text.confidence_band(F.col("c")), c=c).values()) for c in [0.8, 0.801, 0.6, 0.601, 1.0, 0.0]}
    assert got == {
        0.8: ("yellow", "80.0%"), 0.801: ("green", "80.1%"), 0.6: ("red", "60.0%"),
        0.601: ("yellow", "60.1%"), 1.0: ("green", "100.0%"), 0.0: ("red", "0.0%"),
    }


def test_face_bands(spark):
    got = {s: one(spark, faces.match_band(F.col("s")), s=s) for s in [0.6, 0.61, 0.7, 0.71, 0.8, 0.81]}
    assert {s: (g["is_match"], g["confidence"]) for s, g in got.items()} == {
        0.6: (False, "low"), 0.61: (False, "medium"), 0.7: (False, "medium"),
        0.71: (True, "medium"), 0.8: (True, "medium"), 0.81: (True, "high"),
    }


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(faces.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(2**-0.5) and got[1] == 0.0


def test_progress(spark):
    assert [one(spark, {"p": status.progress_pct(F.col("s"))}, s=s)["p"] for s in range(1, 7)] == [0, 21, 43, 64, 100, 100]
    steps = [(1, 5), (3, 5), (5, 5), (9, 5), (0, 5), (1, 1), (2, 4)]
    got = [one(spark, {"p": status.stepper_pct(F.col("s"), F.col("n"))}, s=s, n=n)["p"] for s, n in steps]
    assert got == [0, 50, 100, 100, 0, 100, 33]


def test_status_flags(spark):
    got = one(spark, status.status_flags(F.col("s")), s="document_verified")
    assert got == {"document_done": True, "verification_done": True, "otp_done": False, "complete_done": False}
    assert not any(one(spark, status.status_flags(F.col("s")), s="rejected").values())


@pytest.mark.parametrize(
    "kind, n, error",
    [("id", 0, "No image data provided"), ("passport", 0, "No image data provided"), ("passport", 1, None),
     ("id", 99, "Data too small to be a valid image: 99 bytes"), ("id", 100, None),
     ("live", 99, "Data too small to be a valid image"), ("live", 100, None)],
)
def test_upload_guard(spark, kind, n, error):
    rows = spark.createDataFrame([(kind, "x" * n)], "doc_type string, content string")
    assert assets.upload_guard(rows).first().guard_error == error


def test_field_fallback_and_label(spark):
    df = spark.createDataFrame(
        [({"full_name": "", "first_name": "A", "secondName": "B"},), ({"firstName": "C"},), ({"x": "y"},)],
        "m map<string,string>",
    )
    got = [r[0] for r in df.select(text.field_fallback(F.col("m"), "full_name")).collect()]
    assert got == ["A B", "C", ""]
    label = {k: one(spark, {"l": text.field_label(F.col("k"))}, k=k)["l"] for k in ["birthDate", "full_name", "IDNumber", ""]}
    assert label == {"birthDate": "Birth Date", "full_name": "Full_name", "IDNumber": " I D Number", "": ""}


def test_rating_values_are_not_checked(spark):
    log = spark.createDataFrame([(1, 7, 3), (2, 7, 9), (3, 1, 0)], "seq int, doc_id int, rating int")
    assert [(r.doc_id, r.rating) for r in cases.rating_latest(log).collect()] == [(1, 0), (7, 9)]


def test_result_summary_reports_bad_json_only_for_its_row(spark):
    log = spark.createDataFrame(
        [("id", "a", '{"extracted_data":{"full_name":"N"},"processing_time":1.5}'), ("id", "b", "{oops"),
         ("id", "c", "null"), ("passport", "d", '{"data":{"surname":"S"}}'), ("passport", "e", "{}"), ("id", "f", "12")],
        "doc_type string, path string, result_json string",
    )
    got = {r.path: (r.processing_time, r.name, r.document_no, r.parse_error) for r in results.result_summary(log).collect()}
    assert got == {
        "a": (1.5, "N", "N/A", None), "b": (None, None, None, "Error parsing b"),
        "c": (None, None, None, "Error parsing c"), "d": (None, "S ", "N/A", None),
        "e": (None, " ", "N/A", None), "f": (None, "N/A", "N/A", None),
    }
