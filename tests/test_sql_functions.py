"""SQL functions give what their column forms give, and their plans are plain expressions."""

import pytest
from pyspark.sql import functions as F

from kredenz.functions.sql import RULES, column_form, register
from kredenz.sources.tables import Inputs

BOX = ["x1", "y1", "x2", "y2"]
SIZE = ["img_width", "img_height"]

#: Table and arguments of each function; others take texts, numbers or keys of the tables named below.
ON = {
    "bbox_expand": ("detections", ["y1", "y2", "img_height"]),
    "bbox_pad_card": ("detections", [*BOX, *SIZE]),
    "bbox_pad_live": ("detections", [*BOX, *SIZE]),
    "bbox_globalize": ("detections", [*BOX, "cast(l_suppkey % 40 AS INT)", "cast(l_partkey % 30 AS INT)", *SIZE]),
    "photo_region": ("detections", [*BOX, *SIZE]),
    "nid_band": ("detections", ["y1", "y2", "img_height"]),
    "confidence_band": ("detections", ["confidence"]),
    "resize_plan": ("file_sizes", ["width", "height"]),
    "compress_plan": ("file_sizes", ["bytes", "bytes div 3"]),
    "fit_within": ("file_sizes", ["width", "height", "1200", "900"]),
    "quality_band": ("file_sizes", ["bytes / 1e5", "bytes % 256 / 1.0D", "width", "height"]),
    "size_label": ("file_sizes", ["bytes"]),
    "path_sanitize": ("paths", ["path"]),
    "path_valid": ("paths", ["path"]),
    "field_label": ("paths", ["path"]),
    "phone_mask": ("phones", ["phone"]),
    "status_flags": ("status_events", ["status"]),
    "progress_pct": ("status_events", ["cast(event_id % 6 + 1 AS INT)"]),
    "stepper_pct": ("status_events", ["cast(event_id % 8 AS INT)", "cast(event_id % 7 AS INT)"]),
}
LINE1 = "concat('P<EGY', translate(upper(phone), '+0123456789', '<ABCDEFGHIJ'), '<<', repeat('NAME<', cast(event_id % 9 AS INT)))"
LINE2 = "CASE WHEN event_id % 11 > 0 THEN concat('A1234567<8', 'EGY', lpad(event_id * 7919 % 1000000, 6, '0'), '1', substr('MF0<m', cast(event_id % 5 + 1 AS INT), 1), '300101') END"
ID = "concat(event_id % 4, lpad(event_id * 7919 % 1000000, 6, '0'), substr('٠١٢3456789x', 1, cast(event_id % 11 AS INT)), '1')"
EVENTS = {
    "ascii_digits": [ID], "decode_national_id": [ID], "mrz_parse": [LINE1, LINE2], "mrz_clean": [LINE1],
    "mrz_sex": ["substr('MFmf0<', cast(event_id % 7 AS INT), 1)"], "mrz_date": ["lpad(event_id * 7919 % 1000000, cast(4 + event_id % 5 AS INT), '0')"],
    "mrz_read_error": ["event_id % 3 > 0", LINE1, LINE2],
}


@pytest.fixture(scope="module")
def registered(spark):
    return register(spark)


def test_every_rule_is_registered(spark, registered):
    assert set(registered) == set(RULES) and register(spark, "phone_mask", prefix="kz_") == ["kz_phone_mask"]
    assert all(spark.catalog.functionExists(name) for name in registered)


@pytest.mark.parametrize("rule", sorted(RULES))
def test_equals_the_column_form(spark, folder, registered, rule):
    t = Inputs(spark, folder)
    if rule.startswith("field_") and rule != "field_label":
        table, arguments = t.case_docs(), ["ocr_fields"]
    elif rule in EVENTS:
        table, arguments = t.otp_events(), EVENTS[rule]
    else:
        table, arguments = getattr(t, ON[rule][0])(), ON[rule][1]
    kinds = [p.strip().split(" ", 1)[1] for p in RULES[rule][0].replace("MAP<STRING, STRING>", "MAP<STRING,STRING>").split(", ")]
    cast = [f"cast({a} AS {kind})" for a, kind in zip(arguments, kinds, strict=True)]
    both = table.select(
        F.expr(f"{rule}({', '.join(cast)})").alias("sql"), column_form(rule, *map(F.expr, cast)).alias("columns")
    )
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "SubqueryAlias" not in plan and f"{rule}(" not in plan and " Join " not in plan
    differ = both.where("NOT sql <=> columns")
    assert both.count() > 0 and both.where("columns IS NOT NULL").count() > 0
    assert differ.limit(3).collect() == []
    nothing = spark.range(1).select(F.expr(f"{rule}({', '.join(f'cast(null AS {k})' for k in kinds)})").alias("sql"))
    assert nothing.count() == 1


def test_results_of_several_parts_are_structs(spark, registered):
    got = spark.sql("SELECT decode_national_id('29001011234567').gender, mrz_date('850320'), path_sanitize(' a  b//c ')").first()
    assert tuple(got) == ("Female", "20/03/2085", "a-b/c")
