"""The column rules as SQL functions.

``register(spark)`` makes a temporary SQL function of every rule in ``RULES``, so that
``SELECT phone_mask(phone) FROM events`` runs the expression its column form builds: Spark puts a
function's body in place of each call, and the optimizer sees through it. A rule with several results
returns a struct: ``SELECT decode_national_id(id_number).gender FROM people``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, SparkSession, functions as F

from kredenz.functions import boxes, images, mrz, national_id, status, text

Rule = tuple[str, Callable[..., "Column | dict[str, Column]"]]

SIDES = "x1 INT, y1 INT, x2 INT, y2 INT"
SIZE = "img_width INT, img_height INT"

# Shown fields and the keys that may stand in for them.
STAND_INS = {
    "full_name": ["first_name", "second_name", "name"],
    "national_id": ["id", "national_id_number"],
    "address": ["location", "residence"],
    "birth_date": ["date_of_birth", "birthday"],
    "gender": ["sex"],
    "governorate": ["state", "province"],
}

#: Parameters and column form of each function.
RULES: dict[str, Rule] = {
    "ascii_digits": ("value STRING", national_id.ascii_digits),
    "decode_national_id": ("id_number STRING", national_id.decode_national_id),
    "mrz_parse": ("line1 STRING, line2 STRING", mrz.mrz_parse),
    "mrz_clean": ("value STRING", mrz.mrz_clean),
    "mrz_sex": ("code STRING", mrz.mrz_sex),
    "mrz_date": ("yymmdd STRING", mrz.mrz_date),
    "mrz_read_error": ("zone_found BOOLEAN, line1 STRING, line2 STRING", mrz.mrz_read_error),
    "bbox_expand": ("y1 INT, y2 INT, img_height INT", boxes.bbox_expand),
    "bbox_pad_card": (f"{SIDES}, {SIZE}", boxes.bbox_pad_card),
    "bbox_pad_live": (f"{SIDES}, {SIZE}", partial(boxes.bbox_pad_card, flat=20)),
    "bbox_globalize": (f"{SIDES}, off_x INT, off_y INT, {SIZE}", boxes.bbox_globalize),
    "photo_region": (f"{SIDES}, {SIZE}", boxes.photo_region),
    "nid_band": ("y1 INT, y2 INT, img_height INT", boxes.nid_band),
    "resize_plan": ("width INT, height INT", images.resize_plan),
    "compress_plan": ("size BIGINT, compressed BIGINT", images.compress_plan),
    "fit_within": ("width INT, height INT, max_w INT, max_h INT", images.fit_within),
    "quality_band": ("laplacian_variance DOUBLE, mean_grey DOUBLE, width INT, height INT", images.quality_band),
    "path_sanitize": ("path STRING", text.path_sanitize),
    "path_valid": ("path STRING", text.path_valid),
    "phone_mask": ("phone STRING", text.phone_mask),
    "size_label": ("size BIGINT", text.size_label),
    "field_label": ("key STRING", text.field_label),
    "confidence_band": ("confidence DOUBLE", text.confidence_band),
    "status_flags": ("status STRING", status.status_flags),
    "progress_pct": ("step INT", status.progress_pct),
    "stepper_pct": ("step INT, total INT", status.stepper_pct),
    **{
        f"field_{shown}": ("fields MAP<STRING, STRING>", partial(text.field_fallback, key=shown, fallbacks=keys))
        for shown, keys in STAND_INS.items()
    },
}


def column_form(rule: str, *arguments: Column) -> Column:
    """A rule's result as one column."""
    built = RULES[rule][1](*arguments)
    return F.struct(*[c.alias(name) for name, c in built.items()]) if isinstance(built, dict) else built


def body(spark: SparkSession, rule: str) -> tuple[str, str]:
    """The SQL text of a rule over its parameters, and the type of its result."""
    empty = spark.createDataFrame([], RULES[rule][0])
    built = empty.select(column_form(rule, *map(F.col, empty.columns)).alias("out"))
    analyzed = built._jdf.queryExecution().analyzed()
    return analyzed.expressions().head().child().sql(), built.schema["out"].dataType.simpleString()


def register(spark: SparkSession, *rules: str, prefix: str = "") -> list[str]:
    """Create or replace temporary functions of these rules, of all if none is named; returns their names."""
    rules = rules or tuple(RULES)
    for rule in rules:
        text_, kind = body(spark, rule)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{rule}({RULES[rule][0]}) RETURNS {kind} RETURN {text_}")
    return [f"{prefix}{rule}" for rule in rules]
