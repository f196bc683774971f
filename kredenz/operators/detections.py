"""Reducing detected boxes to per-image facts.

A detection row has ``image_id, det_seq, class_name, confidence, x1..y2`` and,
where used, ``angle`` and ``text``. ``det_seq`` is any sortable value that is
unique inside an image. Every reduction is an aggregate with map-side partial
results, so an image with very many boxes does not land in one task whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from kredenz.dims import ANGLES, FIELD_LABELS, FIELDS, OPTIONAL_FIELDS, REQUIRED_FIELDS, STAGE_FLOORS
from kredenz.functions.numbers import exact_mean, exact_round, exact_sum, exact_units


def detection_filter(detections: DataFrame, stage: str | Column) -> DataFrame:
    """Keep boxes at or above the confidence floor of their stage."""
    if isinstance(stage, str):
        return detections.where(F.col("confidence") >= STAGE_FLOORS[stage])
    floor = F.coalesce(*[F.when(stage == name, value) for name, value in STAGE_FLOORS.items()])
    return detections.where(F.col("confidence") >= floor)


def _known() -> Column:
    return F.col("class_name").isin(FIELDS)


def _scores(detections: DataFrame, images: DataFrame) -> DataFrame:
    """One row per image with an array of the four orientation scores."""
    usable = _known() & (F.col("confidence") >= STAGE_FLOORS["field"])
    aggregates = []
    for angle in ANGLES:
        here = F.col("angle") == angle
        aggregates.append(exact_sum(F.when(here, F.col("confidence"))).alias(f"sum_{angle}"))
        for name in FIELDS:
            hit = here & (F.col("class_name") == name)
            aggregates.append(F.count_if(hit).alias(f"{name}_{angle}"))
    # The usable rows only: the filter runs before the shuffle.
    totals = detections.where(usable).groupBy("image_id").agg(*aggregates)

    def score(angle: int) -> Column:
        counts = [F.coalesce(F.col(f"{name}_{angle}"), F.lit(0)) for name in FIELDS]
        n = sum(counts[1:], counts[0])
        mean = F.coalesce(exact_mean(F.col(f"sum_{angle}"), n), F.lit(0.0))
        return F.struct(
            F.lit(angle).alias("angle"),
            n.alias("field_count"),
            mean.alias("avg_conf"),
            F.when(n > 0, n + mean).otherwise(0.0).alias("score"),
            F.array_compact(
                F.array(*[F.when(c > 0, name) for name, c in zip(FIELDS, counts)])
            ).alias("fields"),
            *[c.alias(f"n_{name}") for name, c in zip(FIELDS, counts)],
        )

    return (
        images.select("image_id")
        .join(totals, "image_id", "left")
        .select("image_id", F.array(*[score(a) for a in ANGLES]).alias("scores"))
    )


def orientation_score(detections: DataFrame, images: DataFrame) -> DataFrame:
    """Score of each image at each of the four angles; zero rows are kept.

    ``fields`` names the classes seen in fixed order and the ``n_`` columns
    count them, so the row stays small however many boxes there are.
    """
    return _scores(detections, images).select("image_id", F.inline("scores"))


def orientation_best(detections: DataFrame, images: DataFrame) -> DataFrame:
    """Best angle per image: highest score, earlier angle on ties, else 0.

    The four scores sit in one row, so choosing needs no further shuffle.
    """
    top = F.array_max(F.transform("scores", lambda s: s["score"]))
    first = F.filter("scores", lambda s: s["score"] == top)[0]
    return _scores(detections, images).select(
        "image_id", first["angle"].alias("angle"), first["score"].alias("score")
    )


def field_counts(detections: DataFrame, images: DataFrame) -> DataFrame:
    """How often each known class occurs per image, zeros included."""
    counts = detections.where(_known()).groupBy("image_id").agg(
        *[F.count_if(F.col("class_name") == name).alias(name) for name in FIELDS]
    )
    return images.select("image_id").join(counts, "image_id", "left").fillna(0, FIELDS)


def presence_columns(key: str = "class_name") -> list[Column]:
    """Aggregates telling which of the known classes occur in a group."""
    return [
        F.coalesce(F.bool_or(F.col(key) == name), F.lit(False)).alias(f"has_{name}") for name in FIELDS
    ]


def found_counts() -> dict[str, Column]:
    """Required and optional counts from the ``has_`` columns."""
    def total(names: list[str]) -> Column:
        return sum(F.coalesce(F.col(f"has_{name}"), F.lit(False)).cast("int") for name in names)

    required, optional = total(REQUIRED_FIELDS), total(OPTIONAL_FIELDS)
    return {
        "required_found": required,
        "optional_found": optional,
        "fields_found": required + optional,
        "all_required": required == len(REQUIRED_FIELDS),
    }


def field_presence(detections: DataFrame, images: DataFrame) -> DataFrame:
    """Distinct required and optional classes found per image."""
    seen = detections.groupBy("image_id").agg(*presence_columns())
    joined = images.select("image_id").join(seen, "image_id", "left")
    return joined.select("image_id", *[c.alias(n) for n, c in found_counts().items()])


def rounded_mean_columns() -> list[Column]:
    """Count, and sum in thousandths, of confidences rounded to 3 places."""
    thousandths = exact_units(F.col("confidence"), 1000)
    return [F.count("confidence").alias("n_detections"), F.sum(thousandths).alias("thousandths")]


def rounded_mean() -> Column:
    n, total = F.col("n_detections"), F.col("thousandths")
    return F.coalesce(F.when(n > 0, total / F.lit(1000.0) / n), F.lit(0.0))


def avg_confidence(detections: DataFrame, images: DataFrame) -> DataFrame:
    """Mean confidence over all boxes of an image, 0 for none, to 3 places."""
    sums = detections.groupBy("image_id").agg(*rounded_mean_columns())
    return (
        images.select("image_id")
        .join(sums, "image_id", "left")
        .select("image_id", exact_round(rounded_mean(), 3).alias("avg_confidence"))
    )


def missing_names(expected: list[str]) -> Column:
    """Expected classes without a ``has_`` flag, in fixed order."""
    absent = [F.when(~F.coalesce(F.col(f"has_{n}"), F.lit(False)), n) for n in expected]
    return F.array_compact(F.array(*absent))


def missing_labels() -> Column:
    """Friendly labels of up to three missing required classes."""
    absent = [
        F.when(~F.coalesce(F.col(f"has_{n}"), F.lit(False)), FIELD_LABELS[n]) for n in REQUIRED_FIELDS
    ]
    return F.slice(F.array_compact(F.array(*absent)), 1, 3)


def missing_fields(detections: DataFrame, images: DataFrame) -> DataFrame:
    """``missing`` of all five classes and ``missing_labels`` of the required."""
    seen = detections.groupBy("image_id").agg(*presence_columns())
    return (
        images.select("image_id")
        .join(seen, "image_id", "left")
        .select(
            "image_id",
            missing_names(FIELDS).alias("missing"),
            missing_labels().alias("missing_labels"),
        )
    )


COLUMNS = 32  # pixel columns that are put together at a time
PLACES = 18  # digits that a whole number holds


def digit_assemble(digits: DataFrame, *keys: str) -> DataFrame:
    """ID number from digit boxes, left to right; ties in arrival order.

    Boxes are put in order for each block of ``COLUMNS`` pixel columns, so the boxes of one image
    are dealt out by ``(image, block)``, and added up to numbers of ``PLACES`` places; the texts of these are
    joined per image. Boxes whose class is no digit count and are not written. ``keys`` tell
    the groups apart; an image by default.
    """
    keys = keys or ("image_id",)
    block = Window.partitionBy(*keys, "x_block")
    order = block.orderBy("x1", "det_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_digit = F.coalesce(F.col("digit").between(0, 9), F.lit(False))
    # An exchange on all of the keys: the blocks of a crowded image go to many tasks.
    placed = digits.select(*keys, "x1", "det_seq", "digit", F.floor(F.col("x1") / COLUMNS).alias("x_block"))
    placed = placed.withColumn("place", F.sum(is_digit.cast("int")).over(order) - 1)
    worth = F.col("digit") * F.pow(F.lit(10), F.lit(PLACES - 1) - F.col("place") % PLACES).cast("bigint")
    numbers = placed.groupBy(*keys, "x_block", F.expr(f"place div {PLACES}").alias("part")).agg(
        F.sum(F.when(is_digit, worth)).alias("number"), F.count(F.when(is_digit, 1)).alias("written"), F.count("*").alias("n")
    )
    text = F.lpad(F.col("number").cast("string"), PLACES, "0")
    pieces = numbers.withColumn("piece", F.when(F.col("written") > 0, F.substring(text, F.lit(1), F.col("written").cast("int"))))
    return pieces.groupBy(*keys).agg(
        F.expr("listagg(piece) WITHIN GROUP (ORDER BY x_block, part)").alias("id_number"),
        F.sum("n").alias("n_digits"),
    )


# Record column of each text class.
LAST_TEXTS = {
    "first_name": "firstName", "second_name": "lastName", "nid": "nid",
    "address": "address", "serial": "serial",
}


def last_texts(usable: Column | None = None) -> list[Column]:
    """Aggregates with the text of the last box of each class, empty if none."""
    def last(name: str) -> Column:
        here = F.col("class_name") == name
        here = here if usable is None else here & usable
        return F.coalesce(
            F.max_by(F.when(here, F.col("text")), F.when(here, F.col("det_seq"))), F.lit("")
        )

    return [last(name).alias(column) for column, name in LAST_TEXTS.items()]


def field_last_wins(detections: DataFrame, images: DataFrame) -> DataFrame:
    """Text of the last box of each class, and the two-part full name.

    An image without boxes has empty texts.
    """
    texts = detections.groupBy("image_id").agg(*last_texts())
    rows = images.select("image_id").join(texts, "image_id", "left")
    rows = rows.select("image_id", *[F.coalesce(c, F.lit("")).alias(c) for c in LAST_TEXTS])
    return rows.withColumn("full_name", F.concat("first_name", F.lit(" "), "second_name"))


def field_first_wins(detections: DataFrame, images: DataFrame) -> DataFrame:
    """First number box, first card box and last card box of each image.

    Cropping uses the last card box, so an image without one gets an error.
    """
    box = F.struct("x1", "y1", "x2", "y2")

    def pick(choose, name: str) -> Column:
        here = F.col("class_name") == name
        return choose(F.when(here, box), F.when(here, F.col("det_seq")))

    picked = detections.where(F.col("class_name").isin("nid", "card")).groupBy("image_id").agg(
        pick(F.min_by, "nid").alias("nid_box"),
        pick(F.min_by, "card").alias("card_box"),
        pick(F.max_by, "card").alias("crop_box"),
    )
    return (
        images.select("image_id")
        .join(picked, "image_id", "left")
        .withColumn("error", F.when(F.col("crop_box").isNull(), "No ID card detected"))
    )
