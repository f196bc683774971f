"""National ID and passport records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kredenz.dims import governorates
from kredenz.functions.mrz import mrz_parse
from kredenz.functions.national_id import UNKNOWN, decode_national_id
from kredenz.functions.numbers import half_up
from kredenz.functions.text import or_else

# Field names of an ID record.
RECORD_FIELDS = [
    "full_name", "national_id", "birth_date", "address", "governorate",
    "gender", "serial", "first_name", "second_name",
]


def decode_ids(ids: DataFrame, column: str = "id_number") -> DataFrame:
    return ids.withColumns(decode_national_id(F.col(column)))


def governorate_lookup(ids: DataFrame) -> DataFrame:
    """Add ``governorate`` from ``governorate_code``; unknown codes say so.

    The 28 rows are an inline table, small enough for any join threshold.
    """
    dim = governorates(ids.sparkSession).select(
        F.col("code").alias("governorate_code"), F.col("name").alias("_name")
    )
    return (
        ids.join(dim, "governorate_code", "left")
        .withColumn("governorate", F.coalesce("_name", F.lit(UNKNOWN)))
        .drop("_name")
    )


def parse_passports(lines: DataFrame, pivot: int | None = None) -> DataFrame:
    return lines.withColumns(mrz_parse(F.col("line1"), F.col("line2"), pivot))


def country_names(countries: DataFrame) -> DataFrame:
    """One upper-case name per code: the first in list order."""
    return countries.groupBy("alpha3").agg(
        F.upper(F.coalesce(F.min_by("name", "list_pos"), F.first("alpha3"))).alias("country")
    )


def country_lookup(passports: DataFrame, countries: DataFrame) -> DataFrame:
    """Replace both country codes by names; a code without a name stays.

    No broadcast hint: Catalyst broadcasts the dimension when its size allows
    and shuffles otherwise.
    """
    names = country_names(countries)
    out = passports
    for column in ("nationality", "issuing_country"):
        dim = names.select(F.col("alpha3").alias(column), F.col("country").alias(f"_{column}"))
        out = (
            out.join(dim, column, "left")
            .withColumn(column, F.coalesce(f"_{column}", column))
            .drop(f"_{column}")
        )
    return out


def record_defaults(records: DataFrame) -> DataFrame:
    """Missing and empty fields become Unknown; a missing face becomes null."""
    known = {c: or_else(F.col(c), UNKNOWN) for c in RECORD_FIELDS}
    return records.withColumns({**known, "face_image": F.nullif(F.col("face_image"), F.lit(""))})


def doc_type_dispatch(payloads: DataFrame) -> DataFrame:
    """Decode each payload by its type and stack both kinds in one table.

    Type ``id`` takes the national ID rules; every other type, and none, is a passport.
    """
    ids = governorate_lookup(decode_ids(payloads.where("doc_type = 'id'"))).select(
        "payload_id", F.lit("id").alias("route"), F.col("id_number").alias("document_no"),
        "birth_date", "gender", "governorate", "decode_status",
    )
    passports = parse_passports(payloads.where("NOT (doc_type <=> 'id')")).select(
        "payload_id", F.lit("passport").alias("route"),
        F.col("passport_number").alias("document_no"),
        F.col("date_of_birth").alias("birth_date"), F.col("sex").alias("gender"),
        "surname", "nationality", "parse_error",
    )
    return ids.unionByName(passports, allowMissingColumns=True)


def detection_rate(docs: DataFrame) -> DataFrame:
    """Share of visible fields that were found, rounded to percent, and its band.

    A national ID shows name, number, birth date and nationality; a passport
    shows its own number and the expiry date as well.
    """
    def found(*columns: str) -> Column:
        return sum(
            (F.coalesce(F.col(c), F.lit("")) != "").cast("int") for c in columns
        )

    common = ["name", "date_of_birth", "nationality"]
    kind = F.col("document_type")
    n_found = found(*common) + F.when(kind == "national-id", found("id_number")).when(
        kind == "passport", found("passport_number", "expiry_date")
    ).otherwise(0)
    n_shown = F.when(kind == "national-id", 4).when(kind == "passport", 5).otherwise(3)
    out = docs.withColumn("rate", half_up(n_found / n_shown * 100))
    rate = F.col("rate")
    return out.withColumn(
        "band", F.when(rate >= 80, "high").when(rate >= 60, "medium").otherwise("low")
    )
