"""National ID number rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
ASCII_DIGITS = "01234567890123456789"
UNKNOWN = "Unknown"


def ascii_digits(c: Column) -> Column:
    return F.translate(c, ARABIC_DIGITS, ASCII_DIGITS)


def decode_national_id(id_number: Column) -> dict[str, Column]:
    """Birth date, governorate code, gender and how the decoding went.

    ``decode_status`` is ok, short, unparsable or bad_century. A wrong century
    digit gives a row instead of a failed job. Month and day are not checked
    against the calendar; ``birth_date_valid`` holds the date where it exists.
    """
    s = ascii_digits(id_number)
    numeric = s.rlike("^[0-9]{7}") & F.substring(s, 13, 1).rlike("[0-9]")
    century = F.substring(s, 1, 1)
    status = (
        F.when(s.isNull() | (F.length(s) < 14), "short")
        .when(~numeric, "unparsable")
        .when(~century.isin("2", "3"), "bad_century")
        .otherwise("ok")
    )
    ok = status == "ok"
    birth = F.concat(
        F.when(century == "2", "19").otherwise("20"),
        F.substring(s, 2, 2), F.lit("-"), F.substring(s, 4, 2), F.lit("-"), F.substring(s, 6, 2),
    )
    male = F.substring(s, 13, 1).isin("1", "3", "5", "7", "9")
    return {
        "birth_date": F.when(ok, birth).otherwise(UNKNOWN),
        "governorate_code": F.when(ok, F.substring(s, 8, 2)),
        "gender": F.when(ok, F.when(male, "Male").otherwise("Female")).otherwise(UNKNOWN),
        "decode_status": status,
        "birth_date_valid": F.when(ok, F.try_to_date(birth, "yyyy-MM-dd")),
    }
