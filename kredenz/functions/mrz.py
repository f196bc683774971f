"""Machine-readable zone rules of passports."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LINE_LENGTH = 44


# The texts for lines that can't be parsed, from parser and reader.
NOT_TWO_LINES = "Invalid MRZ format: Expected 2 lines"
TOO_FEW_READ = "Insufficient OCR results: Expected 2 MRZ lines"
NO_ZONE = "Could not detect Machine Readable Zone (MRZ) in the image"


def mrz_clean(text: Column) -> Column:
    """Letters and digits only, upper case."""
    return F.upper(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def mrz_sex(code: Column) -> Column:
    """M, m and the misread 0 are male; every other code is female, none stays null."""
    return F.when(code.isin("M", "m", "0"), "M").when(code.isNotNull(), "F")


def mrz_date(text: Column, pivot: int | None = None) -> Column:
    """``yymmdd`` as ``dd/MM/yyyy``; text that is no date comes back unchanged.

    Years are 20xx. With ``pivot`` set, two-digit years above it are 19xx.
    """
    century = F.lit("20")
    if pivot is not None:
        above = F.substring(text, 1, 2).try_cast("int") > pivot
        century = F.when(above, "19").otherwise("20")
    full = F.when(F.length(text) == 6, F.concat(century, text)).otherwise(text)
    parsed = F.when(full.rlike("^[0-9]{8}$"), F.try_to_date(full, "yyyyMMdd"))
    return F.coalesce(F.date_format(parsed, "dd/MM/yyyy"), text)


def mrz_pad(line: Column) -> Column:
    """Fill a short line with ``<``; a long line is kept whole."""
    short = F.length(line) < LINE_LENGTH
    return F.when(short, F.rpad(line, LINE_LENGTH, "<")).otherwise(line)


def mrz_name(part: Column) -> Column:
    return F.upper(F.trim(F.translate(part, "<", " ")))


def mrz_read_error(zone_found: Column, line1: Column, line2: Column) -> Column:
    """Why a passport image gave no data: no zone in it, or fewer than two lines read."""
    both = line1.isNotNull() & line2.isNotNull()
    return F.when(~F.coalesce(zone_found, F.lit(False)), NO_ZONE).when(~both, TOO_FEW_READ)


def mrz_parse(line1: Column, line2: Column, pivot: int | None = None) -> dict[str, Column]:
    """The nine passport fields (countries still as codes) and ``parse_error``.

    The parts of a name are split at the first ``<<`` only.
    """
    both = line1.isNotNull() & line2.isNotNull()
    a, b = mrz_pad(line1), mrz_pad(line2)
    holder = F.substring(a, 6, LINE_LENGTH - 5)
    cut = F.instr(holder, "<<")
    surname = F.when(cut > 0, F.substring(holder, F.lit(1), cut - 1)).otherwise(holder)
    names = F.when(cut > 0, F.substring(holder, cut + 2, F.lit(LINE_LENGTH))).otherwise("")
    fields = {
        "surname": mrz_name(surname),
        "name": mrz_name(names),
        "sex": mrz_sex(mrz_clean(F.substring(b, 21, 1))),
        "date_of_birth": mrz_date(F.substring(b, 14, 6), pivot),
        "nationality": mrz_clean(F.substring(b, 11, 3)),
        "passport_type": mrz_clean(F.substring(a, 1, 2)),
        "passport_number": mrz_clean(F.substring(b, 1, 9)),
        "issuing_country": mrz_clean(F.substring(a, 3, 3)),
        "expiration_date": mrz_date(F.substring(b, 22, 6), pivot),
    }
    out = {name: F.when(both, c) for name, c in fields.items()}
    out["parse_error"] = F.when(~both, NOT_TWO_LINES)
    return out
