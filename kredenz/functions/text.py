"""Path, phone, size and label rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from kredenz.functions.numbers import exact_units, half_up, one_decimal

# Clean-up steps of an upload path; their order matters.
PATH_STEPS = [
    (r"(?U)^\s+|\s+$", ""),
    (r"(?U)\s+", "-"),
    (r"[^a-zA-Z0-9\-_./]", ""),
    (r"-+", "-"),
    (r"\.\.", ""),
    (r"^[-/]+", ""),
    (r"/+", "/"),
    (r"[-/]+$", ""),
]


def path_sanitize(path: Column) -> Column:
    return reduce(lambda c, step: F.regexp_replace(c, step[0], step[1]), PATH_STEPS, path)


def path_valid(path: Column) -> Column:
    """Allowed characters only, no ``..``, no slash at either end."""
    return (
        path.rlike(r"^[a-zA-Z0-9\-_./]+\z")
        & ~path.contains("..")
        & ~path.startswith("/")
        & ~path.endswith("/")
    )


def phone_mask(phone: Column) -> Column:
    """Stars for every digit before the last four characters."""
    head = F.substring(phone, F.lit(1), F.length(phone) - 4)
    masked = F.concat(F.regexp_replace(head, "[0-9]", "*"), F.right(phone, F.lit(4)))
    return F.when(F.length(phone) <= 4, phone).otherwise(masked)


def size_label(size: Column) -> Column:
    """Bytes as B, KB or MB with one decimal."""
    kb = size / F.lit(1024.0)
    mb = kb / F.lit(1024.0)
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(kb < 1024, F.concat(one_decimal(half_up(kb * 10)), F.lit(" KB")))
        .otherwise(F.concat(one_decimal(half_up(mb * 10)), F.lit(" MB")))
    )


def or_else(c: Column, default: Column | str) -> Column:
    """``default`` where the text is missing or empty."""
    default = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.nullif(c, F.lit("")), default)


def confidence_band(confidence: Column) -> dict[str, Column]:
    """Colour band and percent text of a confidence."""
    tenths = exact_units(confidence * 100, 10, ties_up=True)
    return {
        "band": F.when(confidence > 0.8, "green").when(confidence > 0.6, "yellow").otherwise("red"),
        "pct_label": F.concat(one_decimal(tenths), F.lit("%")),
    }


def field_label(key: Column) -> Column:
    """A space before each capital, then the first letter upper case."""
    spaced = F.regexp_replace(key, "([A-Z])", " $1")
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, F.lit(2), F.length(spaced)))


def field_fallback(fields: Column, key: str, fallbacks: list[str] = ()) -> Column:
    """First non-empty value of a key and its stand-ins, else empty text.

    ``full_name`` may also be put together from the first and second name.
    """
    def value(name: str) -> Column:
        return F.nullif(F.try_element_at(fields, F.lit(name)), F.lit(""))

    choices = [value(name) for name in [key, *fallbacks]]
    if key == "full_name":
        first = F.coalesce(value("first_name"), value("firstName"))
        second = F.coalesce(value("second_name"), value("secondName"))
        choices.append(F.nullif(F.concat_ws(" ", first, second), F.lit("")))
    return F.coalesce(*choices, F.lit(""))
