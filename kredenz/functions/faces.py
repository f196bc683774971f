"""Face vector rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Errors of a pair with an image missing, with one that can't be read, and with one that shows no face.
BROKEN = "Invalid image data: "
NO_IMAGE = "Both id_image and live_image are required"
NO_FACE = "Face not detected in one of the images"


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, with the usual floor of 1e-8 on each length."""
    def length(v: Column) -> Column:
        return F.greatest(F.sqrt(_dot(v, v)), F.lit(1e-8))

    return _dot(a, b) / (length(a) * length(b))


def match_band(score: Column, threshold: float = 0.7) -> dict[str, Column]:
    return {
        "is_match": score > threshold,
        "threshold": F.when(score.isNotNull(), threshold),
        "confidence": F.when(score > 0.8, "high").when(score > 0.6, "medium")
        .when(score.isNotNull(), "low"),
    }
