"""Image quality and photo contrast, measured on decoded image rows.

``images`` has ``path, height, width, nChannels, data, error`` (see ``sources.images``) and,
where a card was found, its padded box ``crop_x1, crop_y1, crop_x2, crop_y2``. An image is
measured where its row is; pixels are never shuffled. Statistics come from
whole-number sums. An unreadable image keeps its row and its error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from kredenz.functions.images import quality_band

PHOTO_SHARE = 0.30
PHOTO_SEEN, PHOTO_CLEAR = 100, 200
CROP = ["crop_x1", "crop_y1", "crop_x2", "crop_y2"]
MEASURES = (
    "path string, width int, height int, error string, card_found boolean, laplacian_variance double, "
    "mean_grey double, variance double"
)


def grey(bgr: np.ndarray) -> np.ndarray:
    """Whole grey values of BGR bytes, with the usual fixed-point weights."""
    b, g, r = (bgr[..., i].astype(np.int64) for i in range(3))
    return (r * 4899 + g * 9617 + b * 1868 + 8192) >> 14


def variance_of(values: np.ndarray) -> float | None:
    """Population variance of whole numbers; None for none."""
    n = values.size
    return (n * int((values * values).sum()) - int(values.sum()) ** 2) / (n * n) if n else None


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            if r.error is not None:
                rows.append((r.path, None, None, r.error, None, None, None, None))
                continue
            img = np.frombuffer(r.data, np.uint8).reshape(int(r.height), int(r.width), int(r.nChannels))
            g = grey(img) if r.nChannels >= 3 else img[..., 0].astype(np.int64)
            p = g  # borders mirror around the edge pixel; a one-pixel axis onto itself
            for axis, margin in enumerate((((1, 1), (0, 0)), ((0, 0), (1, 1)))):
                p = np.pad(p, margin, mode="reflect" if g.shape[axis] > 1 else "edge")
            edges = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g
            found = not pd.isna(r.crop_x1)
            photo = None
            if found:
                crop = g[int(r.crop_y1) : int(r.crop_y2), int(r.crop_x1) : int(r.crop_x2)]
                photo = variance_of(crop[:, : int(crop.shape[1] * PHOTO_SHARE)])
            rows.append((r.path, r.width, r.height, None, found, variance_of(edges), int(g.sum()) / g.size, photo))
        columns = [f.split()[0] for f in MEASURES.split(", ")]
        yield pd.DataFrame(rows, columns=columns).astype({"width": "Int32", "height": "Int32", "card_found": "boolean"})


def measured(images: DataFrame) -> DataFrame:
    """The pixel statistics of every image, with one pass over its bytes."""
    crop = [F.col(c) if c in images.columns else F.lit(None).cast("int").alias(c) for c in CROP]
    rows = images.select("path", "height", "width", "nChannels", "data", "error", *crop)
    return rows.mapInPandas(_measure, MEASURES)


def quality_columns() -> list[Column]:
    """The eleven quality values of measured rows; null for an unreadable image."""
    band = quality_band(*[F.col(c) for c in ("laplacian_variance", "mean_grey", "width", "height")])
    return [F.when(F.col("error").isNull(), c).alias(name) for name, c in band.items()]


def photo_columns() -> list[Column]:
    """Whether a photo is on the left of the card, and how clear it is."""
    seen = F.when(F.col("error").isNull(), F.col("card_found") & F.coalesce(F.col("variance") > PHOTO_SEEN, F.lit(False)))
    return [seen.alias("detected"), F.when(seen, F.col("variance") > PHOTO_CLEAR).alias("is_clear")]


def image_quality(images: DataFrame) -> DataFrame:
    return measured(images).select("path", *quality_columns(), "error")


def photo_variance(images: DataFrame) -> DataFrame:
    """Grey variance of the left 30 percent of the card, where one was found."""
    return measured(images).select("path", "variance", *photo_columns(), "error")


def image_rows_quality(images: DataFrame) -> DataFrame:
    """Quality and photo contrast of every image at once."""
    return measured(images).select("path", *quality_columns(), "card_found", "variance", *photo_columns(), "error")
