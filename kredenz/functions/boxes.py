"""Bounding-box geometry. Boxes are (x1, y1, x2, y2) in whole pixels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from kredenz.functions.numbers import exact_round


# Card crop margins as (least pixels, share of the box side).
MARGIN_TOP = (20, 0.1)
MARGIN_SIDE = (10, 0.05)
MARGIN_BOTTOM = (50, 0.15)


def _half(c: Column) -> Column:
    return F.floor(c / 2).cast("int")


def _scaled(c: Column, factor: float) -> Column:
    """Whole part of ``c * factor``, cut towards zero."""
    return (c * F.lit(factor)).cast("int")


def bbox_expand(y1: Column, y2: Column, img_height: Column, scale: float = 1.5) -> dict[str, Column]:
    """Grow a box's height about its centre, clipped to the image."""
    height = y2 - y1
    centre = y1 + _half(height)
    reach = _half(_scaled(height, scale))
    return {
        "y1": F.greatest(centre - reach, F.lit(0)),
        "y2": F.least(centre + reach, img_height),
    }


def bbox_pad_card(
    x1: Column, y1: Column, x2: Column, y2: Column, img_width: Column, img_height: Column,
    flat: int | None = None,
) -> dict[str, Column]:
    """Card crop: margins from the box size, or ``flat`` pixels on every side."""
    if flat is None:
        def margin(least: int, share: float, side: Column) -> Column:
            return F.greatest(F.lit(least), _scaled(side, share))

        top = margin(*MARGIN_TOP, y2 - y1)
        side = margin(*MARGIN_SIDE, x2 - x1)
        bottom = margin(*MARGIN_BOTTOM, y2 - y1)
    else:
        top = side = bottom = F.lit(flat)
    return {
        "x1": F.greatest(F.lit(0), x1 - side),
        "y1": F.greatest(F.lit(0), y1 - top),
        "x2": F.least(img_width, x2 + side),
        "y2": F.least(img_height, y2 + bottom),
    }


def bbox_globalize(
    x1: Column, y1: Column, x2: Column, y2: Column, off_x: Column, off_y: Column,
    img_width: Column, img_height: Column,
) -> dict[str, Column]:
    """Crop coordinates back to the image, plus shares of its size to 3 places."""
    gx1, gy1, gx2, gy2 = x1 + off_x, y1 + off_y, x2 + off_x, y2 + off_y
    img_width, img_height = (F.nullif(c, F.lit(0)) for c in (img_width, img_height))
    return {
        "x1": gx1, "y1": gy1, "x2": gx2, "y2": gy2,
        "x1_norm": exact_round(gx1 / img_width, 3),
        "y1_norm": exact_round(gy1 / img_height, 3),
        "x2_norm": exact_round(gx2 / img_width, 3),
        "y2_norm": exact_round(gy2 / img_height, 3),
        "width": gx2 - gx1,
        "height": gy2 - gy1,
    }


def photo_region(
    x1: Column, y1: Column, x2: Column, y2: Column, img_width: Column, img_height: Column,
    share: float = 0.30,
) -> dict[str, Column]:
    """The left part of a card crop, where the photo is, in image coordinates."""
    zero = F.lit(0)
    return bbox_globalize(
        zero, zero, _scaled(x2 - x1, share), y2 - y1, x1, y1, img_width, img_height
    )


def nid_band(y1: Column, y2: Column, img_height: Column) -> dict[str, Column]:
    """Live number region: a quarter of the height more on both sides, clipped."""
    extra = _scaled(y2 - y1, 0.25)
    return {
        "y1": F.greatest(F.lit(0), y1 - extra),
        "y2": F.least(img_height, y2 + extra),
    }
