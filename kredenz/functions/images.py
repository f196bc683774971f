"""Image sizing decisions and quality bands."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from kredenz.functions.numbers import exact_round

MB = 1024.0 * 1024.0

# Fixed values: (above this many MB, target KB, max side, quality, reason).
COMPRESSION_TIERS = [
    (4, 500, 1000, 0.7, "Image is very large (>4MB). Strong compression recommended."),
    (2, 800, 1200, 0.8, "Image is large (>2MB). Compression recommended."),
    (1, 1000, 1400, 0.85, "Image is moderately large (>1MB). Light compression recommended."),
]
COMPRESSION_NONE = (1000, 1600, 0.9, "Image size is acceptable. No compression needed.")

# Feedback texts per level.
FEEDBACK_GOOD = "Perfect! Hold steady."
FEEDBACK = {
    "medium": {
        "blurry": "Image is blurry. Hold steady.",
        "dark": "Too dark. Find better lighting.",
        "bright": "Too bright. Reduce glare.",
        "other": "Adjust position for better quality.",
    },
    "poor": {
        "blurry": "Too blurry. Hold camera steady.",
        "dark": "Too dark. Need more light.",
        "bright": "Too bright. Move away from light.",
        "small": "Move closer to ID card.",
        "other": "Poor quality. Adjust position.",
    },
}


def resize_plan(width: Column, height: Column) -> dict[str, Column]:
    """Target size before text recognition: shrink large, grow small, else keep."""
    side_w, side_h = F.nullif(width, F.lit(0)), F.nullif(height, F.lit(0))
    large = (width > 1500) | (height > 1500)
    small = (width < 400) | (height < 300)
    wide = width > height
    shrunk_w = F.when(wide, 1000).otherwise((width * (F.lit(1000.0) / side_h)).cast("int"))
    shrunk_h = F.when(wide, (height * (F.lit(1000.0) / side_w)).cast("int")).otherwise(1000)
    grow = F.greatest(F.lit(400.0) / side_w, F.lit(300.0) / side_h)
    return {
        "new_width": F.when(large, F.greatest(shrunk_w, F.lit(400)))
        .when(small, (width * grow).cast("int")).otherwise(width),
        "new_height": F.when(large, F.greatest(shrunk_h, F.lit(300)))
        .when(small, (height * grow).cast("int")).otherwise(height),
        "action": F.when(large, "shrink").when(small, "enlarge").otherwise("keep"),
    }


DEFAULT_MAX_KB = 1000


def compress_plan(
    size: Column, compressed: Column | None = None, **chosen: float
) -> dict[str, Column]:
    """Whether an image must be compressed, and to what, from its size in bytes.

    ``chosen`` may set ``target_kb``, ``max_w``, ``max_h`` and ``quality``; a
    chosen value goes before the recommended one, and a chosen ``target_kb`` is
    also the limit above which compression is needed.
    """
    mb = size / F.lit(MB)

    def tier(index: int) -> Column:
        first, *rest = COMPRESSION_TIERS
        chain = F.when(mb > first[0], first[index])
        for row in rest:
            chain = chain.when(mb > row[0], row[index])
        return chain.otherwise(COMPRESSION_NONE[index - 1])

    out = {
        "needs": size > chosen.get("target_kb", DEFAULT_MAX_KB) * 1024,
        "recommended": mb > 1,
        "target_kb": tier(1),
        "max_w": tier(2),
        "max_h": tier(2),
        "quality": tier(3),
        "reason": tier(4),
    }
    out.update({name: F.lit(value) for name, value in chosen.items()})
    if compressed is not None:
        kept = compressed / F.nullif(size, F.lit(0))
        out["saved_pct"] = (F.lit(1.0) - kept) * 100
        out["shrink_factor"] = size / F.nullif(compressed, F.lit(0))
        out["kept_share"] = kept
    return out


def fit_within(width: Column, height: Column, max_w: Column, max_h: Column) -> dict[str, Column]:
    """Dimensions scaled down to a box with the aspect ratio kept."""
    aspect = width / F.nullif(height, F.lit(0))
    over = (width > max_w) | (height > max_h)
    by_width = over & (width > height)
    new_w = F.least(max_w, width).cast("double")
    new_h = F.least(max_h, height).cast("double")
    return {
        "fit_w": F.when(by_width, new_w).when(over, new_h * aspect).otherwise(width.cast("double")),
        "fit_h": F.when(by_width, new_w / aspect).when(over, new_h).otherwise(height.cast("double")),
    }


def quality_band(
    laplacian_variance: Column, mean_grey: Column, width: Column, height: Column
) -> dict[str, Column]:
    """The eleven quality values from the two pixel statistics and the size."""
    # Fixed values here and below: weights and limits of the quality score.
    blur = F.least(laplacian_variance / 100, F.lit(1.0))
    blurry = laplacian_variance < 50
    dark, bright = mean_grey < 50, mean_grey > 200
    light = F.when((mean_grey > 50) & (mean_grey < 200), 1.0).otherwise(0.5)
    size_ok = (width >= 400) & (height >= 300)
    size = F.when(size_ok, 1.0).otherwise(0.5)
    # Truncation shows float error, so the order of these operations matters.
    score = ((blur * 0.5 + light * 0.3 + size * 0.2) * 100).cast("int")
    level = (
        F.when((score >= 70) & ~blurry, "good").when(score >= 50, "medium").otherwise("poor")
    )

    def text(grade: str) -> Column:
        words = FEEDBACK[grade]
        chain = (
            F.when(blurry, words["blurry"]).when(dark, words["dark"]).when(bright, words["bright"])
        )
        if "small" in words:
            chain = chain.when(~size_ok, words["small"])
        return chain.otherwise(words["other"])

    return {
        "quality_score": score,
        "quality_level": level,
        "blur_score": exact_round(blur, 2),
        "brightness": exact_round(mean_grey, 2),
        "is_blurry": blurry,
        "is_too_dark": dark,
        "is_too_bright": bright,
        "size_ok": size_ok,
        "width": width,
        "height": height,
        "feedback": F.when(level == "good", FEEDBACK_GOOD)
        .when(level == "medium", text("medium")).otherwise(text("poor")),
    }
