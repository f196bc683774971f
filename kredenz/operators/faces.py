"""Pairing and comparing face vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kredenz.functions.faces import BROKEN, NO_FACE, NO_IMAGE, cosine, match_band


def face_pair_join(id_faces: DataFrame, live_faces: DataFrame) -> DataFrame:
    """ID and live vector per case, with an error for an incomplete pair.

    A side without a row sent no image; a row without a vector shows no face. A side may have a column
    ``load_error``, why its image could not be read; the ID image is read first.
    """
    def side(faces: DataFrame, name: str) -> DataFrame:
        broken = F.col("load_error") if "load_error" in faces.columns else F.lit(None)
        return faces.withColumns({f"_{name}": F.lit(True), f"_{name}_broken": broken.cast("string")}).drop("load_error")

    pairs = side(id_faces, "id").join(side(live_faces, "live"), "case_id", "full")
    absent = F.col("_id").isNull() | F.col("_live").isNull()
    broken = F.coalesce("_id_broken", "_live_broken")
    error = F.when(absent, NO_IMAGE).when(broken.isNotNull(), F.concat(F.lit(BROKEN), broken)).when(_incomplete(), NO_FACE)
    return pairs.withColumn("error", error).drop("_id", "_live", "_id_broken", "_live_broken")


def _incomplete() -> Column:
    return F.col("id_embedding").isNull() | F.col("live_embedding").isNull()


def face_similarity(pairs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Cosine score and match band; incomplete pairs keep their error."""
    score = F.when(F.col("error").isNull(), cosine(F.col("id_embedding"), F.col("live_embedding")))
    scored = pairs.select("case_id", score.alias("similarity_score"), "error")
    return scored.withColumns(match_band(F.col("similarity_score"), threshold))


def face_response(verified: DataFrame, requested: Column) -> DataFrame:
    """The response of a verification request: its result and time on success, else its error."""
    ok = F.col("error").isNull()
    result = F.struct("similarity_score", "is_match", "threshold", "confidence")
    return verified.select(
        "case_id",
        ok.alias("success"),
        F.when(ok, result).alias("verification_result"),
        F.when(ok, requested).alias("request_timestamp"),
        "error",
    )
