"""Images as rows: scanning folders, running detectors, adjusting pixels."""

from __future__ import annotations

import hashlib
import struct
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, SparkSession, functions as F

LOAD_ERROR = "Could not load image"


def image_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every file of a folder as ``path, height, width, nChannels, data, error``.

    Pixels come as BGR bytes from the image source. A file that is no image
    keeps its row and gets an error.
    """
    image = spark.read.format("image").option("dropInvalid", False).load(folder).select("image.*")
    readable = (F.col("width") > 0) & (F.col("height") > 0)
    return image.select(
        F.col("origin").alias("path"),
        *[F.when(readable, F.col(c)).alias(c) for c in ("height", "width", "nChannels", "data")],
        F.when(~F.coalesce(readable, F.lit(False)), LOAD_ERROR).alias("error"),
    )


def header_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from the head of a PNG, JPEG, GIF or BMP file; no pixel is decoded."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR":
            return struct.unpack_from(">II", data, 16)
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return struct.unpack_from("<HH", data, 6)
        if data[:2] == b"BM":
            width, height = struct.unpack_from("<ii", data, 18)
            return width, abs(height)
        at = 2 if data[:2] == b"\xff\xd8" else len(data)
        while at < len(data) and data[at] == 0xFF:  # from marker to marker, to the one that begins a frame
            while data[at + 1] == 0xFF:
                at += 1
            if 0xC0 <= data[at + 1] <= 0xCF and data[at + 1] not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack_from(">HH", data, at + 5)
                return width, height
            at += 2 + struct.unpack_from(">H", data, at + 2)[0]
    except (struct.error, IndexError):  # cut off inside its head
        pass
    return None


def image_sizes(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """``path, bytes, width, height, error`` of the files whose names match ``glob``, in any depth of the folder.

    Sizes come from the files' heads, and only if a query asks for them: one that needs paths or
    bytes alone lists files without opening any. Unlike ``image_scan``, a file is in order if its head is.
    Spark's file readers leave out empty files.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)

    @F.pandas_udf("width int, height int")
    def sizes(content: pd.Series) -> pd.DataFrame:
        found = [header_size(data) or (None, None) for data in content]
        return pd.DataFrame({k: pd.array([f[n] for f in found], "Int32") for n, k in enumerate(("width", "height"))})

    read = files.select("path", F.col("length").alias("bytes"), sizes("content").alias("size"))
    readable = (F.col("width") > 0) & (F.col("height") > 0)
    return read.select("path", "bytes", "size.width", "size.height").withColumn(
        "error", F.when(~F.coalesce(readable, F.lit(False)), LOAD_ERROR)
    )


DETECTORS = "_kredenz_detectors"  # where a worker process keeps what it has loaded
KEPT = 2


def loaded(key: str, load: Callable[[], Callable]) -> Callable:
    """The detector of this worker process; it outlives tasks, up to ``KEPT`` of them."""
    held = sys.__dict__.setdefault(DETECTORS, {})
    if key in held:
        held[key] = held.pop(key)  # the last used stands last
    else:
        while len(held) >= KEPT:
            del held[next(iter(held))]
        held[key] = load()
    return held[key]


def apply_detector(
    images: DataFrame,
    load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
    schema: str,
    profile: ResourceProfile | None = None,
    version: str = "",
) -> DataFrame:
    """Run a detector over image rows.

    ``load`` builds the detector once per worker process, which runs many tasks; the detector turns
    a batch of image rows into detection rows of ``schema``. The same ``load`` (by its code and what it
    captures) and ``version`` are one detector; another ``version`` makes workers load anew, as when
    a model file changes. ``profile`` asks for executors with, say, a GPU or more memory.
    """
    key = hashlib.sha256(cloudpickle.dumps(load)).hexdigest() + version

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detect = loaded(key, load)
        for batch in batches:
            yield detect(batch)

    return images.where("error IS NULL").mapInPandas(run, schema, profile=profile)


def _store(values: np.ndarray) -> np.ndarray:
    """Clamped to a byte; halves go to the even neighbour."""
    return np.rint(np.clip(values, 0, 255))


def adjust_pixels(
    bgr: np.ndarray, grey: bool, brightness: float, contrast: float, sharpness: float
) -> np.ndarray:
    """Grey, then brightness and contrast about 128, then a 3x3 sharpen."""
    img = bgr.astype(np.float64)
    if grey:
        level = img[..., 2] * 0.299 + img[..., 1] * 0.587 + img[..., 0] * 0.114
        img = np.repeat(_store(level)[..., None], 3, axis=2)
    if brightness or contrast:
        img = _store((img + brightness - 128) * ((100 + contrast) / 100) + 128)
    if sharpness > 0 and min(img.shape[:2]) > 2:
        s = sharpness / 100
        around = img[:-2, 1:-1] + img[2:, 1:-1] + img[1:-1, :-2] + img[1:-1, 2:]
        sharp = img.copy()
        sharp[1:-1, 1:-1] = _store((1 + 4 * s) * img[1:-1, 1:-1] - s * around)
        img = sharp
    return img.astype(np.uint8)


def image_adjust(
    images: DataFrame, grey: bool = False, brightness: float = 0,
    contrast: float = 0, sharpness: float = 0,
) -> DataFrame:
    """Adjusted three-channel image rows; error rows pass through unchanged."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            data = [
                adjust_pixels(
                    np.frombuffer(d, np.uint8).reshape(h, w, c), grey, brightness, contrast, sharpness
                ).tobytes()
                if e is None and c == 3 else d
                for d, h, w, c, e in zip(pdf.data, pdf.height, pdf.width, pdf.nChannels, pdf.error)
            ]
            yield pdf.assign(data=data)

    columns = images.select("path", "height", "width", "nChannels", "data", "error")
    return columns.mapInPandas(run, columns.schema)
