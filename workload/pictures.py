"""Image rows as PNG files in the shared folder, for the image scan to read."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from kredenz.runtime import scratch_path


def png_bytes(bgr: np.ndarray) -> bytes:
    """An uncompressed-filter RGB PNG of a height x width x 3 array."""
    height, width = bgr.shape[:2]
    rgb = bgr[..., ::-1].reshape(height, width * 3)
    lines = np.concatenate([np.zeros((height, 1), np.uint8), rgb], axis=1).tobytes()

    def part(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return (
        b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")
    )


def picture_folder(images: DataFrame) -> str:
    """Write every image row as ``<path>.png``; returns the folder.

    Tasks write through Arrow's file systems, so the folder may be on any store
    Arrow can name. A repeated task writes the same files again.
    """
    folder = scratch_path(images.sparkSession, "pictures")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder if "://" in folder or ":/" in folder else f"file://{folder}")
        store.create_dir(root)
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                pixels = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
                with store.open_output_stream(f"{root}/{r.path}.png") as out:
                    out.write(png_bytes(pixels))
            yield pd.DataFrame({"written": [len(pdf)]})

    images.mapInPandas(write, "written bigint").groupBy().sum("written").collect()
    return folder
