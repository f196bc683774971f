"""Image rows: scanning PNG files, quality, adjusting, detectors."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kredenz.operators import quality
from kredenz.sources.images import LOAD_ERROR, adjust_pixels, apply_detector, image_adjust, image_scan, image_sizes
from workload.pictures import png_bytes


@pytest.fixture(scope="module")
def pictures(tmp_path_factory):
    """Six random PNG files of different sizes and one that is cut off."""
    folder = tmp_path_factory.mktemp("pictures")
    rng = np.random.default_rng(3)
    made = {}
    for i, (h, w) in enumerate([(8, 8), (5, 9), (1, 7), (7, 1), (16, 3), (2, 2)]):
        made[f"{i}.png"] = rng.integers(0, 256, (h, w, 3), dtype=np.uint8)
        (folder / f"{i}.png").write_bytes(png_bytes(made[f"{i}.png"]))
    (folder / "cut.png").write_bytes(png_bytes(made["0.png"])[:40])
    return str(folder), made


def scanned(spark, folder):
    return image_scan(spark, folder).withColumn("path", F.regexp_extract("path", r"([^/]+)$", 1))


def test_scan_keeps_unreadable_files(spark, pictures):
    folder, made = pictures
    rows = {r.path: r for r in scanned(spark, folder).collect()}
    assert set(rows) == {*made, "cut.png"}
    assert rows["cut.png"].error == LOAD_ERROR and rows["cut.png"].data is None
    for name, pixels in made.items():
        r = rows[name]
        assert (r.error, r.height, r.width, r.nChannels) == (None, *pixels.shape)
        assert bytes(r.data) == pixels.tobytes()


def naive_laplacian(g):
    h, w = g.shape

    def mirror(i, n):
        if n == 1:
            return 0
        return -i if i < 0 else 2 * n - 2 - i if i >= n else i

    return [
        sum(int(g[mirror(y + dy, h), mirror(x + dx, w)]) for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0)))
        - 4 * int(g[y, x])
        for y in range(h) for x in range(w)
    ]


def test_quality_of_rows_against_pixel_by_pixel(spark, pictures):
    folder, made = pictures
    images = scanned(spark, folder)
    rows = {r.path: r for r in quality.measured(images).collect()}
    graded = {r.path: r for r in quality.image_quality(images).collect()}
    assert set(rows) == set(graded) == {*made, "cut.png"}
    assert rows["cut.png"].error == graded["cut.png"].error == LOAD_ERROR and graded["cut.png"].quality_level is None
    for name, pixels in made.items():
        g = quality.grey(pixels)
        assert rows[name].laplacian_variance == pytest.approx(np.array(naive_laplacian(g), dtype=float).var())
        assert rows[name].mean_grey == pytest.approx(g.mean())
        assert rows[name].variance is None and rows[name].card_found is False


def test_photo_is_measured_on_the_card(spark, pictures):
    """The left part of the card's box, not of the frame."""
    folder, made = pictures
    box = F.when(F.col("path") == "0.png", 2), F.when(F.col("path") == "0.png", 1), F.when(F.col("path") == "0.png", 8), F.when(F.col("path") == "0.png", 7)
    images = scanned(spark, folder).withColumns(dict(zip(quality.CROP, box)))
    rows = {r.path: r for r in quality.photo_variance(images).collect()}
    part = quality.grey(made["0.png"])[1:7, 2:8][:, : int(6 * 0.3)]
    assert rows["0.png"].variance == pytest.approx(part.var())
    assert rows["0.png"].detected == (part.var() > 100)
    assert rows["1.png"].variance is None and rows["1.png"].detected is False
    assert rows["cut.png"].detected is None


def naive_adjust(bgr, grey, brightness, contrast, sharpness):
    """Pixel by pixel, storing bytes after every step."""
    def store(v):
        return round(max(0.0, min(255.0, v)))

    h, w, _ = bgr.shape
    img = [[[int(c) for c in bgr[y, x]] for x in range(w)] for y in range(h)]
    for y in range(h):
        for x in range(w):
            if grey:
                b, g, r = img[y][x]
                img[y][x] = [store(r * 0.299 + g * 0.587 + b * 0.114)] * 3
            if brightness or contrast:
                img[y][x] = [store(((c + brightness) - 128) * ((100 + contrast) / 100) + 128) for c in img[y][x]]
    out = [[list(p) for p in line] for line in img]
    if sharpness > 0:
        s = sharpness / 100
        for y in range(1, h - 1):
            for x in range(1, w - 1):
                for c in range(3):
                    around = img[y - 1][x][c] + img[y + 1][x][c] + img[y][x - 1][c] + img[y][x + 1][c]
                    out[y][x][c] = store((1 + 4 * s) * img[y][x][c] - s * around)
    return np.array(out, dtype=np.uint8)


@pytest.mark.parametrize("settings", [(False, 0, 0, 0), (True, 0, 0, 0), (False, 40, -30, 0), (True, -20, 50, 60), (False, 0, 0, 100)])
def test_adjust_matches_pixel_by_pixel(settings):
    rng = np.random.default_rng(11)
    for shape in [(8, 8, 3), (1, 5, 3), (2, 2, 3), (3, 4, 3)]:
        bgr = rng.integers(0, 256, shape, dtype=np.uint8)
        assert (adjust_pixels(bgr, *settings) == naive_adjust(bgr, *settings)).all()


def test_adjust_on_rows_keeps_errors(spark, pictures):
    folder, made = pictures
    rows = {r.path: r for r in image_adjust(scanned(spark, folder), grey=True, sharpness=20).collect()}
    assert rows["cut.png"].error == LOAD_ERROR and rows["cut.png"].data is None
    for name, pixels in made.items():
        assert bytes(rows[name].data) == naive_adjust(pixels, True, 0, 0, 20).tobytes()


def test_sizes_come_from_heads(spark, pictures, tmp_path):
    import struct

    folder, made = pictures
    got = {r.path.rsplit("/", 1)[1]: (r.width, r.height, r.error) for r in image_sizes(spark, folder).collect()}
    assert {n: got[n] for n in made} == {n: (p.shape[1], p.shape[0], None) for n, p in made.items()}
    assert got["cut.png"] == (8, 8, None)  # its head is whole
    heads = {
        "a.gif": b"GIF89a" + struct.pack("<HH", 300, 20) + b"rest",
        "b.bmp": b"BM" + bytes(16) + struct.pack("<ii", 64, -48),
        "c.jpg": b"\xff\xd8\xff\xe0\x00\x04ab\xff\xff\xc4\x00\x03c\xff\xc2\x00\x0b\x08" + struct.pack(">HH", 480, 640) + b"\x01",
        "d.jpg": b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\xff",
        "e.txt": b"no image", "f.png": b"\x89PNG\r\n\x1a\n\x00\x00", "g.png": b"", "deep/h.gif": b"GIF87a" + struct.pack("<HH", 0, 7),
    }
    for name, data in heads.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.width, r.height, r.error) for r in image_sizes(spark, str(tmp_path)).collect()}
    assert got["a.gif"] == (300, 20, None) and got["b.bmp"] == (64, 48, None) and got["c.jpg"] == (640, 480, None)
    assert got["h.gif"] == (0, 7, LOAD_ERROR)
    assert {n for n, (w, _, e) in got.items() if w is None and e == LOAD_ERROR} == {"d.jpg", "e.txt", "f.png"}
    assert "g.png" not in got  # Spark lists no empty files
    assert {r.path[-5:] for r in image_sizes(spark, str(tmp_path), "*.gif").collect()} == {"a.gif", "h.gif"}


def test_listing_opens_no_file(spark, pictures):
    """Columns that need no head: files are listed, neither read nor handed to Python."""
    plan = image_sizes(spark, pictures[0]).select("path", "bytes")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "Python" not in plan
    full = image_sizes(spark, pictures[0])._jdf.queryExecution().executedPlan().toString()
    assert "content" in full and full.count("ArrowEvalPython") == 1


def token_of(name):
    """A detector that tells which process loaded it, and when."""
    def load():
        import os

        token = f"{name} {random.random()}"

        def detect(batch: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"path": batch.path, "token": token, "worker": os.getpid()})

        return detect

    return load


def test_detector_is_loaded_once_per_worker(spark, pictures):
    """Several tasks and several jobs of one worker process share what it loaded."""
    folder, made = pictures
    images = scanned(spark, folder).repartition(12)
    schema, load = "path string, token string, worker long", token_of("a")
    tokens = {}
    for _ in range(3):
        found = apply_detector(images, load, schema).collect()
        assert {r.path for r in found} == set(made)
        for r in found:
            tokens.setdefault(r.worker, set()).add(r.token)
    assert all(len(t) == 1 for t in tokens.values())
    for other in (apply_detector(images, token_of("b"), schema), apply_detector(images, load, schema, version="2")):
        assert not {r.token for r in other.collect()} & set.union(*tokens.values())


def test_worker_keeps_few_detectors():
    import sys

    from kredenz.sources.images import DETECTORS, KEPT, loaded

    made = []
    try:
        for key in ("a", "b", "a", "c", "a", "b"):
            loaded(key, lambda: made.append(key) or len(made))
        assert made == ["a", "b", "c", "b"] and len(getattr(sys, DETECTORS)) == KEPT
    finally:
        delattr(sys, DETECTORS)
