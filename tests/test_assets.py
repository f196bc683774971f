"""Chunk logs against a plain replay, one busy path included."""

import random

from pyspark.sql import functions as F

from kredenz.operators import assets, cases

CHUNKS = "path string, mime_type string, seq bigint, chunk string, complete boolean"


def random_log(rows, seed, busy="p0"):
    """A log in which one path receives about a third of all chunks."""
    rng = random.Random(seed)
    out = []
    for seq in rng.sample(range(rows * 50), rows):
        path = busy if rng.random() < 1 / 3 else f"p{rng.randrange(1, 40)}"
        out.append((path, f"m{rng.randrange(3)}", seq, f"<{seq}>"[: rng.randrange(6)], rng.random() < 0.05))
    return out


def replay(log, carry_over=False):
    """The store as the uploads arrive one by one."""
    published, pending = {}, {}
    for path, mime, _, chunk, complete in sorted(log, key=lambda r: r[2]):
        chunks = pending.get(path, []) + [chunk]
        if complete:
            published[path] = (mime, len(chunks), "".join(chunks))
            if not carry_over:
                pending.pop(path, None)
        else:
            pending[path] = chunks
    return published, {p: len(c) for p, c in pending.items()}


def test_assemble_and_pending_match_a_replay(spark):
    log = random_log(6000, 1)
    df = spark.createDataFrame(log, CHUNKS).repartition(7)
    published, pending = replay(log)
    got = {r.path: (r.mime_type, r.n_chunks, r.content) for r in assets.asset_assemble(df).collect()}
    assert got == published
    assert {r.path: r.n_chunks for r in assets.asset_pending(df).collect()} == pending
    sizes = {r.path: r["size"] for r in assets.asset_list(assets.asset_sizes(df)).collect()}
    assert sizes == {p: len(c) for p, (_, _, c) in published.items()}


def test_carry_over_keeps_earlier_chunks(spark):
    log = random_log(2000, 2)
    df = spark.createDataFrame(log, CHUNKS)
    published, _ = replay(log, carry_over=True)
    got = {r.path: (r.mime_type, r.n_chunks, r.content) for r in assets.asset_assemble(df, carry_over=True).collect()}
    assert got == published


def test_get_and_delete(spark):
    log = random_log(1500, 3)
    df = spark.createDataFrame(log, CHUNKS)
    published, _ = replay(log)
    keys = spark.createDataFrame([("p0",), ("p3",), ("none",), ("p3",)], "path string")
    found = assets.get_by_key(assets.asset_assemble(df, only=keys), keys, "path").collect()
    assert {r.path: r.content for r in found} == {p: published.get(p, (0, 0, None))[2] for p in ("p0", "p3", "none")}
    left = assets.asset_assemble(df, without=keys).select("path").collect()
    assert {r.path for r in left} == set(published) - {"p0", "p3"}
    again = assets.delete_by_key(assets.asset_assemble(df), keys, "path")
    assert {r.path for r in again.collect()} == {r.path for r in left}


def test_split_then_assemble_gives_the_file_back(spark):
    rng = random.Random(4)
    files = [(f"f{i}", "t", "".join(rng.choice("aéz") for _ in range(n))) for i, n in enumerate([0, 1, 9, 10, 11, 20, 355])]
    df = spark.createDataFrame(files, "path string, mime_type string, content string")
    split = assets.chunk_split(df, size=10)
    rows = split.collect()
    assert {r.path for r in rows} == {p for p, _, c in files if c}
    assert {r.path for r in rows if r.complete and r.progress_pct == 100.0} == {p for p, _, c in files if c}
    log = split.withColumn("seq", F.col("chunk_index").cast("bigint"))
    back = {r.path: r.content for r in assets.asset_assemble(log).collect()}
    assert back == {p: c for p, _, c in files if c}


def test_binary_chunks(spark):
    rows = [("b", "m", i, bytes([i, 255 - i]), i == 3) for i in range(4)]
    df = spark.createDataFrame(rows, CHUNKS.replace("chunk string", "chunk binary"))
    got = assets.asset_assemble(df).first()
    assert bytes(got.content) == b"".join(r[3] for r in rows) and got.n_chunks == 4
    files = spark.createDataFrame([("b", bytes(range(25)))], "path string, content binary")
    pieces = assets.chunk_split(files, size=10).orderBy("chunk_index").collect()
    assert [bytes(p.chunk) for p in pieces] == [bytes(range(10)), bytes(range(10, 20)), bytes(range(20, 25))]


def test_doc_ids_are_dense_in_arrival_order(spark):
    rng = random.Random(6)
    seqs = rng.sample(range(10**6), 3000)
    df = spark.createDataFrame([(s,) for s in seqs], "seq bigint").repartition(9)
    got = {r.seq: r.doc_id for r in assets.doc_id_assign(df).collect()}
    assert got == {s: i for i, s in enumerate(sorted(seqs))}


def test_ratings_by_position_and_by_id(spark):
    files = spark.createDataFrame(
        [("b.png", "image/png", 10), ("a.txt", "text/plain", 11), ("a.png", "image/png", 12)],
        "path string, mime_type string, doc_id bigint",
    )
    ratings = spark.createDataFrame([(1, 0, 2), (2, 0, 5), (3, 12, 6)], "seq int, doc_id bigint, rating int")
    by_position = {r.path: (r.rating, r.rating_label) for r in cases.rating_join(files, ratings).collect()}
    assert by_position == {"a.png": (5, "Excellent - Perfect for OCR"), "b.png": (0, "No rating")}
    by_id = {r.path: (r.rating, r.rating_label) for r in cases.rating_join(files, ratings, key="doc_id").collect()}
    assert by_id == {"a.png": (6, "No rating"), "b.png": (0, "No rating")}


def test_pages_join_to_the_file(spark, monkeypatch):
    """Blocks of four: places go on from block to block, and the pages of a path in order are its content."""
    from pyspark.sql import functions as F

    from kredenz.operators import assets

    monkeypatch.setattr(assets, "BLOCK_BITS", 2)
    log = [("p", "m", 2 * k, f"<{k}>", k in (4, 17)) for k in range(20)] + [("q", "n", 2 * k + 1, f"({k})", k in (0, 9)) for k in range(10)]
    log += [("one", "o", 101, "only", True), ("open", "x", 103, "never", False)]
    chunks = spark.createDataFrame(log, "path string, mime_type string, seq long, chunk string, complete boolean").repartition(3)
    files = {r.path: r for r in assets.asset_assemble(chunks).collect()}
    pages = {}
    for r in assets.asset_pages(chunks).orderBy("path", "chunk_index").collect():
        pages.setdefault(r.path, []).append(r)
    assert set(pages) == set(files) == {"p", "q", "one"}
    for path, rows in pages.items():
        assert [r.chunk_index for r in rows] == list(range(files[path].n_chunks))
        assert [r.next_index for r in rows] == [*range(1, len(rows)), None]
        assert "".join(r.chunk for r in rows) == files[path].content
    sent = {r.path: (r.chunk, r.cut_off) for r in assets.recognition_input(chunks).collect()}
    assert sent == {"p": ("<5>", True), "q": ("(1)", True), "one": ("only", False)}
