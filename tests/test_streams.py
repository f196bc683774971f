"""Streams fed in several slices give what the batch form gives."""

import datetime

import pytest
from pyspark.sql import functions as F

from kredenz.operators import assets, capture, otp
from kredenz.operators.results import result_upsert
from kredenz.plans.catalog import _facts
from kredenz.sources.tables import Inputs
from kredenz.streaming.assets import asset_stream, compact_assets, pieces, read_assets, read_pending
from kredenz.streaming.capture import CaptureProcessor, capture_stream
from kredenz.streaming.log import BatchLog
from kredenz.streaming.otp import otp_state_live, otp_stream
from kredenz.streaming.results import compact_results, read_results, result_upsert_stream
from kredenz.streaming.runs import PROVIDER, drain, to_files
from workload.streams import arrive


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def streamed(spark, table, order, key, operator, slices=4):
    def consume(stream, work):
        drain(spark, to_files(operator(stream), f"{work}/out"), f"{work}/checkpoint")

    work = arrive(table, order, key, consume, slices=slices)
    assert spark.conf.get(PROVIDER, None) is None or "RocksDB" not in spark.conf.get(PROVIDER)
    return work


def test_otp_and_what_it_holds(spark, folder):
    events = Inputs(spark, folder).otp_events().withColumn("arrival", otp.micros())
    work = streamed(spark, events, "arrival", "phone", lambda s: otp_stream(s, 14_400))
    got = spark.read.parquet(f"{work}/out")
    replayed = otp.otp_replay(events, 14_400)
    assert rows(got) == rows(replayed.select(*got.columns))
    # The state after the last event, read from the stream's checkpoint, is that of a replay.
    now = F.lit(events.agg(F.max("arrival")).first()[0])
    for show in (True, False):
        live = otp_state_live(spark, f"{work}/checkpoint", now, show)
        assert rows(live) == rows(otp.otp_state(replayed, now, 14_400, show)) != []


def uploads(spark, folder):
    """The chunk log with deletes: some paths are deleted once, in the middle of what arrives."""
    chunks = Inputs(spark, folder).asset_chunks().withColumn("deleted", F.lit(False))
    middle = chunks.groupBy("path").agg(F.expr("percentile_disc(0.6) WITHIN GROUP (ORDER BY seq)").alias("seq"))
    gone = middle.where("abs(hash(path)) % 3 = 0")
    marks = gone.select("path", F.lit(None).cast("string").alias("mime_type"), (F.col("seq") * 2 + 1).alias("seq"),
                        F.lit(None).cast("string").alias("chunk"), F.lit(False).alias("complete"), F.lit(True).alias("deleted"))
    return chunks.withColumn("seq", F.col("seq") * 2).select(*marks.columns).unionByName(marks)


def plain_files(log):
    """``path -> (mime type, chunks, content)`` and ``path -> pending chunks`` by walking through the log."""
    shown, pending = {}, {}
    for r in sorted(log, key=lambda r: r.seq):
        if r.deleted:
            shown.pop(r.path, None)
            pending.pop(r.path, None)
            continue
        pending.setdefault(r.path, []).append(r.chunk)
        if r.complete:
            parts = pending.pop(r.path)
            shown[r.path] = (r.mime_type, len(parts), type(parts[0])().join(parts))
    return shown, {p: len(c) for p, c in pending.items()}


@pytest.mark.parametrize("kind, slices", [("string", 4), ("binary", 2)])
def test_assets_with_deletes(spark, folder, monkeypatch, kind, slices):
    monkeypatch.setattr(assets, "BLOCK_BITS", 4)
    log = uploads(spark, folder).withColumn("chunk", F.col("chunk").cast(kind)).cache()
    shown, pending = plain_files(log.collect())
    assert {r.path: tuple(r)[1:] for r in assets.asset_assemble(log).collect()} == shown

    def consume(stream, work):
        drain(spark, asset_stream(stream, f"{work}/out"), f"{work}/checkpoint")

    work = arrive(log, "seq", "path", consume, slices=slices)
    for _ in range(2):  # as it came, and compacted
        assert {r.path: tuple(r)[1:] for r in read_assets(spark, f"{work}/out").collect()} == shown
        assert {r.path: r.n_chunks for r in read_pending(spark, f"{work}/out").collect()} == pending
        compact_assets(spark, f"{work}/out")
    held = BatchLog(spark, f"{work}/out").read()
    assert held.agg(F.sum("n")).first()[0] == sum(n for _, n, _ in shown.values()) + sum(pending.values())


def test_carry_over_stops_at_a_delete(spark):
    log = [("p", "a", 1, "old", False, False), ("p", None, 2, None, False, True), ("p", "b", 3, "new", False, False), ("p", "b", 4, "!", True, False)]
    frame = spark.createDataFrame(log, "path string, mime_type string, seq bigint, chunk string, complete boolean, deleted boolean")
    for carry in (False, True):
        assert rows(assets.asset_assemble(frame, carry_over=carry)) == [("p", "b", 2, "new!")]


def test_pieces_hold_one_block_of_one_upload(spark, monkeypatch):
    """A single upload of many chunks: no piece has more than a block's."""
    monkeypatch.setattr(assets, "BLOCK_BITS", 5)
    log = spark.range(1_000).select(
        F.lit("hot").alias("path"), F.lit("m").alias("mime_type"), F.col("id").alias("seq"),
        F.format_string("%03d,", "id").alias("chunk"), (F.col("id") == 999).alias("complete"),
    )
    cut = pieces(log)
    assert cut.agg(F.max("n")).first()[0] == 32 and cut.count() == -(-1_000 // 32)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "MapInPandas" not in plan


def test_capture(spark, folder):
    facts = _facts(Inputs(spark, folder)).drop("missing_labels")
    arriving = facts.drop("ready_for_capture").withColumn("arrival", otp.micros())
    work = streamed(spark, arriving, "arrival", "session_id", lambda s: capture_stream(s, "400 days", "400 days"))
    got = spark.read.parquet(f"{work}/out")
    assert rows(got) == rows(capture.capture_pick(facts).select(*got.columns))


def frames(spark, folder, made):
    """Frames like a ready one, at the given sessions and minutes."""
    facts = _facts(Inputs(spark, folder)).where("ready_for_capture").drop("missing_labels", "ready_for_capture", "session_id", "frame_id", "ts").limit(1)
    start = datetime.datetime(2024, 1, 1)
    data = [(s, k, start + datetime.timedelta(minutes=m)) for k, (s, m) in enumerate(made)]
    return facts.crossJoin(spark.createDataFrame(data, "session_id bigint, frame_id bigint, ts timestamp"))


def test_capture_forgets_idle_sessions(spark, folder, tmp_path):
    """State stays bounded over many sessions; late frames are left out; a session that comes back is a new one."""
    batches = [[(100 * b + s, 60 * b + s % 5) for s in range(40)] + [(7, 60 * b + k) for k in (10, 25, 40, 55)] for b in range(6)]
    batches[4] += [(3, 241), (9_999, 5)]  # session 3 was idle for hours; 9999 is hours late
    source, work = f"{tmp_path}/in", str(tmp_path)
    sizes = []
    for made in batches:
        made = frames(spark, folder, made)
        made.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(made.schema).parquet(source)
        drain(spark, to_files(capture_stream(stream, "30 minutes", "10 minutes"), f"{work}/out"), f"{work}/checkpoint")
        held = spark.read.format("statestore").option("stateVarName", "active").load(f"{work}/checkpoint")
        sizes.append(held.count())
    assert max(sizes) <= 3 * 41 and sizes[-1] <= 2 * 42
    got = [tuple(r) for r in spark.read.parquet(f"{work}/out").select("session_id", F.date_format("ts", "HH:mm")).collect()]
    sessions = [s for s, _ in got]
    assert 9_999 not in sessions
    assert sorted(at for s, at in got if s == 3) == ["00:03", "04:01"]
    assert sorted(at for s, at in got if s == 7) == ["00:02"]  # never idle for half an hour
    assert all(sessions.count(100 * b + s) == 1 for b in range(1, 6) for s in range(40))


def test_timer_that_goes_off_early_is_set_again():
    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

        def clear(self):
            self.held = None

    class Handle:
        timers = []

        def getValueState(self, *_):
            return Value()

        def registerTimer(self, at):
            self.timers.append(at)

    class Now:
        def __init__(self, now):
            self.now = now

        def getCurrentWatermarkInMs(self):
            return self.now

    from pyspark.sql import Row

    processor, handle = CaptureProcessor(100), Handle()
    processor.init(handle)
    frame = lambda ms: Row(ts=ms, frame_id=ms, last_millis=ms)
    assert len(list(processor.handleInputRows((1,), iter([frame(60), frame(50)]), Now(0)))) == 1
    assert list(processor.handleInputRows((1,), iter([frame(120)]), Now(0))) == []
    assert list(processor.handleExpiredTimer((1,), Now(160), None)) == [] and handle.timers == [160, 220]
    assert processor.active.exists()
    list(processor.handleExpiredTimer((1,), Now(220), None))
    assert not processor.active.exists()


def test_results_commits_replays_and_compaction(spark, folder):
    log = Inputs(spark, folder).ocr_results()
    columns, expected = result_upsert(log).columns, rows(result_upsert(log))

    def consume(stream, work):
        drain(spark, result_upsert_stream(stream, f"{work}/out"), f"{work}/checkpoint")

    work = arrive(log, "seq", "path", consume, slices=4)
    target, store = f"{work}/out", BatchLog(spark, f"{work}/out")
    now = lambda: rows(read_results(spark, target).select(*columns))
    assert now() == expected and len(store.committed()) >= 2
    # A batch that was cut off half-way: its rows are there, its commit is not.
    cut_off = log.limit(3).withColumn("seq", F.col("seq") + 10**9)
    cut_off.write.parquet(f"{target}/data/main/999")
    assert now() == expected
    # It runs again and is committed; a replay of a committed batch is skipped.
    late = log.orderBy("seq").limit(5)
    assert store.write(result_upsert(late), "main", 999) and now() == expected
    assert not store.write(cut_off, "main", 999) and now() == expected
    # A reader that began before a compaction goes on during and after it.
    reader = read_results(spark, target).select(*columns)
    assert compact_results(spark, target)
    assert rows(reader) == expected == now()
    assert not compact_results(spark, target)  # nothing new
    folders, _, since = store.folders()
    assert len(folders) == 1 and since == []
    # A batch committed while rows are compacted stays beside them.
    def settle(df):
        store.write(result_upsert(late), "main", 1_001)
        return result_upsert(df)

    store.write(result_upsert(late), "main", 1_000)
    assert store.compact(settle) and store.folders()[2] == [("main", 1_001)] and now() == expected
    store.vacuum()
    assert now() == expected and not store.files.exists("data/main/0")


def test_compaction_that_comes_second_gives_way(spark, tmp_path):
    store = BatchLog(spark, f"{tmp_path}/log")
    with pytest.raises(ValueError):
        store.read()
    assert store.read("a int").count() == 0
    store.write(spark.range(3), "main", 0)

    def settle(df):
        other.compact(lambda x: x)
        return df

    other = BatchLog(spark, f"{tmp_path}/log")
    assert not store.compact(settle)
    assert store.read().count() == 3 and len(store.snapshots()) == 1
    store.write(spark.range(2), "other", 0)
    assert store.read().count() == 5 and sorted(store.committed()) == [("main", 0), ("other", 0)]
