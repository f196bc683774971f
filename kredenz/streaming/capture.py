"""Live capture on a stream: the first ready frame ends a session."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kredenz.operators.capture import capture_ready

IDLE = "30 minutes"
LATE = "10 minutes"
CAPTURED = "session_id bigint, frame_id bigint, ts timestamp"


class CaptureProcessor(StatefulProcessor):
    """Remembers that a session has its picture, until it has been quiet for ``idle`` milliseconds.

    ``active`` holds the time of the last ready frame. One timer is set for each session; when it
    goes off early, because frames came since, it is set again.
    """

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.active = handle.getValueState("active", "millis bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first, last = None, 0
        for r in rows:
            first = min(first, (r.ts, r.frame_id)) if first else (r.ts, r.frame_id)
            last = max(last, r.last_millis)
        if not self.active.exists():
            self.active.update((last,))
            self.handle.registerTimer(last + self.idle)
            yield Row(session_id=key[0], frame_id=first[1], ts=first[0])
        elif last > self.active.get()[0]:
            self.active.update((last,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        over = self.active.get()[0] + self.idle
        if over <= timerValues.getCurrentWatermarkInMs():
            self.active.clear()
        else:
            self.handle.registerTimer(over)
        return iter(())

    def close(self) -> None:
        pass


def _earliest(batches: Iterator) -> Iterator:
    """At most one row per session and batch, before anything is shuffled: its first frame and its last time."""
    for pdf in batches:
        last = pdf.groupby("session_id")["last_millis"].max()
        first = pdf.sort_values(["ts", "frame_id"]).drop_duplicates("session_id")
        yield first.assign(last_millis=first["session_id"].map(last))


def capture_stream(facts: DataFrame, idle: str = IDLE, late: str = LATE) -> DataFrame:
    """First ready frame per session; times are the frames' own.

    Frames that are not ready never shuffle, and a busy session's ready frames
    are reduced where they are read. A frame later than ``late`` behind the newest one is left out. A session
    without a ready frame for ``idle`` is over and its state goes; ready frames after that are a session
    anew and give a picture again.
    """
    ready = capture_ready(facts).where("ready_for_capture").select("session_id", "frame_id", F.col("ts").cast("timestamp").alias("ts"))
    timed = ready.withColumn("last_millis", F.unix_millis("ts"))
    first = timed.mapInPandas(_earliest, timed.schema).withWatermark("ts", late)
    millis = int(facts.sparkSession.sql(f"SELECT unix_millis(timestamp_millis(0) + INTERVAL '{idle.split()[0]}' {idle.split()[1]})").first()[0])
    return first.groupBy("session_id").transformWithState(
        CaptureProcessor(millis), CAPTURED, outputMode="append", timeMode="eventTime"
    )
