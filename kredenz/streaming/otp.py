"""One-time codes on a stream: the state machine of ``operators.otp`` per phone."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kredenz.operators.otp import MICROS, OUTCOMES, TTL_SECONDS, code_events, held_codes, step

HELD = "held"


class OtpProcessor(StatefulProcessor):
    """Keeps code and expiry per phone.

    State has no expiry of its own: an expired code must still answer
    "expired". A micro-batch is bounded by the source, and so are the rows
    sorted here.
    """

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState(HELD, "code string, expiry bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.held.get()
        state = (before[0], int(before[1])) if before else None
        kept, outcome = state, Row(*(field.split()[0] for field in OUTCOMES.split(", ")))
        for r in sorted(rows, key=lambda r: (r.micros, r.event_id)):
            state, success, message, stored = step(state, r.action, r.micros, r.code, self.ttl, r.delivery_error)
            yield outcome(r.event_id, key[0], r.action, r.code, r.micros, success, message, stored)
        if state is None and kept is not None:
            self.held.clear()
        elif state != kept:
            self.held.update(state)

    def close(self) -> None:
        pass


def otp_stream(events: DataFrame, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Outcome of every event as it arrives; same columns as ``otp_replay``."""
    return code_events(events).groupBy("phone").transformWithState(
        OtpProcessor(ttl_seconds * MICROS), OUTCOMES, outputMode="append", timeMode="none"
    )


def otp_state_live(spark: SparkSession, checkpoint: str, as_of_micros: Column, show_code: bool = False) -> DataFrame:
    """Codes that the stream with this checkpoint holds after its last committed batch, seconds counted from ``as_of_micros``.

    Read from the stream's keyed state by Spark's own reader; nothing is replayed, and the stream may be running.
    """
    held = spark.read.format("statestore").option("stateVarName", HELD).load(checkpoint)
    rows = held.select(F.col("key.phone").alias("phone"), "value.code", "value.expiry")
    return held_codes(rows, as_of_micros, show_code)
