"""One-time codes: replaying each phone's sends and checks in time order.

The outcome of an event depends on the code state its phone is in, so a phone's
history is a running fold. Histories are cut into blocks of ``WINDOW`` code lifetimes,
``(phone, time div window)``, and dealt out by block, so a busy phone is folded in many
tasks:

1. each block gives its opening: the sends up to the first that is accepted whatever
   the block was handed, with the state the block is left in if that send is the first
   accepted one, and the first check of each code within one lifetime of the block's
   first event (a handed code is dead after that);
2. a walk over the openings of a phone, in order, tells what each block is handed;
3. each block is folded once from what it was handed, joined to its rows as a table.

All steps are exact for every history. The walk reads openings only: the events of one
lifetime of each block at most, and of those one check for each code.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

MICROS = 1_000_000
TTL_SECONDS = 30
WINDOW = 20  # code lifetimes in a block

# The answers to sends and checks.
SENT = "OTP sent successfully!"
OK = "OTP verified successfully!"
NONE = "No OTP requested for this phone."
EXPIRED = "OTP expired."
INVALID = "Invalid OTP."
WAIT = "OTP already sent. Please wait {} seconds."
REFUSED, FAILED = "Twilio error ", "HTTP request failed: "

OUTCOMES = (
    "event_id bigint, phone string, action string, code string, micros bigint, success boolean, "
    "message string, stored boolean"
)
OPENINGS = (
    "phone string, block bigint, place bigint, action string, micros bigint, code string, "
    "left_code string, left_expiry bigint"
)
HAND_OVERS = "phone string, block bigint, handed_code string, handed_expiry bigint"

State = tuple[str, int] | None  # code and expiry in microseconds


def step(state: State, action: str, now: int, code: str, ttl: int, error: str | None = None) -> tuple[State, bool, str, bool]:
    """Next state, success, message and whether a code was stored; times in microseconds.

    ``error`` is the provider's answer to a send that it did not deliver: the code is
    stored all the same and its waiting time runs.
    """
    if action == "send":
        if state and now < state[1]:
            return state, False, WAIT.format((state[1] - now) // MICROS), False
        return (code, now + ttl), error is None, SENT if error is None else error, True
    if state is None:
        return state, False, NONE, False
    if now > state[1]:
        return state, False, EXPIRED, False
    if code != state[0]:
        return state, False, INVALID, False
    return None, True, OK, False


def delivery_error(status: Column, body: Column, failure: Column) -> Column:
    """What a send answers if the provider refused it or was not reached; null if delivered."""
    refused = ~F.coalesce(status.isin(200, 201), F.lit(False))
    return F.when(failure.isNotNull(), F.concat(F.lit(FAILED), failure)).when(
        refused, F.concat(F.lit(REFUSED), F.coalesce(status, F.lit(0)).cast("string"), F.lit(": "), F.coalesce(body, F.lit("")))
    )


def left_with(micros: np.ndarray, sends: np.ndarray, codes: list[str], ttl: int) -> np.ndarray:
    """For each send row, if accepted: the send row whose code is held at the end.

    -1 stands for no code held. Rows are one phone's, in order; working
    backwards, each send passes on the answer of the send accepted next.
    """
    rows = np.flatnonzero(sends)
    n = len(rows)
    # Position of the next send at or after this one's expiry.
    later = np.maximum(np.searchsorted(micros[rows], micros[rows] + ttl), np.arange(n) + 1)
    checks = defaultdict(list)
    for row in np.flatnonzero(~sends):
        checks[codes[row]].append(row)
    answer = np.full(len(micros), -1)
    for k in range(n - 1, -1, -1):
        row, following = rows[k], later[k]
        same = checks.get(codes[row], [])
        at = bisect_right(same, row)
        passed = (
            at < len(same)
            and micros[same[at]] <= micros[row] + ttl
            and (following == n or same[at] < rows[following])
        )
        if passed:
            following = np.searchsorted(rows, same[at])
        if following < n:
            answer[row] = answer[rows[following]]
        elif not passed:
            answer[row] = row
    return answer


Block = tuple[str, int, list[str], list[int], list[str]]  # phone, block, then action, micros, code of its events


def opening(block: Block, ttl: int) -> Iterator[tuple]:
    """The events of a block that can decide what it makes of the state it is handed."""
    phone, number, actions, times, codes = block
    micros, sends = np.array(times, np.int64), np.array([a == "send" for a in actions])
    held = left_with(micros, sends, codes, ttl)
    seen = set()
    for k, (action, now, code) in enumerate(zip(actions, times, codes)):
        surely = now >= times[0] + ttl
        if action == "send":
            left = (codes[held[k]], times[held[k]] + ttl) if held[k] >= 0 else (None, None)
            yield phone, number, k, action, now, code, *left
            if surely:
                return
        elif code not in seen and now <= times[0] + ttl:
            seen.add(code)
            yield phone, number, k, action, now, code, None, None


def _openings(ttl: int):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: Block | None = None
        for pdf in batches:
            out = []
            for phone, number, action, micros, code in zip(pdf.phone, pdf.block, pdf.action, pdf.micros, pdf.code):
                if now is None or (phone, number) != now[:2]:
                    if now is not None:
                        out.extend(opening(now, ttl))
                    now = (phone, number, [], [], [])
                for values, value in zip(now[2:], (action, micros, code)):
                    values.append(value)
            yield _frame(out, OPENINGS)
        if now is not None:
            yield _frame(list(opening(now, ttl)), OPENINGS)

    return run


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    kinds = [f.split() for f in schema.split(", ")]
    columns = {name: [r[k] for r in rows] for k, (name, _) in enumerate(kinds)}
    return pd.DataFrame({n: pd.array(columns[n], "Int64") if kind == "bigint" else pd.Series(columns[n], dtype=object) for n, kind in kinds})


def _walk(ttl: int):
    """The state each block is handed, from the openings of a phone in order."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, state, decided = (None, None), None, False
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if (row.phone, row.block) != here:
                    state = state if row.phone == here[0] else None
                    here, decided = (row.phone, row.block), False
                    if state:
                        out.append((row.phone, row.block, *state))
                if decided:
                    continue
                state, _, _, stored = step(state, row.action, row.micros, row.code, ttl)
                if stored:
                    decided = True
                    state = None if row.left_code is None else (row.left_code, int(row.left_expiry))
            yield _frame(out, HAND_OVERS)

    return run


def _outcomes(ttl: int):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, state = (None, None), None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if (r.phone, r.block) != here:
                    here = (r.phone, r.block)
                    state = None if r.handed_code is None else (r.handed_code, int(r.handed_expiry))
                state, *result = step(state, r.action, r.micros, r.code, ttl, r.delivery_error)
                out.append(result)
            yield pdf[["event_id", "phone", "action", "code", "micros"]].assign(
                success=[o[0] for o in out], message=[o[1] for o in out], stored=[o[2] for o in out]
            )

    return run


def micros(ts: str | Column = "ts") -> Column:
    """Microseconds of a timestamp with or without a time zone."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts)


def otp_replay(events: DataFrame, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Outcome of every event: ``success``, ``message`` and whether a code was ``stored``.

    A send is refused while the phone's code is still running; otherwise it
    starts a new code, also if it was not delivered (``delivery_error`` of the
    event, if there is such a column). A check after expiry answers expired and
    keeps the code; at the very moment of expiry a check still passes and a send is
    allowed.
    """
    ttl = ttl_seconds * MICROS
    rows = code_events(events).withColumn("block", F.floor(F.col("micros") / (WINDOW * ttl)))
    order = ["phone", "block", "micros", "event_id"]
    blocks = rows.select("phone", "block", "micros", "event_id", "action", "code").repartition("phone", "block")
    openings = blocks.sortWithinPartitions(*order).mapInPandas(_openings(ttl), OPENINGS)
    walked = openings.repartition("phone").sortWithinPartitions("phone", "block", "place")
    handed = walked.mapInPandas(_walk(ttl), HAND_OVERS)
    joined = rows.join(handed, ["phone", "block"], "left")
    return joined.sortWithinPartitions(*order).mapInPandas(_outcomes(ttl), OUTCOMES)


def code_events(events: DataFrame) -> DataFrame:
    """The columns that a replay reads."""
    error = F.col("delivery_error") if "delivery_error" in events.columns else F.lit(None)
    return events.select(
        "event_id", "phone", "action", "code", micros().alias("micros"), error.cast("string").alias("delivery_error")
    )


def verified_phones(outcomes: DataFrame) -> DataFrame:
    """Phones that passed a check at least once."""
    return outcomes.where("action = 'verify' AND success").select("phone").distinct()


def otp_state(
    outcomes: DataFrame, as_of_micros: Column, ttl_seconds: int = TTL_SECONDS, show_code: bool = False
) -> DataFrame:
    """Codes held at a moment, with whole seconds left (0 when past).

    A phone's state is set by its last stored code or passed check, so this is
    one aggregate over the outcomes.
    """
    passed = F.col("success") & (F.col("action") == "verify")
    happened = outcomes.where((F.col("stored") | passed) & (F.col("micros") <= as_of_micros))
    last = happened.groupBy("phone").agg(
        F.max(F.struct("micros", "event_id", "action", "code")).alias("last")
    )
    expiry = F.col("last.micros") + ttl_seconds * MICROS
    held = last.where("last.action = 'send'").select("phone", F.col("last.code").alias("code"), expiry.alias("expiry"))
    return held_codes(held, as_of_micros, show_code)


def held_codes(held: DataFrame, as_of_micros: Column, show_code: bool = False) -> DataFrame:
    """``phone, code, remaining_secs`` of held codes (``phone, code, expiry`` in microseconds); codes are masked."""
    left = F.floor((F.col("expiry") - as_of_micros) / MICROS)
    code = F.col("code") if show_code else F.regexp_replace("code", ".", "*")
    return held.select("phone", code.alias("code"), F.greatest(left, F.lit(0)).cast("bigint").alias("remaining_secs"))
