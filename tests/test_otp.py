"""One-time codes against a plain replay."""

import datetime
import random

import numpy as np
import pytest
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from kredenz.operators import otp

EVENTS = "event_id bigint, ts timestamp, phone string, action string, code string, delivery_error string"
START = datetime.datetime(2024, 1, 1)


def failure(event_id):
    return "Twilio error 400: {}" if event_id % 7 == 3 else None


def events_of(spark, rows):
    """Rows of (event_id, microseconds, phone, action, code)."""
    data = [(i, START + datetime.timedelta(microseconds=us), p, a, c, failure(i)) for i, us, p, a, c in rows]
    return spark.createDataFrame(data, EVENTS)


def plain_replay(rows, ttl):
    held, out = {}, {}
    for i, us, phone, action, code in sorted(rows, key=lambda r: (r[2], r[1], r[0])):
        current = held.get(phone)
        if action == "send":
            if current and us < current[1]:
                out[i] = (False, f"OTP already sent. Please wait {(current[1] - us) // 1_000_000} seconds.")
            else:
                held[phone] = (code, us + ttl * 1_000_000)
                out[i] = (failure(i) is None, failure(i) or "OTP sent successfully!")
        elif not current:
            out[i] = (False, "No OTP requested for this phone.")
        elif us > current[1]:
            out[i] = (False, "OTP expired.")
        elif code != current[0]:
            out[i] = (False, "Invalid OTP.")
        else:
            del held[phone]
            out[i] = (True, "OTP verified successfully!")
    return out, held


def outcomes(spark, rows, ttl=30):
    return {r.event_id: (r.success, r.message) for r in otp.otp_replay(events_of(spark, rows), ttl).collect()}


def random_rows(n, seed, busy_share, gap, codes=3):
    rng = random.Random(seed)
    rows, now = [], 0
    for i in range(n):
        now += rng.randrange(gap)
        phone = "busy" if rng.random() < busy_share else f"p{rng.randrange(30)}"
        rows.append((i, now, phone, rng.choice(["send", "send", "verify"]), str(rng.randrange(codes))))
    return rows


@pytest.fixture(params=[20, 1], ids=["few blocks", "many blocks"])
def blocks(monkeypatch, request):
    """Blocks of twenty code lifetimes, and of one."""
    monkeypatch.setattr(otp, "WINDOW", request.param)


@pytest.mark.parametrize(
    "seed, busy, gap, codes",
    [(1, 1 / 3, 2_000_000, 3), (2, 0.95, 900_000, 50), (3, 1.0, 40_000_000, 2), (4, 1.0, 300_000, 400), (5, 0.9, 2, 3)],
)
def test_replay_with_a_busy_phone(spark, blocks, seed, busy, gap, codes):
    rows = random_rows(3000, seed, busy, gap, codes)
    expected, _ = plain_replay(rows, 30)
    assert outcomes(spark, rows) == expected


def test_replay_of_regular_sends(spark, blocks):
    """A code every second and no pause: each block depends on the one before."""
    rows = [(i, i * 1_000_000, "bot", "send" if i % 17 else "verify", str(i)) for i in range(3000)]
    expected, _ = plain_replay(rows, 30)
    assert outcomes(spark, rows) == expected


def test_blocks_shorter_than_a_lifetime(spark, blocks):
    rows = random_rows(2000, 8, 1.0, 5_000, 4)
    for ttl in (1, 5, 3600):
        expected, _ = plain_replay(rows, ttl)
        assert outcomes(spark, rows, ttl) == expected


@given(
    st.lists(st.tuples(st.integers(0, 3), st.booleans(), st.sampled_from("abc")), min_size=1, max_size=40),
    st.integers(1, 4),
)
def test_left_with_agrees_with_the_fold(events, ttl):
    """Accept any send, fold on from there: the held code is the one foretold."""
    times = np.cumsum([gap for gap, _, _ in events])
    sends = np.array([send for _, send, _ in events])
    codes = [code for _, _, code in events]
    answer = otp.left_with(times, sends, codes, ttl)
    for row in np.flatnonzero(sends):
        state = (codes[row], times[row] + ttl)
        for later in range(row + 1, len(events)):
            state, *_ = otp.step(state, "send" if sends[later] else "verify", times[later], codes[later], ttl)
        told = answer[row]
        assert state == (None if told < 0 else (codes[told], times[told] + ttl))


def test_expiry_moment(spark):
    s = 1_000_000
    for offset, verify, send in [(-1, True, False), (0, True, True), (1, False, True)]:
        at = 30 * s + offset
        checked = outcomes(spark, [(1, 0, "p", "send", "c"), (2, at, "p", "verify", "c")])
        sent = outcomes(spark, [(1, 0, "p", "send", "c"), (2, at, "p", "send", "d")])
        assert (checked[2][0], sent[2][0]) == (verify, send)
    assert outcomes(spark, [(1, 0, "p", "send", "c"), (2, s + 1, "p", "send", "d")])[2][1].endswith("wait 28 seconds.")


def test_state_and_verified_phones(spark):
    rows = random_rows(800, 9, 0.2, 5_000_000)
    cut = rows[500][1]
    df = otp.otp_replay(events_of(spark, rows)).cache()
    _, held = plain_replay([r for r in rows if r[1] <= cut], 30)
    as_of = F.unix_micros(F.lit(START + datetime.timedelta(microseconds=cut)))
    got = {r.phone: (r.code, r.remaining_secs) for r in otp.otp_state(df, as_of, show_code=True).collect()}
    assert got == {p: (c, max(0, (e - cut) // 1_000_000)) for p, (c, e) in held.items()}
    hidden = {r.code for r in otp.otp_state(df, as_of).collect()}
    assert hidden == {"*"}
    passed, _ = plain_replay(rows, 30)
    phones = {r[2] for r in rows if r[3] == "verify" and passed[r[0]][0]}
    assert {r.phone for r in otp.verified_phones(df).collect()} == phones
