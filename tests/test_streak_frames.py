"""Streaks and breakers over a key's rows in bounded pieces."""

import numpy as np
import pandas as pd

from quarry.streaming.state import BreakerProcessor, ErrorStreakProcessor


class _State:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def _frames(n, size):
    rng = np.random.default_rng(3)
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 4000, n), unit="s")
    pdf = pd.DataFrame({"user_id": 7, "ts": ts, "event_id": rng.permutation(n), "is_error": rng.random(n) < 0.7})
    return pdf, [pdf.iloc[i:i + size] for i in range(0, n, size)]


def test_streak_frames_are_bounded():
    pdf, frames = _frames(1000, 64)
    p = ErrorStreakProcessor(out_rows=100)
    p.state = _State()
    out = list(p.handleInputRows((7,), iter(frames), None))
    assert [len(f) for f in out] == [100] * 10
    got = pd.concat(out, ignore_index=True)
    want = pdf.sort_values(["ts", "event_id"])
    assert got["event_id"].tolist() == want["event_id"].tolist()
    c = r = 0
    for err, a, b in zip(want["is_error"], got["streak"], got["consecutive_errors"]):
        c, r = (min(c + 1, 5), r + 1) if err else (max(c - 1, 0), 0)
        assert (a, b) == (c, r)
    assert p.state.value[:2] == (c, r)


def test_breaker_takes_frames_in_any_cut():
    class Timers:
        def registerTimer(self, t): pass
        def deleteTimer(self, t): pass

    outs = []
    for size in (1000, 37):
        _, frames = _frames(1000, size)
        p = BreakerProcessor()
        p.state, p.handle = _State(), Timers()
        outs.append((pd.concat(list(p.handleInputRows((7,), iter(frames), None))).values.tolist(), p.state.value))
    assert outs[0] == outs[1] and len(outs[0][0]) > 5
