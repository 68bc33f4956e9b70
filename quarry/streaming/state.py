"""Stateful stream operators (transformWithStateInPandas, RocksDB store).

ErrorStreakProcessor - per key, the clamped error streak and back-off delay
  (success -> max(0, c - 1), error -> min(c + 1, 5); delay = min(0.5 * 1.5^c,
  2.0)) and a circuit breaker that opens for 60 s after 5 consecutive
  failures. Within a micro-batch, rows are applied in (ts, event_id) order;
  state carries (streak, consecutive, open_until) across batches - three
  integers per key. (A state TTL needs a processing-time query; pass
  ``ttl_ms`` and run with timeMode 'ProcessingTime' for that.)

BreakerProcessor - per key, the changes of a circuit breaker: it opens at the
  fifth consecutive failure, an event-time timer half-opens it 60 s later
  whether or not a row arrives, and the next outcome closes it or opens it
  again. Outcomes while it is open change nothing.

FirstSeenCapProcessor - per (request, domain): the first ``cap`` distinct
  URLs in arrival order; later URLs of a full domain are rejected. With
  event times a timer clears what a domain remembers once the watermark is
  ``horizon`` past its last URL.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.streak import BASE_DELAY, BREAKER_THRESHOLD, GROWTH, MAX_DELAY, MAX_STREAK

BREAKER_OPEN_US = 60 * 1_000_000

STREAK_OUT = T.StructType([
    T.StructField("user_id", T.LongType()), T.StructField("event_id", T.LongType()),
    T.StructField("streak", T.LongType()), T.StructField("delay", T.DoubleType()),
    T.StructField("consecutive_errors", T.LongType()), T.StructField("breaker_open", T.BooleanType()),
    T.StructField("open_until", T.TimestampType())])


# Rows of a frame that a processor yields.
OUT_ROWS = 10_000


def _in_order(frames):
    """(microseconds, event ids, is_error) of a key's rows of a micro-batch by (ts,
    event_id), nulls last: 17 bytes a row, whatever its frames take."""
    parts = [(f["ts"].astype("datetime64[us]").astype("int64").to_numpy(), f["event_id"].to_numpy(), f["is_error"].eq(True).to_numpy(bool))
             for f in frames]
    ts_us, ids, errors = (np.concatenate(column) for column in zip(*parts))
    del parts
    order = np.lexsort((ids, ts_us, ts_us == np.iinfo(np.int64).min))
    return ts_us[order], ids[order], errors[order]


class ErrorStreakProcessor(StatefulProcessor):
    def __init__(self, key: str = "user_id", ttl_ms: int | None = None, out_rows: int = OUT_ROWS):
        self.key, self.ttl_ms, self.out_rows = key, ttl_ms, out_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType([T.StructField("streak", T.LongType()), T.StructField("run", T.LongType()),
                               T.StructField("open_until_us", T.LongType())])
        self.state = handle.getValueState("streak", schema, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        ts_us, ids, errors = _in_order(rows)
        c, r, open_us = self.state.get() if self.state.exists() else (0, 0, -1)
        for at in range(0, len(ids), self.out_rows):
            part = slice(at, at + self.out_rows)
            c, r, open_us, made = self._fold(key, ts_us[part], ids[part], errors[part], c, r, open_us)
            yield made
        self.state.update((int(c), int(r), int(open_us)))

    def _fold(self, key, ts_us, ids, errors, c, r, open_us):
        """The state after some rows, and their frame."""
        n = len(ids)
        out_c, out_r = np.empty(n, np.int64), np.empty(n, np.int64)
        out_open, out_until = np.empty(n, bool), np.empty(n, "datetime64[us]")
        for i, (err, t) in enumerate(zip(errors, ts_us)):
            if err:
                c, r = min(c + 1, MAX_STREAK), r + 1
            else:
                c, r = max(c - 1, 0), 0
            if r >= BREAKER_THRESHOLD:           # every failure at the threshold re-opens for 60 s
                open_us = int(t) + BREAKER_OPEN_US
            out_c[i], out_r[i] = c, r
            out_open[i] = open_us >= 0 and t < open_us
            out_until[i] = np.datetime64(open_us, "us") if open_us >= 0 else np.datetime64("NaT")
        return c, r, open_us, pd.DataFrame({"user_id": [key[0]] * n, "event_id": ids,
                                            "streak": out_c, "delay": np.minimum(BASE_DELAY * GROWTH ** out_c.astype(float), MAX_DELAY),
                                            "consecutive_errors": out_r, "breaker_open": out_open,
                                            "open_until": pd.to_datetime(out_until)})

    def close(self) -> None:
        pass


def error_streak_stream(events: DataFrame, key: str = "user_id") -> DataFrame:
    """events(key, ts, event_id, is_error) stream -> per-event streak rows."""
    return (events.select(key, "ts", "event_id", "is_error")
                  .groupBy(key)
                  .transformWithStateInPandas(statefulProcessor=ErrorStreakProcessor(key),
                                              outputStructType=STREAK_OUT, outputMode="Append", timeMode="None"))


BREAKER_OUT = T.StructType([
    T.StructField("user_id", T.LongType()), T.StructField("at", T.TimestampType()), T.StructField("state", T.StringType())])


class BreakerProcessor(StatefulProcessor):
    """State per key: failures in a row, when the open breaker half-opens
    (microseconds, -1: not open), whether it is half open."""

    def __init__(self, key: str = "user_id", threshold: int = BREAKER_THRESHOLD, open_us: int = BREAKER_OPEN_US):
        self.key, self.threshold, self.open_us = key, threshold, open_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("breaker", T.StructType([
            T.StructField("run", T.LongType()), T.StructField("until_us", T.LongType()), T.StructField("half", T.BooleanType())]))

    def _rows(self, key, changes: list[tuple[int, str]]) -> pd.DataFrame:
        return pd.DataFrame({"user_id": pd.array([key[0]] * len(changes), dtype="Int64"), "at": np.array([t for t, _ in changes], dtype="datetime64[us]"),
                             "state": np.array([s for _, s in changes], dtype=object)}).astype({"state": object})

    @staticmethod
    def _timer(until_us: int) -> int:
        return -(-until_us // 1000)         # timers count milliseconds

    def handleInputRows(self, key, rows, timerValues):
        # a micro-batch's rows of a key have to be put in order
        ts_us, _, errors = _in_order(rows)
        run, until, half = self.state.get() if self.state.exists() else (0, -1, False)
        before, changes = until, []
        for err, t in zip(errors, map(int, ts_us)):
            if 0 <= until <= t:
                changes.append((until, "half_open"))
                until, half = -1, True
            if until >= 0:
                continue
            run = 0 if half or not err else run + 1
            if err and (half or run >= self.threshold):
                changes.append((t, "open"))
                run, until = 0, t + self.open_us
            elif half:
                changes.append((t, "closed"))
            half = False
        if before != until:
            if before >= 0:
                self.handle.deleteTimer(self._timer(before))
            if until >= 0:
                self.handle.registerTimer(self._timer(until))
        self.state.update((int(run), int(until), bool(half)))
        if changes:
            yield self._rows(key, changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        run, until, half = self.state.get() if self.state.exists() else (0, -1, False)
        if until >= 0 and expiredTimerInfo.getExpiryTimeInMs() == self._timer(until):
            self.state.update((int(run), -1, True))
            yield self._rows(key, [(until, "half_open")])

    def close(self) -> None:
        pass


def breaker_stream(events: DataFrame, key: str = "user_id", delay: str = "10 minutes") -> DataFrame:
    """events(key, ts, event_id, is_error) stream -> (user_id, at, state) changes."""
    return (events.select(F.col(key).cast("long").alias("user_id"), "ts", "event_id", "is_error").withWatermark("ts", delay)
                  .groupBy("user_id")
                  .transformWithStateInPandas(statefulProcessor=BreakerProcessor(), outputStructType=BREAKER_OUT,
                                              outputMode="Append", timeMode="EventTime"))


class FirstSeenCapProcessor(StatefulProcessor):
    """Keyed by (request_id, domain). A URL maps to one domain, so URL
    de-duplication inside the domain group equals global de-duplication;
    once the domain holds ``cap`` URLs every later row is rejected, so the
    state never needs more than ``cap`` URLs."""

    def __init__(self, cap: int = 2, arrival: str = "arrival", horizon_ms: int | None = None):
        self.cap, self.arrival, self.horizon_ms = cap, arrival, horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState(
            "urls", T.StructType([T.StructField("urls", T.ArrayType(T.StringType()))]))

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(self.arrival, kind="mergesort")
        urls = list(self.seen.get()[0]) if self.seen.exists() else []
        keep = []
        for i, u in enumerate(pdf["norm_url"].to_numpy()):
            if u in urls or len(urls) >= self.cap:
                continue
            urls.append(u)
            keep.append(i)
        self.seen.update((urls,))
        if self.horizon_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(int(pdf["ts"].astype("datetime64[ms]").astype("int64").max()) + self.horizon_ms)
        yield pdf.iloc[keep][["request_id", "domain", "norm_url", self.arrival]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.seen.clear()
        return iter([])

    def close(self) -> None:
        pass


def first_seen_capped_stream(results: DataFrame, cap: int = 2, arrival: str = "arrival", horizon: str | None = None) -> DataFrame:
    """results(request_id, norm_url, domain, arrival) stream -> accepted rows
    (first arrival per URL, at most ``cap`` per domain).

    With ``horizon`` (such as "10 minutes") the results have an event time ``ts``, and
    what is remembered of a domain goes once the watermark, which is as far behind
    the newest row, has passed its last URL by that much. Requests that are over
    within the horizon get the same rows as without it."""
    out = T.StructType([T.StructField("request_id", results.schema["request_id"].dataType),
                        T.StructField("domain", T.StringType()), T.StructField("norm_url", T.StringType()),
                        T.StructField(arrival, results.schema[arrival].dataType)])
    if horizon is None:
        rows, mode, ms = results.select("request_id", "domain", "norm_url", arrival), "None", None
    else:
        rows = results.select("request_id", "domain", "norm_url", arrival, "ts").withWatermark("ts", horizon)
        mode, ms = "EventTime", int(pd.Timedelta(horizon).total_seconds() * 1000)
    return (rows.groupBy("request_id", "domain")
                .transformWithStateInPandas(statefulProcessor=FirstSeenCapProcessor(cap, arrival, ms),
                                            outputStructType=out, outputMode="Append", timeMode=mode))
