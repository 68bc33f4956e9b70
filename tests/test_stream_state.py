"""Timers and forgetting of the stateful streams."""
import datetime as dt

from pyspark.sql import functions as F

from quarry.streaming.rate import run_rates
from quarry.streaming.sources import checkpoint_location, landed, landed_stream, run_to_files
from quarry.streaming.state import breaker_stream, first_seen_capped_stream

START = dt.datetime(2024, 1, 1)


def at(s):
    return START + dt.timedelta(seconds=s)


def test_breaker_half_opens_without_a_row(spark):
    rows = [(1, t, t < 5 or t == 70, t // 60) for t in (0, 1, 2, 3, 4, 30, 70, 140)]       # opens at 4, again at 70, closes at 140
    rows += [(2, t, True, 0) for t in range(5)]                                            # nothing after it opened
    rows += [(3, t, t != 3, 0) for t in range(7)]                                          # never five in a row
    rows += [(9, 5000, False, 3)]                                                          # moves the watermark on
    df = spark.createDataFrame([(i, u, at(t), e, a) for i, (u, t, e, a) in enumerate(rows)], "event_id long, user_id long, ts timestamp, is_error boolean, arrival int")
    want = {(1, 4, "open"), (1, 64, "half_open"), (1, 70, "open"), (1, 130, "half_open"), (1, 140, "closed"), (2, 4, "open"), (2, 64, "half_open")}
    for turns in (F.col("arrival"), F.lit(0)):
        root = landed(df.withColumn("arrival", turns), "arrival", "t")
        out = run_to_files(breaker_stream(landed_stream(spark, root), delay="1 minute"), "t").collect()
        assert len(out) == len(want) and {(r.user_id, int((r["at"] - START).total_seconds()), r.state) for r in out} == want


def test_first_seen_forgets_what_is_past_the_horizon(spark):
    rows = [(q, i, f"http://d{i % 3}.com/{i % 4}", f"d{i % 3}.com", at(q * 600 + i)) for q in range(12) for i in range(10)]
    df = spark.createDataFrame(rows, "request_id long, arrival long, norm_url string, domain string, ts timestamp")
    root = landed(df.withColumn("file", F.floor(F.col("request_id") / 3)), "file", "t")
    place, out = checkpoint_location(spark, "t"), checkpoint_location(spark, "out")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stream = first_seen_capped_stream(landed_stream(spark, root), horizon="10 minutes")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 12 * 6          # two of each of three domains
    left = spark.read.format("statestore").option("stateVarName", "urls").load(place).where("value is not null").count()
    assert 0 < left <= 9 and old == spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_late_rows_are_told(spark):
    rows = [(1, at(60 * m), m // 60) for m in range(0, 240, 5)] + [(1, at(0), 3), (1, at(3600 * 3), 3)]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp, arrival int")
    hours, late = run_rates(landed_stream(spark, landed(df, "arrival", "t")), "t")
    # the watermark for batch 3 is 10 minutes before minute 115: windows that end by 105 are closed
    assert [(r.ts, r.hours_missed) for r in late.collect()] == [(at(0), 60)]
    first = {r.window_start: r.n for r in hours.collect()}
    assert first[at(0)] == 12 and first[at(3600 * 2)] == 12
