"""Request-rate windows per user (batch and stream share the plan).

Limits: at most 10 searches per minute (tumbling windows) and 100 queries per
hour (sliding 1-hour windows every minute). In a stream the watermark (an
argument, 10 minutes unless given) bounds state; rows later than it are
not counted in windows; ``late_rows`` tells which. The batch form counts minutes first and makes the
windows that start in one hour from the minutes of two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PER_MINUTE = 10
PER_HOUR = 100
WATERMARK = "10 minutes"


def minute_counts(events: DataFrame, user: str = "user_id", ts: str = "ts", streaming: bool = False, watermark: str = WATERMARK) -> DataFrame:
    e = events.withWatermark(ts, watermark) if streaming else events
    return (e.groupBy(user, F.window(ts, "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("n"))
             .select(user, F.col("w.start").alias("window_start"), "n",
                     (F.col("n") > PER_MINUTE).alias("over_limit")))


def hour_counts(events: DataFrame, user: str = "user_id", ts: str = "ts", streaming: bool = False, watermark: str = WATERMARK) -> DataFrame:
    if not streaming:
        return _hours_of_minutes(minute_counts(events, user, ts), user)
    e = events.withWatermark(ts, watermark)
    return (e.groupBy(user, F.window(ts, "1 hour", "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("n"))
             .select(user, F.col("w.start").alias("window_start"), "n",
                     (F.col("n") > PER_HOUR).alias("over_limit")))


def _hours_of_minutes(minutes: DataFrame, user: str) -> DataFrame:
    """Hour windows of minute counts. The windows that start in an hour hold minutes of
    it and of the next one, so a minute is sent to two hours, not to sixty windows; the
    at most 120 minutes of a (user, hour) are an array that gives its 60 windows."""
    hours = minutes.select(user, "n", F.col("window_start").alias("_m"), F.window("window_start", "2 hours", "1 hour")["start"].alias("_h"))
    at = F.timestamp_diff("MINUTE", F.col("_h"), F.col("_m")).cast("int")
    rows = hours.groupBy(user, "_h").agg(F.collect_list(F.struct(at.alias("at"), "n")).alias("_minutes"))

    def window(start):
        inside = F.filter("_minutes", lambda x: (x["at"] >= start) & (x["at"] < start + 60))
        return F.struct(start.alias("start"), F.aggregate(inside, F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n"))

    windows = F.filter(F.transform(F.sequence(F.lit(0), F.lit(59)), window), lambda w: w["n"] > 0)
    return (rows.select(user, "_h", F.explode(windows).alias("w"))
                .select(user, (F.col("_h") + F.make_dt_interval(mins=F.col("w.start"))).alias("window_start"), F.col("w.n").alias("n"),
                        (F.col("w.n") > PER_HOUR).alias("over_limit")))


def rate_summary(minute: DataFrame, hour: DataFrame, user: str = "user_id") -> DataFrame:
    """Per user: busiest minute and hour, number of windows over each limit."""
    m = minute.groupBy(user).agg(F.max("n").alias("max_per_minute"),
                                 F.count_if("over_limit").alias("minutes_over_limit"))
    h = hour.groupBy(user).agg(F.max("n").alias("max_per_hour"),
                               F.count_if("over_limit").alias("hours_over_limit"))
    return m.join(h, user, "full")


def run_rates(events: DataFrame, name: str, user: str = "user_id", ts: str = "ts", watermark: str = WATERMARK) -> tuple[DataFrame, DataFrame]:
    """Run a stream of events to its end: (hour windows, late rows), both from
    files. Hour windows are those the watermark closed. Late rows are a side output:
    (user, ts, hours_missed) of each row that came when ``hours_missed`` of its sixty
    hour windows were closed already. What is late for a micro-batch follows from
    the newest time up to the batch before its last (the last one's moves windows out
    at its end), which each batch leaves in a file of its own, so a batch that is run
    again writes the same."""
    from .sources import checkpoint_location, run_to_files
    spark = events.sparkSession
    late_root, seen_root = (checkpoint_location(spark, f"{name}-{x}") for x in ("late", "seen"))
    seen_schema, late_schema = "newest timestamp, batch long", f"`{user}` {events.schema[user].dataType.simpleString()}, ts timestamp, hours_missed long, batch long"

    def side(batch: DataFrame, number: int) -> None:
        before = spark.read.schema(seen_schema).parquet(*[f"{seen_root}/part={i}" for i in range(number - 1)]).agg(F.max("newest")).first()[0] if number > 1 else None
        batch.agg(F.max(ts).alias("newest"), F.lit(number).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{seen_root}/part={number}")
        mark = F.lit(before).cast("timestamp") - F.expr(f"INTERVAL {watermark}")
        # a row's last hour window ends an hour after its minute begins, the first one 59 minutes earlier
        minute = F.unix_micros(F.date_trunc("minute", ts))
        closed = F.floor((F.unix_micros(mark) - minute) / F.lit(60_000_000))
        missed = F.least(F.greatest(closed, F.lit(0)), F.lit(60))
        late = batch.select(user, F.col(ts).alias("ts"), F.coalesce(missed, F.lit(0)).cast("long").alias("hours_missed"), F.lit(number).cast("long").alias("batch"))
        late.where("hours_missed > 0").write.mode("overwrite").parquet(f"{late_root}/part={number}")

    q = (events.select(user, ts).writeStream.foreachBatch(side).option("checkpointLocation", checkpoint_location(spark, f"{name}-side"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    hours = run_to_files(hour_counts(events, user, ts, streaming=True, watermark=watermark), name)
    return hours, spark.read.schema(late_schema).parquet(f"{late_root}/part=*").drop("batch")
