"""Search-result cache as a table: key, payload, written_at.

key      = md5(query + ':' + comma-joined *sorted* engines); category and
           result limit are not part of it.
cache_put  appends rows; the current entry of a key is its latest write,
           of several at one time the one with the greatest payload
           (``row_number() <= 1`` per key, a partial WindowGroupLimit, so
           a hot key is reduced inside each partition before the shuffle).
cache_repair drops entries whose payload does not parse as JSON and reports
           repaired / total.
cache_lookup  left-joins requests to the current entries: a hit needs
           age <= TTL (expired when age > TTL), TTL > 0, and a payload that
           parses to something: null, false, zero, "" and empty objects and
           lists are misses (a leading byte-order mark is ignored). Such
           payloads are sound, though: cache_repair keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cache_key(query, engines) -> Column:
    q = F.col(query) if isinstance(query, str) else query
    e = F.col(engines) if isinstance(engines, str) else engines
    return F.md5(F.concat(q, F.lit(":"), F.array_join(F.array_sort(F.coalesce(e, F.array().cast("array<string>"))), ",")))


def current_entries(cache: DataFrame) -> DataFrame:
    w = Window.partitionBy("cache_key").orderBy(F.col("written_at").desc(), F.col("payload").desc())
    return cache.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def cache_put(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """New cache state after writing ``rows`` (cache_key, payload, written_at)."""
    return current_entries(cache.unionByName(rows.select("cache_key", "payload", "written_at")))


def cache_clear(cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the empty cache, one-row report cleared): a new version with the same
    columns, so what is written next starts from nothing."""
    return cache.where(F.lit(False)), cache.agg(F.count(F.lit(1)).alias("cleared"))


def _clean_payload(p: Column) -> Column:
    return F.regexp_replace(p, "^﻿", "")


def payload_parses(p) -> Column:
    c = _clean_payload(F.col(p) if isinstance(p, str) else p)
    return (F.coalesce(F.trim(c), F.lit("")) != "") & F.try_parse_json(c).isNotNull()


# JSON values that stand for nothing
EMPTY_JSON = r'^\s*(null|false|""|\{\s*\}|\[\s*\]|-?0(\.0*)?([eE][+-]?[0-9]+)?)\s*$'


def payload_valid(p) -> Column:
    """The payload parses and holds something."""
    c = _clean_payload(F.col(p) if isinstance(p, str) else p)
    return payload_parses(p) & ~c.rlike(EMPTY_JSON)


def cache_repair(cache: DataFrame):
    """(repaired cache, one-row report repaired/total)."""
    ok = payload_parses("payload")
    report = cache.agg(F.count_if(~ok).alias("repaired"), F.count(F.lit(1)).alias("total"))
    return cache.where(ok), report


def cache_lookup(requests: DataFrame, cache: DataFrame, now, ttl_seconds: int = 3600) -> DataFrame:
    """requests(cache_key, ...) + hit flag, age_s and payload (NULL on a miss)."""
    cur = current_entries(cache).select("cache_key", "payload", "written_at")
    now_c = now if isinstance(now, Column) else F.lit(now)
    age = F.unix_micros(now_c.cast("timestamp")) - F.unix_micros(F.col("written_at").cast("timestamp"))
    j = requests.join(cur, "cache_key", "left").withColumn("age_s", age / F.lit(1e6))
    hit = (F.lit(ttl_seconds > 0) & F.col("written_at").isNotNull() & (F.col("age_s") <= ttl_seconds)
           & payload_valid("payload"))
    return (j.withColumn("hit", F.coalesce(hit, F.lit(False)))
             .withColumn("payload", F.when(F.col("hit"), F.col("payload"))))
