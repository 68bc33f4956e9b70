"""Cases that once gave wrong answers: empty payloads, stray escapes, rows without vectors, ties."""
import datetime as dt
import urllib.parse

import pytest

from quarry.functions.url import normalize_url
from quarry.operators import cache as cache_ops
from quarry.operators.neardup import semantic_dedup
from quarry.operators.streak import error_streak


def test_empty_payloads_are_sound_but_no_hits(spark):
    now = dt.datetime(2024, 1, 1)
    payloads = {"null": 0, "[]": 0, "{ }": 0, "0": 0, "-0.0": 0, "false": 0, '""': 0, "[0]": 1, '{"a":null}': 1, "1": 1, '"x"': 1, "true": 1}
    rows = [(f"k{i}", p, now) for i, p in enumerate([*payloads, "{", "", " "])]
    cache = spark.createDataFrame(rows, "cache_key string, payload string, written_at timestamp")
    repaired, report = cache_ops.cache_repair(cache)
    assert tuple(report.first()) == (3, 15) and {r.payload for r in repaired.collect()} == set(payloads)
    got = {r.cache_key: r for r in cache_ops.cache_lookup(cache.select("cache_key"), cache, now).collect()}
    assert [int(got[f"k{i}"].hit) for i in range(15)] == [*payloads.values(), 0, 0, 0]


def test_equal_write_times_have_one_winner(spark):
    now = dt.datetime(2024, 1, 1)
    cache = spark.createDataFrame([("k", '{"v": %d}' % i, now) for i in range(9)], "cache_key string, payload string, written_at timestamp")
    for n in (1, 5):
        assert [r.payload for r in cache_ops.current_entries(cache.repartition(n)).collect()] == ['{"v": 8}']


@pytest.mark.parametrize("query", ["x=%zz%20b", "q=a+b%2Bc&z=%", "k%=1&b=%ff", "a=%4&a=%41%", "p=100%25%2"])
def test_stray_escapes_equal_the_standard_library(spark, query):
    got = spark.createDataFrame([(f"http://a.com/p?{query}",)], "u string").select(normalize_url("u")).first()[0]
    assert got == "http://a.com/p?" + urllib.parse.urlencode(urllib.parse.parse_qs(query), doseq=True)


def test_rows_without_vectors_are_kept(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, 0.0]), (4, None), (5, [0.99, 0.05])], "vec_id long, embedding array<double>")
    assert {r.vec_id: (r.kept, r.reason) for r in semantic_dedup(df).collect()} == {
        1: (True, "first"), 2: (True, "first"), 3: (False, "copy"), 4: (True, "first"), 5: (False, "similar")}


def test_streak_keeps_every_event_without_exchange_reuse(spark):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i * 7 % 9000) if i % 50 else None, i % 3 or None, i % 5 < 3 or None) for i in range(3000)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, is_error boolean")
    old = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = {r.event_id: r for r in error_streak(df, segment=8).collect()}
    finally:
        spark.conf.set("spark.sql.exchange.reuse", old)
    assert len(got) == len(rows)
    for user in {r[2] for r in rows}:
        c = run = 0
        for event, _, _, error in sorted((r for r in rows if r[2] == user), key=lambda r: (r[1] is not None, r[1] or dt.datetime.min, r[0])):
            c, run = (min(c + 1, 5), run + 1) if error else (max(c - 1, 0), 0)
            assert (got[event].streak, got[event].consecutive_errors) == (c, run)
