"""Greedy-loop operators (URL de-dup + cap, error streak) against pure-Python
restatements on random inputs, plus cache / engine / retry rules."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import cache as cache_ops
from quarry.operators import websearch as web
from quarry.operators.streak import error_streak


def py_merge(rows, max_sources, cap=2):
    """rows: (arrival, url, domain) in arrival order -> accepted arrivals, duplicates."""
    seen, dom, acc, dups = set(), {}, [], 0
    for arr, url, d in rows:
        if not url:
            continue
        if url in seen or dom.get(d, 0) >= cap:
            dups += 1
            continue
        seen.add(url)
        dom[d] = dom.get(d, 0) + 1
        acc.append(arr)
        if max_sources is not None and len(acc) >= max_sources:
            break
    return acc, dups


@pytest.mark.parametrize("seed,max_sources", [(0, 10), (1, 5), (2, None), (3, 50)])
def test_merge_results_equals_greedy_loop(spark, seed, max_sources):
    rnd = random.Random(seed)
    rows = []
    for req in range(3):
        for qp in range(3):
            for rp in range(rnd.randint(0, 15)):
                host = rnd.choice(["a.com", "b.com", "c.org", "www.a.com", "hot.net", "hot.net", "hot.net"])
                url = "" if rnd.random() < 0.05 else f"https://{host}/p{rnd.randint(0, 6)}{rnd.choice(['', '/', '?utm_source=x', '#f'])}"
                rows.append((req, qp, rp, url))
    df = spark.createDataFrame(rows, "request_id long, query_pos int, result_pos int, url string")
    acc = web.merge_results(df, max_sources=max_sources)
    stats = {r.request_id: r for r in web.dedup_stats(df, acc, max_sources=max_sources).collect()}
    got = {}
    for r in acc.collect():
        got.setdefault(r.request_id, []).append((r.query_pos, r.result_pos))
    keyed = spark.createDataFrame(rows, "request_id long, query_pos int, result_pos int, url string") \
        .withColumn("n", web.normalize_url("url")).withColumn("d", web.url_domain("n")).collect()
    norm = {(r.request_id, r.query_pos, r.result_pos): (r.n, r.d) for r in keyed}
    for req in range(3):
        mine = sorted((qp, rp) for (q, qp, rp, u) in rows if q == req)
        seq = [((qp, rp), *(norm[(req, qp, rp)] if [u for (q2, a, b, u) in rows if (q2, a, b) == (req, qp, rp)][0] else ("", "")))
               for qp, rp in mine]
        exp, dups = py_merge(seq, max_sources)
        assert sorted(got.get(req, [])) == sorted(exp)
        if req in stats:
            assert stats[req].duplicates == dups and stats[req].unique_urls == len(exp)


def py_streak(errs, cap=5):
    c, r, out = 0, 0, []
    for e in errs:
        c, r = (min(c + 1, cap), r + 1) if e else (max(c - 1, 0), 0)
        out.append((c, min(0.5 * 1.5 ** c, 2.0), r))
    return out


@pytest.mark.parametrize("segment,fan", [(32, 32), (3, 2), (5, 4)])
def test_error_streak_tree_of_segments(spark, segment, fan):
    rnd = random.Random(segment)
    base = dt.datetime(2024, 1, 1)
    rows, eid = [], 0
    for user, n in [(1, 900), (2, 40), (3, 1), (4, 60)]:     # user 1 is the hot key
        for i in range(n):
            ts = base + dt.timedelta(seconds=rnd.randint(0, 5000))
            rows.append((eid, ts, user, rnd.random() < 0.55))
            eid += 1
    rows.append((eid, rows[0][1], 1, True))                  # equal timestamps, order by event_id
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, is_error boolean")
    got = {r.event_id: (r.streak, r.delay, r.consecutive_errors)
           for r in error_streak(df, segment=segment, fan=fan).collect()}
    for user in (1, 2, 3, 4):
        ev = sorted((r for r in rows if r[2] == user), key=lambda r: (r[1], r[0]))
        for r, exp in zip(ev, py_streak([e[3] for e in ev])):
            assert got[r[0]][0] == exp[0] and got[r[0]][2] == exp[2]
            assert got[r[0]][1] == pytest.approx(exp[1])


def test_cache_lookup_rules(spark):
    now = dt.datetime(2024, 1, 1, 12, 0, 0)
    import hashlib
    k = lambda q: hashlib.md5(f"{q}:a,b".encode()).hexdigest()  # noqa: E731  engines sorted, comma-joined
    cache = spark.createDataFrame([
        (k("fresh"), '{"r": 1}', now - dt.timedelta(seconds=3600)),
        (k("stale"), '{"r": 1}', now - dt.timedelta(seconds=3601)),
        (k("broken"), '{"r": ', now), (k("empty"), "{}", now), (k("bom"), '\ufeff{"r": 2}', now),
        (k("twice"), '{"v": 1}', now - dt.timedelta(seconds=10)), (k("twice"), '{"v": 2}', now - dt.timedelta(seconds=5)),
    ], "cache_key string, payload string, written_at timestamp")
    reqs = spark.createDataFrame([(q,) for q in ["fresh", "stale", "broken", "empty", "bom", "twice", "missing"]],
                                 "query string").withColumn("cache_key", cache_ops.cache_key(
                                     F.col("query"), F.array(F.lit("b"), F.lit("a"))))
    got = {r.query: r for r in cache_ops.cache_lookup(reqs, cache, now, 3600).collect()}
    assert got["fresh"].hit and not got["stale"].hit and not got["broken"].hit and not got["empty"].hit
    assert got["bom"].hit and got["twice"].payload == '{"v": 2}' and not got["missing"].hit
    assert not any(r.hit for r in cache_ops.cache_lookup(reqs, cache, now, 0).collect())
    repaired, report = cache_ops.cache_repair(cache)
    assert report.first().repaired == 1 and repaired.count() == 6


def test_engine_lists_and_retry_plan(spark):
    df = spark.createDataFrame([(["duckduckgo", "brave"], ["qwant"]), (["duckduckgo", "brave", "qwant", "wikipedia"], []),
                                ([], ["brave"])], "used array<string>, banned array<string>")
    got = [list(r[0]) for r in df.select(web.fallback_engines(F.col("used"), F.col("banned"))).collect()]
    assert got == [["wikipedia"], ["duckduckgo"], ["duckduckgo", "qwant"]]
    allowed = df.select(web.allowed_engines(F.col("used"), F.col("banned"))).collect()
    assert list(allowed[0][0]) == ["duckduckgo", "brave"]
    log = spark.createDataFrame(
        [(1, 0, "ML news 2024", "ML news 2024", ["duckduckgo"], 0, "empty"),
         (1, 1, "ML news 2024", "ML news 2024", ["brave", "qwant"], 0, "empty"),
         (1, 2, "machine learning news", "ML news 2024", ["wikipedia"], 0, "empty"),
         (2, 0, "plain", "plain", ["duckduckgo"], 0, "error"), (3, 0, "ok", "ok", ["duckduckgo"], 5, "ok")],
        "request_id long, attempt int, query string, original_query string, engines array<string>, n_results int, status string")
    p = {(r.request_id, r.attempt): r for r in web.retry_plan(log).collect()}
    assert list(p[(1, 0)].next_engines) == ["brave", "qwant"] and p[(1, 0)].next_query == "ML news 2024"
    assert p[(1, 1)].next_query == "machine learning news"
    assert not p[(1, 2)].retry and p[(1, 2)].suggestion == "machine learning news"
    assert p[(2, 0)].retry and list(p[(2, 0)].next_engines) == ["duckduckgo"] and p[(2, 0)].suggestion is None
    assert not p[(3, 0)].retry
