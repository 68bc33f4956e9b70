"""Library operators that have no source table in the driver data: landed
responses, report lines, history export/erase, recency filter, client stats,
engine breakdown, interval gate, setup comparison, tool metrics."""
import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from quarry.operators import evaluate as ev
from quarry.operators import memory as mem
from quarry.operators import websearch as web
from quarry.operators.indexing import needs_reindex


def test_read_search_responses_and_report(spark):
    body = json.dumps({"results": [{"title": "A", "url": "https://x.com/a", "content": "c" * 200, "engine": "brave"},
                                   {"title": "B", "url": "", "content": "d"},
                                   {"title": "C", "url": "https://y.com/", "content": "e", "engine": None}]})
    resp = spark.createDataFrame([(1, 0, body), (1, 1, "not json"), (2, 0, json.dumps({"error": "x"}))],
                                 "request_id long, query_pos int, body string")
    rows = web.read_search_responses(resp)
    assert rows.count() == 3
    assert rows.where("request_id = 1").select(F.max("result_pos")).first()[0] == 2
    assert web.read_search_responses(resp, max_results=1).count() == 1
    acc = web.merge_results(rows)
    rep = web.report_lines(acc).orderBy("pos").collect()
    assert [r.title for r in rep] == ["A", "C"] and len(rep[0].snippet) == 150
    eng = {r.engine: r.results for r in web.engine_breakdown(rows).collect()}
    assert eng == {"brave": 1, "unknown": 2}


def test_search_stats(spark):
    log = spark.createDataFrame([(True, 0, False), (False, 7, True), (False, 3, False)],
                                "from_cache boolean, n_results int, simplified boolean")
    s = web.search_stats(log).first()
    assert (s.total_queries, s.cache_hits, s.cache_misses, s.total_results, s.simplified_queries) == (3, 1, 2, 10, 1)
    assert s.hit_rate_pct == pytest.approx(100 / 3, abs=1e-5)
    empty = web.search_stats(log.limit(0)).first()
    assert empty.total_queries == 0 and empty.hit_rate_pct is None


def test_recency_filter(spark):
    now = dt.datetime(2024, 6, 30)
    df = spark.createDataFrame([("2024-06-29", "news"), ("2024-06-01", "it"), (None, "news")],
                               "published_date string, category string")
    assert web.recency_filter(df, "any").count() == 3
    assert web.recency_filter(df, "week", now=F.lit(now)).count() == 1
    assert web.recency_filter(df, "year", now=F.lit(now), category="news").count() == 1


def test_history_export_and_erase(spark, tmp_dir):
    msgs = spark.createDataFrame([(1, 1, "user", "a"), (1, 2, "assistant", "b"), (2, 1, "user", "c")],
                                 "conv_id long, turn long, role string, text string")
    ids = spark.createDataFrame([(1,)], "conv_id long")
    out = os.path.join(tmp_dir, "export")
    mem.export_history(msgs, ids, out)
    assert spark.read.json(out).count() == 2
    assert [r.conv_id for r in mem.erase_history(msgs, ids).collect()] == [2]


def test_interval_gate(spark):
    now = dt.datetime(2024, 1, 10)
    m = spark.createDataFrame([(dt.datetime(2024, 1, 5),)], "indexed_at timestamp")
    assert not needs_reindex(m, now=now)
    assert needs_reindex(m, now=now, force=True)
    assert needs_reindex(m, now=dt.datetime(2024, 1, 13))
    assert needs_reindex(m.limit(0), now=now)


def test_quality_by_setup_and_tool_metrics(spark):
    rows = [("bm25", 1, r, r <= 5, f"d{r % 3}") for r in range(1, 11)] + \
           [("hybrid", 1, r, True, f"d{r}") for r in range(1, 11)] + [("hybrid", 2, 1, False, "d0")]
    res = spark.createDataFrame(rows, "setup string, query_id long, rank int, relevant boolean, domain string")
    q = {r.setup: r for r in ev.quality_by_setup(res).collect()}
    assert q["bm25"].coverage_pct == 100.0 and q["bm25"].diversity == 3
    assert q["hybrid"].coverage_pct == 50.0 and q["hybrid"].diversity == pytest.approx(5.5)
    log = spark.createDataFrame([("search", True, 100.0), ("search", False, 300.0), ("code", True, 5.0)],
                                "tool string, ok boolean, latency_ms double")
    t = {r.tool: r for r in ev.tool_metrics(log).collect()}
    assert t["search"].success_rate == 0.5 and t["search"].p50_ms == 200.0 and t["code"].calls == 1
