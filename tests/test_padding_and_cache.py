"""Zero padding against a plain restatement; clearing a cache."""
import datetime as dt

from quarry.operators.cache import cache_clear, cache_put
from quarry.operators.indexing import part_stats
from quarry.operators.tfidf import pad_zero


def test_pad_zero(spark):
    ids = [f"c{i:02d}" for i in range(12)]
    hits = {1: ["c03", "c00", "c11"], 2: [], 3: [f"c{i:02d}" for i in range(5)], 4: ["c09"]}
    rows = [(q, c, r + 1, 1.0 / (r + 1)) for q, cs in hits.items() for r, c in enumerate(cs)]
    df = spark.createDataFrame(rows, "query_id long, chunk_id string, rank int, score double")
    queries = spark.createDataFrame([(q,) for q in hits], "query_id long")
    for k in (5, 20):
        got = {}
        for r in pad_zero(df, queries, spark.createDataFrame([(c,) for c in ids], "chunk_id string"), k).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.chunk_id, r["rank"], r.score > 0))
        for q, cs in hits.items():
            full = (cs + [c for c in ids if c not in cs])[:max(k, len(cs))]
            assert got[q] == [(c, i + 1, i < len(cs)) for i, c in enumerate(full)]
    assert pad_zero(df.limit(0), queries, spark.createDataFrame([], "chunk_id string"), 5).count() == 0


def test_clear_then_write(spark):
    t = dt.datetime(2024, 1, 1)
    cache = spark.createDataFrame([("a", "1", t), ("b", "2", t)], "cache_key string, payload string, written_at timestamp")
    empty, report = cache_clear(cache)
    assert empty.schema == cache.schema and empty.count() == 0 and report.first().cleared == 2
    assert [tuple(r) for r in cache_put(empty, cache.where("cache_key = 'b'")).collect()] == [("b", "2", t)]


def test_stats_and_reindex_gate(spark):
    t = dt.datetime(2024, 1, 20)
    manifest = spark.createDataFrame([("p", t), ("p", t - dt.timedelta(days=9)), ("q", t - dt.timedelta(days=7))], "part string, indexed_at timestamp")
    rows = spark.createDataFrame([("p",), ("q",), ("r",)], "part string")
    got = {r.name: (r["count"], r.cached_files, r.bm25_docs, r.due) for r in part_stats(manifest, rows, rows.where("part = 'p'"), "part", t).collect()}
    assert got == {"p": (1, 2, 1, False), "q": (0, 1, 1, True), "r": (0, 0, 1, True)}
