"""Retrieval, fusion, rerank and metrics against hand-worked answers and
brute-force restatements."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.config import SearchConfig
from quarry.operators import evaluate as ev
from quarry.operators.dense import dense_topk
from quarry.operators.fusion import rrf_fuse
from quarry.operators.rerank import exact_flag, rerank
from quarry.operators.tfidf import fit_tfidf, lexical_topk


def test_rrf_shared_doc_first(spark):
    hits = spark.createDataFrame(
        [(1, "doc1", "bm25", 1, 10.0), (1, "doc2", "bm25", 2, 8.0),
         (1, "doc2", "semantic", 1, 0.9), (1, "doc3", "semantic", 2, 0.8)],
        "query_id long, chunk_id string, retriever string, rank int, score double")
    f = rrf_fuse(hits).orderBy("fused_rank").collect()
    assert [r.chunk_id for r in f] == ["doc2", "doc1", "doc3"]
    assert f[0].search_type == "hybrid" and list(f[0].sources) == ["bm25", "semantic"]
    assert math.isclose(f[0].rrf_score, 1 / 62 + 1 / 61)
    # equal rrf: lexical-list entry (doc1, rank 1) before dense-only doc3 (rank 2)? doc1 = 1/61 > doc3 = 1/62
    assert f[1].search_type == "bm25" and f[2].search_type == "semantic"


def test_rrf_ties_keep_insertion_order(spark):
    hits = spark.createDataFrame(
        [(1, "a", "bm25", 1, 1.0), (1, "b", "semantic", 1, 1.0), (1, "c", "bm25", 2, 1.0), (1, "d", "semantic", 2, 1.0)],
        "query_id long, chunk_id string, retriever string, rank int, score double")
    assert [r.chunk_id for r in rrf_fuse(hits).orderBy("fused_rank").collect()] == ["a", "b", "c", "d"]


def test_exact_match_flag(spark):
    df = spark.createDataFrame([("Это тестовый документ с точной фразой.", "точной фразой"), ("abc", ""),
                                ("abc", "x")], "t string, q string")
    assert [r[0] for r in df.select(exact_flag(F.col("q"), F.col("t"))).collect()] == [True, True, False]


def py_rerank(query, cands, k=5):
    """cands: list of (id, text, base) in prior order."""
    ql = query.lower()
    res = []
    for cid, text, base in cands:
        ex = ql in text.lower()
        bonus = (2.0 if len(ql) < 10 else 5.0 if len(ql) < 30 else 8.0) if ex else 0.0
        res.append({"id": cid, "ex": ex, "score": base + bonus})
    s = sorted(res, key=lambda r: r["score"], reverse=True)
    if any(r["ex"] for r in s):
        i = next(i for i, r in enumerate(s) if r["ex"])
        if i >= k:
            s[i]["score"] = s[k - 1]["score"] + 0.05
    return [(r["id"], r["score"]) for r in sorted(s, key=lambda r: r["score"], reverse=True)[:k]]


@pytest.mark.parametrize("seed", range(6))
def test_rerank_guard_matches_restatement(spark, seed):
    rnd = random.Random(seed)
    rows, expected = [], {}
    for q in range(8):
        query = rnd.choice(["phrase", "a longer exact phrase", "x" * 9, "y" * 10, "z" * 29, "w" * 30, ""])
        cands = []
        for pos in range(rnd.randint(1, 12)):
            text = ("filler " * rnd.randint(0, 100)) + (query if rnd.random() < 0.2 else "nomatch")
            base = rnd.choice([0.0, 0.25, 0.5, 1.0, rnd.random()])
            cands.append((f"c{q}_{pos}", text, base))
            rows.append((q, query, f"c{q}_{pos}", text, base, pos + 1))
        expected[q] = py_rerank(query, cands)
    df = spark.createDataFrame(rows, "query_id long, query string, chunk_id string, text string, base double, fused_rank int")
    out = rerank(df, scorer=lambda q, t: F.col("base"), cfg=SearchConfig())
    got = {}
    for r in out.orderBy("query_id", "final_rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.rerank_score))
    for q, exp in expected.items():
        assert [c for c, _ in got[q]] == [c for c, _ in exp]
        assert all(math.isclose(a, b) for (_, a), (_, b) in zip(got[q], exp))


def test_rerank_fallback_orders_by_lexical_score(spark):
    df = spark.createDataFrame([(1, "q", "a", "t", None, 1), (1, "q", "b", "t", 2.0, 2), (1, "q", "c", "t", 1.0, 3)],
                               "query_id long, query string, chunk_id string, text string, bm25_score double, fused_rank int")
    assert [r.chunk_id for r in rerank(df, scorer=None).orderBy("final_rank").collect()] == ["b", "c", "a"]


@pytest.mark.parametrize("method", ["one block", "blocks", "cells"])
def test_dense_topk_exact(spark, method):
    from quarry.operators.dense import dense_topk_ivf
    rnd = np.random.default_rng(3)
    vecs = rnd.normal(size=(300, 16)).astype(np.float32)
    vecs[5] = vecs[4]                                   # an exact tie
    qs = rnd.normal(size=(25, 16))
    v = spark.createDataFrame([(i, [float(x) for x in vecs[i]]) for i in range(300)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(i, [float(x) for x in qs[i]]) for i in range(25)], "query_id long, embedding array<double>")
    if method == "cells":
        got = dense_topk_ivf(q, v.repartition(7), k=10, n_cells=12, nprobe=1, max_cell_rows=20)
    else:
        got = dense_topk(q, v.repartition(7), k=10, **({"query_block": 10, "vector_block": 40} if method == "blocks" else {}))
    vn = vecs.astype(np.float64) / np.linalg.norm(vecs.astype(np.float64), axis=1, keepdims=True)
    qn = qs / np.linalg.norm(qs, axis=1, keepdims=True)
    s = qn @ vn.T
    for qi in range(25):
        order = sorted(range(300), key=lambda j: (-round(s[qi, j], 9), j))[:10]
        rows = got.where(F.col("query_id") == qi).orderBy("rank").collect()
        assert [r.vec_id for r in rows] == order


@pytest.mark.parametrize("partitions", [1, 16, 200])
def test_dense_blocks_meet_whatever_the_partitioning(spark, partitions):
    """Block pairs find each other without AQE's coalescing, too."""
    rnd = np.random.default_rng(8)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rnd.normal(size=(120, 8)))], "vec_id long, embedding array<double>")
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = dense_topk(v.withColumnRenamed("vec_id", "query_id"), v, k=5, query_block=50, vector_block=30).collect()
    finally:
        for k, x in old.items():
            spark.conf.set(k, x)
    m = np.random.default_rng(8).normal(size=(120, 8))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    want = {(q, int(j), r + 1) for q in range(120) for r, j in enumerate(sorted(range(120), key=lambda j: (-round(s[q, j], 9), j))[:5])}
    assert {(r.query_id, r.vec_id, r["rank"]) for r in got} == want


def test_lexical_topk_matches_bruteforce(spark):
    docs = [(f"d{i}", " ".join(random.Random(i).choice(["alpha", "beta", "gamma", "delta", "eps", "zz"])
                               for _ in range(random.Random(i + 99).randint(0, 12)))) for i in range(40)]
    d = spark.createDataFrame(docs, "chunk_id string, chunk_text string")
    postings, stats = fit_tfidf(d)
    queries = spark.createDataFrame([(1, "alpha beta beta"), (2, "unknownword"), (3, "zz delta")], "query_id long, query string")
    got = {(r.query_id, r.chunk_id): r.score for r in lexical_topk(queries, postings, stats, k=100).collect()}
    # brute force
    import re
    toks = {cid: re.findall(r"\w\w+", t.lower()) for cid, t in docs}
    n = len(docs)
    dfreq = {}
    for ts in toks.values():
        for t in set(ts):
            dfreq[t] = dfreq.get(t, 0) + 1
    idf = {t: math.log((1 + n) / (1 + c)) + 1 for t, c in dfreq.items()}

    def vec(ts):
        w = {}
        for t in ts:
            if t in idf:
                w[t] = w.get(t, 0) + idf[t]
        nrm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / nrm for t, x in w.items()} if nrm else {}
    dv = {cid: vec(ts) for cid, ts in toks.items()}
    for qid, qt in [(1, "alpha beta beta"), (2, "unknownword"), (3, "zz delta")]:
        qv = vec(re.findall(r"\w\w+", qt.lower()))
        for cid, v in dv.items():
            sc = sum(qv.get(t, 0) * x for t, x in v.items())
            if sc > 0:
                assert math.isclose(got[(qid, cid)], sc, rel_tol=1e-9)
            else:
                assert (qid, cid) not in got


def test_metrics_identities(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "x", 3), (2, "y", 1), (3, "c", 1)],
                                   "query_id long, doc_id string, rank int")
    qrels = spark.createDataFrame([(1, "a", 3), (1, "b", 2), (2, "z", 1), (3, "c", 2), (3, "d", 3)],
                                  "query_id long, doc_id string, grade int")
    queries = spark.createDataFrame([(1,), (2,), (3,), (4,)], "query_id long")
    m = {r.query_id: r for r in ev.rank_metrics(queries, ranked, qrels).collect()}
    assert m[1].ndcg_at_3 == pytest.approx(1.0)          # ideal order
    assert m[1].p_at_5 == pytest.approx(2 / 5) and m[1].r_at_5 == pytest.approx(1.0) and m[1].ap == pytest.approx(1.0)
    assert m[2].p_at_1 == 0 and m[2].ap == 0 and m[2].ndcg_at_10 == 0
    ideal = (2 ** 3 - 1) / math.log2(2) + (2 ** 2 - 1) / math.log2(3)
    assert m[3].ndcg_at_5 == pytest.approx((2 ** 2 - 1) / ideal)
    assert m[3].ap == pytest.approx(1 / 2)
    assert m[4].p_at_1 == 0 and m[4].r_at_10 == 0      # query without results scores 0


def test_latency_summary(spark):
    rows = [(1, "ok", float(x)) for x in range(1, 101)] + [(1, "error", 9999.0), (2, "error", 1.0),
                                                             (3, "ok", 5000.0)]
    df = spark.createDataFrame(rows, "step long, status string, latency_ms double")
    s = {r.step: r for r in ev.latency_summary(df, step_seconds=5.0).collect()}
    assert s[1].p95 == pytest.approx(np.percentile(range(1, 101), 95))
    assert s[1].rps == pytest.approx(20.0) and s[1].n_error == 1
    assert s[2].p95 is None and not s[2].breached
    assert s[3].breached and s[1].ramp_end == 3


def test_hybrid_with_fresh_docs(spark):
    from quarry.functions.embed import hashed_embedding
    from quarry.plans.hybrid import envelope, hybrid_search, retrieve
    chunks = spark.createDataFrame(
        [(f"c{i}", i, t) for i, t in enumerate(["alpha beta gamma", "beta delta", "gamma epsilon zeta",
                                                 "unrelated words here"])],
        "chunk_id string, doc_id long, chunk_text string")
    postings, stats = fit_tfidf(chunks)
    vecs = hashed_embedding(chunks.select("chunk_id", "chunk_text"), "chunk_text")
    q = spark.createDataFrame([(1, "beta"), (2, "nothing matches"), (3, "!! ?")], "query_id long, query string")
    fresh = spark.createDataFrame([(1, 1, "fresh web text about beta " + "x" * 6000)],
                                  "query_id long, fresh_pos long, text string")
    out = hybrid_search(q, chunks, postings, stats, vecs, fresh=fresh).collect()
    types = {(r.query_id, r.search_type) for r in out}
    assert (1, "fresh") in types                           # fresh rows take part in the rerank
    fr = [r for r in out if r.search_type == "fresh"][0]
    assert fr.rrf_score is None and len(fr.text) == 5000 and fr.has_exact_match
    env = {r.query_id: r for r in envelope(q, retrieve(q, chunks, postings, stats, vecs),
                                           hybrid_search(q, chunks, postings, stats, vecs)).collect()}
    assert env[1].bm25_count == 2 and env[1].total >= 2
    assert env[2].bm25_count == 0 and env[2].semantic_count == 4   # unknown terms still hash into buckets
    assert env[3].bm25_count == 0 and env[3].semantic_count == 0   # no token: zero vector, no hits
    assert env[3].total == 0 and env[3].result_ids == "" and env[3].results == []
    final = hybrid_search(q, chunks, postings, stats, vecs, fresh=fresh)
    full = {r.query_id: r for r in envelope(q, retrieve(q, chunks, postings, stats, vecs), final, fresh, "2024-01-01").collect()}
    assert (full[1].query, full[1].timestamp, full[1].fresh_count, full[2].fresh_count) == ("beta", "2024-01-01", 1, 0)
    assert [r.chunk_id for r in full[1].results] == full[1].result_ids.split(",") and "fresh-1" in full[1].result_ids
    assert len(full[1].results) == full[1].total


@pytest.mark.parametrize("cells, near, part", [(8, 8, 40), (8, 1, 2048), (1, 4, 30), (None, 4, 2048)])
def test_dense_cells_are_exact(spark, cells, near, part):
    """Clustered vectors: far cells are skipped, nothing is lost. Zero and null vectors link with nothing."""
    from quarry.operators.dense import dense_topk_ivf
    rnd = np.random.default_rng(5)
    base = rnd.normal(size=(8, 12)) * 3
    vecs = [[float(x) for x in base[i % 8] + rnd.normal(size=12) * 0.2] for i in range(240)]
    e = spark.createDataFrame([*enumerate(vecs), (900, None), (901, [0.0] * 12)], "vec_id long, embedding array<double>")
    q = e.where("vec_id < 60 or vec_id >= 900").withColumnRenamed("vec_id", "query_id")
    key = lambda df: sorted((r.query_id, r.rank, r.vec_id) for r in df.collect())
    assert key(dense_topk_ivf(q, e, 10, n_cells=cells, nprobe=near, max_cell_rows=part)) == key(dense_topk(q, e, 10))
    assert dense_topk_ivf(q, e.limit(0), 10).collect() == []


def test_semantic_dedup_greedy_keep_first(spark):
    from quarry.operators.neardup import semantic_dedup
    rnd = np.random.default_rng(11)
    base = rnd.normal(size=(6, 8))
    rows, vecs = [], []
    for i in range(60):
        b = base[rnd.integers(0, 6)]
        v = b + rnd.normal(scale=rnd.choice([0.05, 0.4, 1.2]), size=8)
        if i % 7 == 3 and vecs:
            v = vecs[-1].copy()                                  # exact copy of the previous row
        vecs.append(v)
        rows.append((i, [float(x) for x in v]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.kept for r in semantic_dedup(df, 0.85, block_rows=16).collect()}
    unit = [v / np.linalg.norm(v) for v in vecs]
    kept = []
    for i, u in enumerate(unit):                                 # greedy restatement
        ok = not any(float(u @ unit[j]) > 0.85 for j in kept)
        if ok:
            kept.append(i)
    assert sorted(i for i, k in got.items() if k) == kept
    assert len(got) == 60
