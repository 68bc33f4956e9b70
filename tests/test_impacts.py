"""Block-maximum pruning returns what scoring everything returns, and visits less."""
import random

import pytest

from quarry.operators.impacts import blocks, impacts, pruned_topk
from quarry.operators.tfidf import fit_from_counts, lexical_topk, term_counts
from quarry.plans.strategy import broadcast_if_small, measured_bytes


def build(spark, docs, size):
    tf = term_counts(spark.createDataFrame(docs, "chunk_id string, chunk_text string"), "chunk_id", "chunk_text", keep_empty=True).checkpoint()
    postings, stats = fit_from_counts(tf)
    postings, stats = postings.checkpoint(), stats.checkpoint()
    placed = blocks(tf, stats, size=size).checkpoint()
    return postings, stats, placed, impacts(postings, placed).checkpoint()


def topic_docs(rnd, n):
    """Texts of eight topics with words of their own, and words they all use."""
    return [(f"d{i:05d}", " ".join([f"t{i % 8}w{rnd.randint(0, 40)}" for _ in range(rnd.randint(3, 30))] + rnd.choices(["the", "of", "and"], k=rnd.randint(0, 9)))) for i in range(n)]


@pytest.mark.parametrize("size,seeds,k", [(4, 1, 5), (16, 2, 10), (1000, 4, 3)])
def test_equals_scoring_everything(spark, size, seeds, k):
    rnd = random.Random(size)
    docs = topic_docs(rnd, 300) + [("empty", ""), ("null", None)] + [(f"copy{i}", "t1w1 t1w2 the") for i in range(30)]
    postings, stats, placed, index = build(spark, docs, size)
    assert placed.count() == len(docs) and placed.groupBy("block").count().agg({"count": "max"}).first()[0] <= size
    queries = spark.createDataFrame([(i, d) for i, (_, d) in enumerate(rnd.sample(docs, 20))] + [(97, "unknown words"), (98, ""), (99, None), (100, "the of and"), (101, "t1w1 t1w2")],
                                    "query_id long, query string")
    rows = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in df.collect())
    assert rows(pruned_topk(queries, index, placed, stats, k=k, seeds=seeds)) == rows(lexical_topk(queries, postings, stats, k=k))


def test_visits_grow_slower_than_the_corpus(spark):
    share = []
    for n in (400, 1600):
        rnd = random.Random(1)
        docs = topic_docs(rnd, n)
        _, stats, placed, index = build(spark, docs, 8)
        queries = spark.createDataFrame([(i, docs[i][1]) for i in range(24)], "query_id long, query string")
        counts = {}
        pruned_topk(queries, index, placed, stats, k=5, counts=counts).collect()
        share.append(counts["visited"] / (24 * n / 8))
    assert share[1] < 0.8 * share[0] and share[1] < 0.5


def test_broadcasts_go_by_bytes(spark):
    few = spark.createDataFrame([(1, "x" * 1000, [1.0] * 100)], "a long, b string, c array<double>")
    n = measured_bytes(few)
    assert 1800 <= n <= 2000
    plan = lambda df: few.join(df, "a")._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(broadcast_if_small(few, n)).lower() and "broadcast" not in plan(broadcast_if_small(few, n - 1)).lower()
    assert measured_bytes(few.limit(0)) == 0 and measured_bytes(spark.createDataFrame([(None, None, None)], few.schema)) < 100
