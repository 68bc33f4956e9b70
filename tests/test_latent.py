"""Trained text vectors against a dense SVD; recall and near-duplicates with them."""
import random

import numpy as np
import pytest

from quarry.operators import latent, memory
from quarry.operators.neardup import semantic_dedup
from quarry.operators.tfidf import fit_tfidf

TOPICS = {"cat": "cat kitten purr whiskers fur paw", "ship": "ship sail harbour anchor mast deck", "bread": "bread flour oven yeast dough crust",
          "star": "star orbit comet telescope planet nebula"}


def corpus(seed, n):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        topic = rnd.choice(list(TOPICS))
        rows.append((f"d{i:03d}", " ".join(rnd.choices(TOPICS[topic].split(), k=rnd.randint(4, 12)) + rnd.choices(["the", "and", "of"], k=2)), topic))
    return rows


@pytest.fixture(scope="module")
def trained(spark):
    rows = corpus(1, 120)
    postings, stats = fit_tfidf(spark.createDataFrame([r[:2] for r in rows], "chunk_id string, chunk_text string"))
    postings, stats = postings.checkpoint(), stats.checkpoint()
    vectors, values = latent.fit(postings, rank=4, rounds=5)
    return rows, postings, stats, vectors.checkpoint(), values


def test_equals_dense_svd(trained):
    rows, postings, _, vectors, values = trained
    terms = sorted({r.term for r in postings.select("term").distinct().collect()})
    place = {t: j for j, t in enumerate(terms)}
    a = np.zeros((len(rows), len(terms)))
    for r in postings.collect():
        a[int(r.chunk_id[1:]), place[r.term]] = r.weight
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    got = np.zeros((len(terms), 4))
    for r in vectors.collect():
        got[place[r.term]] = r.v
    assert np.allclose(values, s[:4], rtol=1e-6)
    assert np.allclose(got.T @ got, np.eye(4), atol=1e-8) and latent.angle(vt[:4].T, got) < 1e-3


def test_vectors_tell_topics_apart(spark, trained):
    rows, _, stats, vectors, _ = trained
    embed = latent.embedder(stats, vectors)
    # texts of one topic that share no word are near, those of two topics are not
    pairs = spark.createDataFrame([(1, "cat kitten purr"), (2, "whiskers fur paw"), (3, "ship sail mast"), (4, "unknown"), (5, None), (6, "cat kitten purr")], "vec_id long, text string")
    v = {r.vec_id: np.array(r.embedding) for r in embed(pairs, "text").collect()}
    assert v[1] @ v[2] > 0.8 and v[1] @ v[3] < 0.5 and not v[4].any() and not v[5].any() and np.array_equal(v[1], v[6])
    kept = {r.vec_id: r.reason for r in semantic_dedup(embed(pairs, "text").select("vec_id", "embedding"), 0.8).collect()}
    assert kept[1] == "first" and kept[2] == "similar" and kept[3] == "first" and kept[6] == "copy"


def test_recall_with_trained_vectors(spark, trained):
    _, _, stats, vectors, _ = trained
    turns = [(1, 0, "user", "purr whiskers"), (1, 1, "assistant", "ship anchor deck"), (1, 2, "user", "flour oven yeast"), (1, 3, "user", "kitten fur paw")]
    msgs = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = memory.recall(msgs, embed=latent.embedder(stats, vectors)).collect()
    assert [(r.conv_id, r.turn) for r in out] == [(1, 0)]


def test_registered_recall_equals_numpy(spark):
    import re

    from conftest import SF_SMALL
    from quarry.plans import catalog
    stats, vectors = catalog.message_vectors(spark, SF_SMALL)
    idf, v = ({r.term: r[1] for r in stats.select("term", "idf").collect()}, {r.term: np.array(r.v) for r in vectors.collect()})

    def vector(text):
        x = sum((idf[t] * v[t] for t in re.findall(r"[^\W]{2,}", (text or "").lower()) if t in v), np.zeros(8))
        n = np.linalg.norm(x)
        return x / n if n else x

    by_conv = {}
    for r in catalog.conversations(spark, SF_SMALL).collect():
        by_conv.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    want = {}
    for conv, rows in by_conv.items():
        users = [r for r in rows if r[1] == "user"]
        if users:
            q = max(users)
            scored = sorted(((round(float(vector(q[2]) @ vector(t)), 9), n) for n, _, t in rows if n < q[0]), reverse=True)[:5]
            for rank, (score, n) in enumerate(sorted((x for x in scored if x[0] > 0.7), key=lambda x: -x[1])[:3]):
                want[conv, q[0], n] = (rank + 1, score)
    got = {(r.conv_id, r.q_turn, r.turn): (r.recall_rank, r.score) for r in catalog.q_memory_recall_trained(spark, SF_SMALL).collect()}
    assert len(want) > 5 and got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-5 for k in want)


def test_nothing_to_train_on(spark):
    postings, stats = fit_tfidf(spark.createDataFrame([("a", "")], "chunk_id string, chunk_text string"))
    vectors, values = latent.fit(postings, rank=2)
    assert vectors.count() == 0 and len(values) == 0
