"""Counts and base scores against brute force, normalised probabilities, held-out gain."""
import math
import zlib
from collections import Counter

import numpy as np

from conftest import SF_MED
from quarry.llm import lm


def brute(rows):
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    words = lambda t: (t or "").encode().lower().split() + [b"\n"]
    c = Counter(w for d, t in rows if not held(d) for w in words(t))
    n, v = sum(c.values()), len(c)
    out = []
    for d, t in rows:
        w = words(t)
        out.append((str(d), held(d), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)))
    return sorted(out)


def check(spark, rows, extra=""):
    df = spark.createDataFrame(rows, "doc_id long, text string" + extra)
    got = lm.scores(df).collect()
    want = brute([r[:2] for r in rows])
    have = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    assert [x[:5] for x in have] == [x[:5] for x in want]
    assert all(abs(a[5] - b[5]) <= 1e-9 * max(1, abs(b[5])) for a, b in zip(have, want, strict=True))
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)
    return got


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_MED}/documents.parquet").select("doc_id", "text").collect()]
    got = check(spark, rows)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.05 * sum(r.n_tokens for r in held)


def test_rare_words_join_their_counts(spark, monkeypatch):
    """With a short list of hot words nearly all counts come through the join."""
    monkeypatch.setattr(lm, "HOT", 3)
    monkeypatch.setattr(lm, "COUNTED", 4)
    check(spark, [(i, f"a a b word{i % 7} W{i % 3} É{i}") for i in range(60)])


def test_defined_cases(spark):
    rows = [(1, None, 1), (2, "", 1), (2, "", 1), (3, " \n", 1), (None, "x y", 1), (4, "x " * 70000, 1), (5, "  A a", 1), (6, "x\x0by\x1cz", 1)]
    check(spark, rows, ", word int")
    assert lm.scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    only, = lm.scores(spark.createDataFrame([(held, "never trained")], "doc_id long, text string")).collect()
    assert (only.n_known, only.train_tokens, only.base_score) == (0, 0, 0.0)


def test_probabilities_are_normalised():
    rng = np.random.default_rng(1)
    p = rng.random(lm.CLASSES)
    net = lm.LogBilinear(np.log(p / p.sum()))
    net.load(net.flat() + rng.standard_normal(len(net.flat())) * 0.3)
    ctx = rng.integers(0, lm.CLASSES + 1, (3, lm.CONTEXT))
    for row in ctx:
        every = net.log_probabilities(np.repeat(row[None], lm.CLASSES, axis=0), np.arange(lm.CLASSES))
        assert abs(np.exp(every).sum() - 1) < 1e-5


def test_contexts_stay_inside_their_text():
    got = lm.contexts(np.array([5, 6, 7, 8]), np.array([3, 1]))
    s = lm.START
    assert got.tolist() == [[s] * lm.CONTEXT, [5] + [s] * (lm.CONTEXT - 1), [6, 5] + [s] * (lm.CONTEXT - 2), [s] * lm.CONTEXT]


def test_noise_contrast_learns_a_rule():
    """Classes alternate: training must find it."""
    log_unigram = np.log(np.full(lm.CLASSES, 1e-6))
    log_unigram[:4] = math.log(0.25)
    net = lm.LogBilinear(log_unigram)
    step = net.trainer()
    cls = np.tile(np.arange(4), 5000)
    ctx = lm.contexts(cls, np.array([len(cls)]))
    for a in range(0, len(cls) - lm.BATCH, lm.BATCH):
        step(ctx[a:a + lm.BATCH], cls[a:a + lm.BATCH])
    assert net.log_probabilities(ctx[100:200], cls[100:200]).mean() > math.log(0.5)


def test_frequent_words_with_the_same_letters_are_told_apart():
    words = [f"same{i}".encode() for i in range(255)]
    number, cls = lm.Lexicon(words, [1000 - i for i in range(255)]).classes(words)
    assert number.tolist() == list(range(255)) and len(set(cls.tolist())) == 255
    model = lm.LogBilinear(np.log(np.full(lm.CLASSES, 1 / lm.CLASSES)))
    assert np.linalg.matrix_rank(model.q @ model.r.T) >= 16      # dimensions in which contexts and words differ
