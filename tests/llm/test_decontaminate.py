"""Planted benchmark passages, aligned scores, defined cases."""
import random

import numpy as np

from quarry.llm import decontaminate as dc

SCHEMA, ITEMS = "doc_id long, text string", "item_id long, text string"


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_equals_the_textbook():
    rng = random.Random(1)
    for _ in range(60):
        item = np.array([rng.randrange(6) for _ in range(rng.randrange(1, 14))], dtype=np.uint64)
        passages = [np.array([rng.randrange(6) for _ in range(rng.randrange(1, 20))], dtype=np.uint64) for _ in range(5)]
        score, p0, p1, i0, i1 = dc.align(item, passages)
        for k, p in enumerate(passages):
            assert score[k] == smith_waterman(item.tolist(), p.tolist())
            if score[k]:      # the reported stretch alone reaches the score
                assert smith_waterman(item[i0[k]:i1[k] + 1].tolist(), p[p0[k]:p1[k] + 1].tolist()) == score[k]


def test_copies_edits_and_clean_documents(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(40)).capitalize() + ".") for i in range(12)] + [(20, "two words"), (21, None), (22, ""), (0, "repeated id " + " ".join(text(30)))]
    docs, planted = [], set()
    for i in range(12):
        w = items[i][1].rstrip(".").lower().split()
        docs.append((i, " ".join(text(200) + w + text(100)).replace(" ", "\n", 3)))                       # exact
        edited = [x for k, x in enumerate(w) if k % 11 != 5]
        edited[7] = "other"
        docs.append((100 + i, ", ".join(text(30) + [x.upper() for x in edited] + text(500))))              # edited, other case and marks
        docs.append((200 + i, " ".join(text(20) + w[:26] + text(20))))                                     # most of it
        docs.append((300 + i, " ".join(text(400))))
        docs.append((400 + i, " ".join(text(100) + w[:6] + text(100))))                                    # a chance phrase
        planted |= {(i, i), (100 + i, i), (200 + i, i)}
    docs += [(900, None), (901, ""), (902, " ".join(text(60000)))]
    df, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, ITEMS)
    found = dc.contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == planted
    assert all(r.score == 1.0 and (r.first_word, r.last_word) == (200, 239) for r in found if r.doc_id < 100)
    left = dc.without_leaks(df, spark.createDataFrame(found, dc.contaminated(df.limit(0), bench).schema))
    assert {r.doc_id for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in planted}


def test_hot_passage_keeps_its_seeds(spark):
    words = [f"q{i}" for i in range(30)]
    docs = [(i, " ".join(words + [f"d{i}"])) for i in range(50)] + [(99, "nothing of it here at all")]
    found = dc.contaminated(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(1, " ".join(words))], ITEMS))
    assert sorted(r.doc_id for r in found.collect()) == list(range(50))


def test_blocks_empty_tables_and_clashing_names(spark):
    items = [(i, " ".join(f"i{i}_{k}" for k in range(20))) for i in range(6)]
    docs = [(i, t + " and more", 1.0, 7) for i, t in items]
    df = spark.createDataFrame(docs, SCHEMA + ", score double, item_id long")
    bench = spark.createDataFrame(items, ITEMS)
    old, dc.BLOCK_SEEDS = dc.BLOCK_SEEDS, 30
    try:
        assert sorted((r.doc_id, r.item_id) for r in dc.contaminated(df, bench).collect()) == [(i, i) for i in range(6)]
    finally:
        dc.BLOCK_SEEDS = old
    assert dc.contaminated(df, bench.limit(0)).collect() == [] and dc.contaminated(df.limit(0), bench).collect() == []


def test_evenly_edited_copies_are_found(spark):
    rng = random.Random(5)
    items = [(i, [f"i{i}_{k}" for k in range(16 + 4 * i)]) for i in range(12)]
    docs, planted = [], set()

    def plant(i, words):
        docs.append((len(docs), " ".join([f"a{len(docs)}_{k}" for k in range(50)] + words + [f"b{len(docs)}_{k}" for k in range(50)])))
        planted.add((len(docs) - 1, i))
    for i, w in items:
        if i % 2:       # a whole copy elsewhere makes the edited places no rarer than the kept ones
            plant(i, w)
        for every in (3, 4, 5, 6, 7):
            plant(i, [f"x{rng.random()}" if k % every == every - 1 else x for k, x in enumerate(w)])
        plant(i, [y for x in w for y in (x, f"y{rng.random()}")])      # a strange word behind each
    found = dc.contaminated(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(i, " ".join(w)) for i, w in items], ITEMS))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == planted


def test_passages_equal_all_alignments():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randrange(3, 30))] for _ in range(12)]
    texts = []
    for _ in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        for item in rng.sample(items, 2):
            part = [x for x in item if rng.random() > 0.15]
            w += [rng.choice(vocabulary) if rng.random() < 0.3 else x for x in part] + [rng.choice(vocabulary) for _ in range(rng.randrange(0, 20))]
        texts.append(" ".join(w))
    parts = [dc._words([" ".join(w)]) for w in items]
    own = dc.Items(list(range(len(items))), [w.h for w in parts], [np.unique(dc._pairs(w.h, w.doc)[0]) for w in parts], dc.THRESHOLD)
    want = {(d, i): s for d, t in enumerate(texts) for i, item in enumerate(items) if (s := smith_waterman(item, t.split())) >= dc.THRESHOLD * 2 * len(item)}
    old = dc.HITS
    for dc.HITS in (old, 50):
        got = {}
        for d, i, score, *_ in dc._matches(dc._words(texts), own, dc.Lookup(np.unique(own.seeds)), dc.THRESHOLD):
            got[d, i] = max(got.get((d, i), 0), round(score * 2 * len(items[i])))
        assert got == want and len(want) > 60
    dc.HITS = old
