"""MinHash near-dedup against brute force, and its defined cases."""
import random

import pytest

from conftest import SF_SMALL


def words(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()


def brute(rows, percent=75):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(sets[i]), low[find(i)], low[find(i)] == d) for i, (d, _) in enumerate(rows))


def run(spark, rows, **kw):
    from quarry.llm.near_dedup import near_duplicates
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(tuple(r) for r in near_duplicates(df, **kw).collect())


def edited(rng, base, n):
    w = list(base)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "One two"), (4, "one  TWO\n"), (5, "one two three"), (6, "É one"), (7, "é one")]
    base = [f"w{i}" for i in range(120)]
    for i in range(90):                                   # near copies, some only close to each other
        rows.append((100 + i, edited(rng, base, rng.randrange(0, 7))))
    for i in range(70):                                   # share a passage, little else
        rows.append((300 + i, " ".join(passage + [f"u{i}_{k}" for k in range(rng.randrange(8, 60))])))
    for i in range(20):
        rows.append((500 + i, rows[8 + i][1].upper()))    # copies but for case
    rows.append((900, " ".join(f"long{i % 4000}" for i in range(30000))))
    rows.append((901, " ".join(f"long{i % 4000}" for i in range(29000))))
    rng.shuffle(rows)
    return rows


def test_equals_brute_force(spark, corpus):
    assert run(spark, corpus) == brute(corpus)


def test_large_buckets_take_the_exact_way(spark, corpus):
    """With a tiny bucket bound nearly everything goes through the prefix filter."""
    import quarry.llm.near_dedup as nd
    from quarry.llm import linking
    real = linking.link_components

    def small(*a, **k):
        return real(*a, **{**k, "bucket": 2})
    nd.link_components = small
    try:
        assert run(spark, corpus) == brute(corpus)
    finally:
        nd.link_components = real


def test_empty_table_clashing_names_and_repeated_rows(spark):
    from pyspark.sql import functions as F
    from quarry.llm.near_dedup import near_duplicates
    assert run(spark, []) == []
    df = spark.createDataFrame([(7, "a b c d e f", 1), (7, "a b c d e f", 2), (3, "A b c d e f", 3), (None, "a b c d e f", 4), (None, None, 5)],
                               "doc_id long, text string, n int")
    df = df.withColumn("key", F.lit(1)).withColumn("id", F.lit(2)).withColumn("comp", F.lit(3)).withColumn("s", F.lit("x"))
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert got == [("3", 2, 3, True), ("7", 2, 3, False), ("7", 2, 3, False), ("None", 0, None, True), ("None", 2, 3, False)]


def test_given_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)
