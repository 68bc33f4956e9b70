"""The exact join of shingle sets: bounds by place, components of crowded keys."""
import random

import pytest

from quarry.llm import common, linking

PERCENTS = (50, 75, 90)


def jaccard_at_least(a, b, percent):
    return 100 * len(a & b) >= percent * len(a | b)


def crowd(rng, groups=4, members=40):
    """Sets around a few centres, many of them just below or above the threshold."""
    sets = []
    for g in range(groups):
        centre = [g * 10_000 + k for k in range(rng.choice((6, 30, 60, 110)))]
        for _ in range(members):
            edits = rng.randrange(0, max(2, len(centre) // 4))
            own = set(centre[rng.randrange(0, 1 + len(centre) // 5):]) - set(rng.sample(centre, edits))
            own |= {rng.randrange(1 << 40, 1 << 41) for _ in range(rng.randrange(0, 1 + edits))}
            own |= set(rng.sample(range(5 * 10**6, 5 * 10**6 + 40), rng.randrange(0, 4)))      # shared by chance
            sets.append(own or {g})
    return sets


@pytest.mark.parametrize("percent", PERCENTS)
@pytest.mark.parametrize("listed", (linking.FREQUENT, 20))
def test_every_similar_pair_meets_within_both_bounds(spark, percent, listed, monkeypatch):
    common.prepare(spark)
    monkeypatch.setattr(linking, "FREQUENT", listed)       # a short list leaves shingles of unknown frequency
    sets = crowd(random.Random(percent))
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id long, s array<long>")
    post = {r.id: dict(zip(r.xs, r.most, strict=True)) for r in linking._prefix_rows(df, percent, "t").collect()}
    similar = met = every = 0
    for a in range(len(sets)):
        for b in range(a):
            pa, pb = post.get(a, {}), post.get(b, {})
            meets = any(len(sets[b]) <= pa[x] and len(sets[a]) <= pb[x] for x in pa.keys() & pb.keys())
            linked = jaccard_at_least(sets[a], sets[b], percent)
            assert meets or not linked
            similar, met, every = similar + linked, met + meets, every + bool(sets[a] & sets[b])
    assert 0 < similar <= met < every


@pytest.mark.parametrize("percent", (60, 75))
def test_one_crowded_key_equals_brute_force(spark, percent):
    common.prepare(spark)
    sets = crowd(random.Random(percent + 1), groups=3, members=30)
    sets += sets[:3]                                            # repeated sets
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id long, s array<long>")
    keys = spark.createDataFrame([(1, i) for i in range(len(sets))], "key long, id long")
    low = list(range(len(sets)))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i
    for a in range(len(sets)):
        for b in range(a):
            if jaccard_at_least(sets[a], sets[b], percent):
                x, y = sorted((find(a), find(b)))
                low[y] = x
    got = {r.id: r.comp for r in linking.link_components(keys, lambda ids: df.join(ids, "id", "left_semi"), percent, bucket=2).collect()}
    assert [got.get(i, i) for i in range(len(sets))] == [find(i) for i in range(len(sets))]
    assert 1 < len(set(got.values())) < len(got)


def test_no_candidates(spark):
    common.prepare(spark)
    keys = spark.createDataFrame([(1, 1), (2, 2)], "key long, id long")
    empty = spark.createDataFrame([], "id long, s array<long>")
    assert linking.link_components(keys, lambda ids: empty).collect() == []
    assert linking.link_components(keys.limit(0), lambda ids: empty).collect() == []
    assert linking._prefix_rows(empty, 75, "t").collect() == []
