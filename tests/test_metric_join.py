"""The metric partition finds every similar pair and scores fewer than all."""
import numpy as np
import pytest

from quarry.operators.neardup import similar_pairs


def frame(spark, m):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "vec_id long, embedding array<double>").repartition(5)


def brute(m, threshold):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = u @ u.T
    return {(i, j) for i in range(len(m)) for j in range(i + 1, len(m)) if s[i, j] > threshold}


def clustered(rnd, clusters, each, dim=24, spread=0.05):
    centres = rnd.normal(size=(clusters, dim))
    return np.repeat(centres, each, axis=0) + spread * rnd.normal(size=(clusters * each, dim))


@pytest.mark.parametrize("kind,block", [("clusters", 4000), ("clusters", 7), ("random", 50), ("one cluster", 20), ("line", 4000)])
def test_equals_brute_force(spark, kind, block):
    rnd = np.random.default_rng(4)
    m = {"clusters": clustered(rnd, 12, 15, spread=0.25), "random": rnd.normal(size=(200, 6)), "one cluster": clustered(rnd, 1, 90, spread=0.2),
         "line": np.column_stack([np.cos(np.linspace(0, 6, 150)), np.sin(np.linspace(0, 6, 150))])}[kind]
    for threshold in (0.85, 0.97):
        got = similar_pairs(frame(spark, m), threshold, block_rows=block).collect()
        assert len(got) == len({(r.earlier, r.later) for r in got}) and {(r.earlier, r.later) for r in got} == brute(m, threshold)


def test_scores_less_than_all_pairs_and_less_so_as_tables_grow(spark):
    share = []
    for clusters in (20, 80):
        work = {}
        similar_pairs(frame(spark, clustered(np.random.default_rng(5), clusters, 10)), work=work).collect()
        share.append(work["scored"] / work["every"])
    assert share[0] < 0.5 and share[1] < 0.5 * share[0]


def test_edges(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert similar_pairs(none).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, [2.0, 0.0]), (5, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert {(r.earlier, r.later) for r in similar_pairs(odd).collect()} == {(3, 4), (3, 5), (4, 5)}


@pytest.mark.parametrize("block", [60, 1000])
def test_a_visitor_is_sent_once_to_a_block(spark, block, monkeypatch):
    """Random vectors see nearly all cells: a row per cell, and all rows for one task, were sent."""
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps
    m = np.random.default_rng(6).normal(size=(600, 24))
    sent = []

    def spy(self, f, schema):
        sent.extend(g._df.groupBy(*keys).count().agg({"count": "max"}).first()[0] for g, keys in ((self._gd1, ["blk", "own"]), (self._gd2, ["at", "guest"])))
        sent.append(self._gd1._df.count())
        return run(self, f, schema)
    run = PandasCogroupedOps.applyInPandas
    monkeypatch.setattr(PandasCogroupedOps, "applyInPandas", spy)
    got = similar_pairs(frame(spark, m), 0.5, block_rows=block).collect()
    assert {(r.earlier, r.later) for r in got} == brute(m, 0.5) and len(got) > 20
    assert max(sent[:2]) <= 2 * block and sent[2] <= 600 * (1 if block == 1000 else 2 * 600 / block)


def test_cells_share_blocks():
    from quarry.operators.dense import cell_blocks
    first, parts, n = cell_blocks(np.array([3, 4, 0, 2, 25, 1, 10]), 10)
    assert first.tolist() == [0, 0, 0, 0, 1, 4, 5] and parts.tolist() == [1, 1, 1, 1, 3, 1, 1] and n == 6
