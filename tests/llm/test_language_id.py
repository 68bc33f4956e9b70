"""Gradients, held-out accuracy, defined cases."""
import numpy as np

from conftest import SF_MED
from quarry.llm import language_id as li


def test_gradients_equal_differences():
    net = li.Network(["a", "b", "c"], hidden=3)
    rng = np.random.default_rng(1)
    data = rng.integers(97, 105, (7, 4)).astype(np.uint8)
    label, weight = np.array([0, 1, 2, 1]), (rng.random((7, 4)) > 0.3).astype(np.float32)
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    g = net.gradients(data, label, weight)

    def loss():
        p = net.probabilities(data)
        return -(np.log(p[:, label, np.arange(4)]) * weight).sum() / weight.sum()
    for k, v in net.params.items():
        for at in [tuple(rng.integers(0, n) for n in v.shape) for _ in range(6)]:
            if k[0] == "X":
                at = (at[0], int(data[rng.integers(7), rng.integers(4)]))
            old, e = v[at], 1e-3
            v[at] = old + e
            up = loss()
            v[at] = old - e
            down = loss()
            v[at] = old
            assert abs((up - down) / (2 * e) - g[k][at]) < 2e-3, k


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_MED}/documents.parquet")
    got = {r.doc_id: r for r in li.languages(docs).collect()}
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert sorted(got) == sorted(lang) and all(0 <= r.score <= 1 for r in got.values())
    held = [d for d in got if got[d].held_out and got[d].lang_pred != "und"]
    assert sum(got[d].lang_pred == lang[d] for d in held) >= 0.95 * len(held)


def test_capitals_and_windows():
    assert li.as_seen("ÉÀß× Ab9\n".encode()).tobytes() == "éàß× ab  ".encode()
    texts = [b"", b"x" * 5, b"y" * (li.WINDOW * li.RUN_WINDOWS * 2 + 7), b"z" * li.WINDOW]
    have = np.zeros(4, dtype=int)
    for rows, owner in li._windows(texts):
        have += np.bincount(owner, weights=(rows != li.BLANK).sum(1), minlength=4).astype(int)
    assert have.tolist() == [len(t) for t in texts]


def test_defined_cases(spark):
    rows = [(i, "der die das und nicht" if i % 2 else "the and of that with", "de" if i % 2 else "en", 1) for i in range(60)]
    rows += [(100, None, "en", 1), (101, "", None, 1), (102, "123 !? ٣", "en", 1), (103, "日本", None, 1), (None, "the and", None, 1), (3, "the and of", None, 1),
             (104, "the and of that " * 30000, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = li.languages(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id >= 100}
    assert all((by[d].lang_pred, by[d].score) == ("und", 0.0) for d in (100, 101, 102))
    assert by[103].lang_pred in ("de", "en") and by[104].lang_pred == "en"
    assert li.languages(df.limit(0)).collect() == []
    unlabelled = li.languages(spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")).collect()
    assert [(r.lang_pred, r.score) for r in unlabelled] == [("und", 0.0)]
