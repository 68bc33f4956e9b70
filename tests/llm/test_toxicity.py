"""Toxicity: folding, matching against a plain scan, counting, held-out labels."""
import random
import zlib

import pytest
from conftest import SF_MED
from pyspark.sql import functions as F

from quarry.llm import toxicity as tox


@pytest.mark.parametrize("text,words", [
    ("Idiot!", ["idiot"]), ("1d10t m0r0n 5cum tr4sh", ["idiot", "moron", "scum", "trash"]), ("іdiоt ѕcum", ["idiot", "scum"]),
    ("ＩＤＩＯＴ", ["idiot"]), ("id​iot", ["idiot"]), ("stuuuupid", ["stupid"]), ("100 and 2001, or 3.5!", ["and", "or"]),
    ("Café, naïve; l'été", ["café", "naïve", "l", "été"]), ("stup!d @ss", ["stupid", "ass"]), ("", []), ("… 12 --", []), ("wow! ok", ["wow", "ok"])])
def test_fold(text, words):
    folded = tox.fold(text)
    assert folded.split() == words and (not words or folded == " " + " ".join(words) + " ")


def test_folded_l(spark):
    lex = tox.Lexicon({" clown ": 2.0, " worthless ": 3.0})
    assert lex.match("c1own") == (2.0, 1, 1) and lex.match("WOR7H1E55, wow")[0] == 3.0 and lex.match("crown")[0] == 0


def plain_match(lexicon, text):
    """Every place tried in turn."""
    folded = tox.fold(text)
    free = [(i, i + len(p)) for p in lexicon.phrases for i in range(len(folded)) if folded.startswith(p, i)]
    words = {}
    for term, w in lexicon.weights.items():
        for t in tox._spellings(term):
            for i in range(len(folded)):
                if folded.startswith(t, i) and not any(x <= i and i + len(t) <= y for x, y in free):
                    words[i] = max(w, words.get(i, 0))
    return sum(words[a] for a in sorted(words)), len(words), len(folded.split())


def test_match_equals_plain_scan():
    rnd = random.Random(3)
    lex = tox.Lexicon({" scum ": 2.5, " lowei": 1.5, " lo": 0.5, " trash ": 2.0, " can ": 0.1}, ("trash can", "pond scum"))
    words = ["scum", "Scum.", "trash", "can", "pond", "loweischaft", "lowei", "lol", "5cum", "tr4sh", "x", "\n", "éé", "trash can", "12"]
    for _ in range(300):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30)))
        assert lex.match(text) == pytest.approx(plain_match(lex, text))


def test_counts_and_choice(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(400):
        toxic = int(i % 8 == 0)
        words = [rnd.choice(["alpha", "beta", "gamma", "delta"]) + rnd.choice(["", "x", "yy"]) for _ in range(20)]
        words += [f"gruk{rnd.choice('abcdefgh')}{rnd.choice('abcdefgh')}" for _ in range(3 * toxic)] + ["blarg"] * (toxic and rnd.random() < .8) + ["gruk"] * (not toxic and i % 9 == 0)
        rows.append((toxic, i % 2, " ".join(words)))
    found = {r.term: r for r in tox.candidate_counts(spark.createDataFrame(rows, "toxic int, half int, text string").repartition(7)).collect()}
    for term in (" gruk", " blarg ", " alph", " alphax ", " gruk "):
        for c, t in (("a", 1), ("b", 0)):
            for h in (0, 1):
                times = [sum((" " + w + " ").startswith(term) for w in text.split()) for toxic, half, text in rows if (toxic, half) == (t, h)]
                assert [found[term][f"{c}{h}_{m}"] for m in tox.OFTEN] == [sum(x >= m for x in times) for m in tox.OFTEN]
                assert found[term][f"{c}{h}_n"] == sum(min(x, tox.MOST) for x in times)
    sums = lambda r, c: tuple(r[f"{c}0_{k}"] + r[f"{c}1_{k}"] for k in (*tox.OFTEN, "n"))
    chosen = tox.choose([(t, sums(r, "a"), sums(r, "b")) for t, r in found.items()], 50, 350, len(found))
    assert set(chosen) == {" gruk", " blarg "}


def test_held_out_labels(spark):
    read = lambda t: spark.read.parquet(f"{SF_MED}/{t}.parquet")
    out = tox.toxicity(read("documents"), read("labels"))
    assert out.count() == read("documents").count()
    rows = out.join(read("labels"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= .7) for r in rows)
    toxic, clean = [r for r in held if r.toxic], [r for r in held if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.8 * len(toxic) and sum(r.predicted for r in clean) <= 0.02 * len(clean)


SCHEMA = "doc_id long, text string"


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "scum idiot"), (3, "scum idiot"), (None, "loser"), (4, "fine words " * 200_000 + "idiot"), (5, "123 --")],
                                 SCHEMA).withColumn("score", F.lit("x")).withColumn("weight", F.lit(1)).withColumn("toxic", F.lit(1))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = tox.toxicity(docs, none).collect()
    assert len(rows) == 7
    score = {r.doc_id: r.score for r in rows}
    assert score[1] == score[2] == score[5] < 0.1 and score[3] > 0.7 and score[4] < 0.1
    assert tox.toxicity(docs.limit(0), none).count() == 0
    labelled = spark.createDataFrame([(1, 0), (2, None), (None, 1), (3, 1), (3, 0), (4, 0)], "doc_id long, toxic int")
    assert tox.toxicity(docs, labelled).count() == 7
