"""Lemmas looked up in the rows equal those of the join, and shuffle nothing."""
import pytest

from quarry.operators import lemma as lem

TEXTS = [(1, "Были 12 Дома, дома! été x9 __ 99"), (2, ""), (3, None), (4, "слово " * 500), (5, "Ёлка ёлки Naïve naïve"), (6, "123 456")]
WORDS = [("были", "быть"), ("дома", "дом"), ("дома", "домой"), ("ёлки", "ёлка"), ("été", "ete"), ("naïve", None), ("слово", "слов0"), (None, "x")]


@pytest.mark.parametrize("mode", ["index", "strict"])
def test_lookup_equals_join(spark, mode):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)
    dic = spark.createDataFrame(WORDS, "form string, lemma string")
    rows = lambda n: {r.doc_id: (list(r.lemmas), r.lemma_text) for r in lem.lemmatize(docs, dic, mode=mode, max_bytes=n).collect()}
    near = rows(1 << 20)
    assert near == rows(0) and len(near) == len(TEXTS)
    assert near[1][0][:3] == (["быть", "дом", "дом"] if mode == "strict" else ["быть", "дом", "дом"]) and near[3] == ([], "") == near[2] == near[6]
    assert rows(1 << 20)[4][0] == ([] if mode == "strict" else ["слов0"] * 500)


def test_no_word_is_shuffled(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    dic = spark.createDataFrame(WORDS, "form string, lemma string")
    plan = lem.lemmatize(docs, dic)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_empty_dictionary_and_table(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    none = spark.createDataFrame([], "form string, lemma string")
    assert {r.doc_id: r.lemma_text for r in lem.lemmatize(docs, none).collect()}[1] == "были дома дома x9"
    assert lem.lemmatize(docs.limit(0), none).count() == 0
