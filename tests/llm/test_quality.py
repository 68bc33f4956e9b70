"""Compression classifier: held-out accuracy and defined cases."""
from conftest import SF_MED
from quarry.llm import quality


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF_MED}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    held = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def test_labels_of_held_out_rows_are_not_read(spark):
    from pyspark.sql import functions as F
    docs, labels = (spark.read.parquet(f"{SF_MED}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality.quality(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_defined_cases(spark):
    rows = [(i, f"plain words of text number {i} and then some more of them", 1) for i in range(40)]
    rows += [(100 + i, f"JUNK!! {i} | {i * 7} ### $$$ !!", 0) for i in range(40)]
    docs = spark.createDataFrame([r[:2] + ("x",) for r in rows] + [(900, None, "x"), (901, "", "x"), (None, "text", "x"), (3, "text", "x"),
                                                                  (902, "plain words of text " * 50000, "x")],
                                 "doc_id long, text string, score string")
    marks = "doc_id long, quality int"
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (5, None), (3, 7)], marks)
    got = quality.quality(docs, labels).collect()
    assert len(got) == docs.count()
    score = {r.doc_id: r.score for r in got}
    assert score[900] == score[901]
    none = quality.quality(docs, spark.createDataFrame([], marks)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.quality(docs.limit(0), labels).collect() == []


def test_keep_good_keeps_all_columns(spark):
    docs = spark.createDataFrame([(1, "a", [1, 2]), (2, None, None)], "doc_id long, text string, more array<int>")
    model = quality.Model(b"", b"", None, 0.9)
    assert quality.keep_good(docs, model).collect() == docs.collect()
    assert quality.keep_good(docs, quality.Model(b"", b"", None, 0.1)).collect() == []
