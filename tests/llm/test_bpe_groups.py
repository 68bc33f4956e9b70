"""Tokenizers of one task hold the steps of little text at once."""

import public_tokenizers as P
from pyspark.sql import functions as F

from quarry.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


def test_smaller_groups_change_nothing():
    texts = [f"text {i} of unusualwords{i * 7919} and más, ok.\n" * (1 + i % 5) for i in range(60)] + ["", "  "]
    rank_file = bpe.read_vocabulary(PATH)
    small, usual = bpe.Tokenizer(rank_file, P.PATTERN, group=100), bpe.Tokenizer(rank_file, P.PATTERN)
    cut = list(bpe._groups(texts, small.group))
    assert len(cut) > 10 and [t for g in cut for t in g] == texts
    assert [x for g in cut for x in small.encode(g)] == usual.encode(texts)


def test_own_task_takes_small_groups(spark, monkeypatch):
    made = []
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: made.append(run))
    for own in (True, False):
        bpe.round_trip(docs, PATH, P.PATTERN, own_task=own)
    sizes = []
    monkeypatch.setattr(bpe, "_joined", lambda batches, size: sizes.append(size) or iter(()))
    for run in made:
        assert list(run(iter(()))) == []
    assert sizes == [2 * bpe.GROUP_CHARS_IN_TASK, 2 * bpe.GROUP_CHARS] and sizes[0] * 4 == sizes[1]
