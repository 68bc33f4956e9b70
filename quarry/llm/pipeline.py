"""Stages of the corpus pipeline: each reads what its predecessor kept, whole.

quality       documents that the compression classifier rejects go
near_dedup    one document of each group of near duplicates stays, the smallest doc_id
paragraphs    repeated paragraphs go, but for their first place
benchmark     documents with a passage of a test item go
tokens        ids of each text, and digests of the ids and of what they decode to

Stages keep all columns of ``documents`` (n_chars follows the text); the last
returns doc_id, lang, source, n_tokens, ids, ids_sha256, decoded_sha256.
Rows that share a doc_id and a text are one document from the second stage on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, near_dedup, quality, substring_dedup
from .common import prepare, stored, table
from .queries import vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.keep_good(docs, model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = near_dedup.near_duplicates(docs).where("kept").groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_n"))
    kept = stored(kept, "kept")
    once = docs.join(kept.where("_n = 1"), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    again = docs.join(kept.where("_n > 1"), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    return once.unionByName(again.dropDuplicates(["doc_id", "text"]))


def paragraphs_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(docs, substring_dedup.repeated_paragraphs(docs))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))
    return decontaminate.without_leaks(docs, found)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, *vocabulary(), keep=("doc_id", "lang", "source"), with_ids=True, own_task=True)


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("paragraphs", paragraphs_stage),
          ("benchmark", benchmark_stage), ("tokens", tokens_stage)]

# the classifier's scores cannot be stated in SQL; tests compare run() with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
