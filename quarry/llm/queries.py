"""Registered queries of the operators: name -> callable(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, decontaminate, embed_dedup, language_id, lm, quality, repair, sharding, substring_dedup, toxicity, url_filter
from .common import table
from .near_dedup import near_duplicates

# Vocabulary files are a parameter; this one is installed with the box.
VOCABULARY = "byte_bpe_50k.tiktoken"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def put(fn):
        QUERIES[name] = fn
        return fn
    return put


@register("op3_minhash_near_dedup")
def op3(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


def vocabulary() -> tuple[str, str]:
    """Path of the rank file, and the pattern that splits texts."""
    import public_tokenizers
    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


@register("op4_byte_bpe")
def op4(spark, sf_dir):
    return bpe.round_trip(documents(spark, sf_dir), *vocabulary())


@register("op6_quality_classifier")
def op6(spark, sf_dir):
    return quality.quality(documents(spark, sf_dir), table(spark, sf_dir, "labels", "doc_id", "quality"))


@register("op8_virtual_slots")
def op8(spark, sf_dir):
    out = sharding.shard(documents(spark, sf_dir), n_shards=8)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
                      "virtual_slot", "map_version")


@register("op10_embedding_near_dedup")
def op10(spark, sf_dir):
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), cosine=0.95)


@register("op1_substring_dedup")
def op1(spark, sf_dir):
    found = substring_dedup.repeated_paragraphs(documents(spark, sf_dir))
    return found.select("doc_id", "par", "n_words", "first_doc", "first_par", "kept")


@register("op1_substring_spans")
def op1_spans(spark, sf_dir):
    return substring_dedup.repeated_spans(documents(spark, sf_dir))


@register("op1_substring_cut")
def op1_cut(spark, sf_dir):
    return substring_dedup.without_copies(documents(spark, sf_dir))


@register("op7_benchmark_decontamination")
def op7(spark, sf_dir):
    return decontaminate.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark", "item_id", "text"))


@register("op5_url_filter")
def op5(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages", "page_id", "url", "html"))


@register("op9_language_id")
def op9(spark, sf_dir):
    return language_id.languages(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


@register("op2_lm_scoring")
def op2(spark, sf_dir):
    return lm.scores(documents(spark, sf_dir))


@register("op13_conversation_repair")
def op13(spark, sf_dir):
    return repair.damage_and_repair(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


@register("op11_toxicity")
def op11(spark, sf_dir):
    return toxicity.toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels", "doc_id", "toxic"))


@register("op12_tokenizer_alignment")
def op12(spark, sf_dir):
    import public_tokenizers
    return align.alignment(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
