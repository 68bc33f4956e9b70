"""Dictionary lemmatisation of index text.

Words are the lower-cased runs of letters, digits and '_'. Two rule sets:

index  - drop all-digit words; a word starting with [a-z0-9] is kept as is;
         any other word is replaced by its dictionary lemma (itself when
         absent) and kept only if the lemma is [а-яёa-z0-9]+ (case-insensitive).
strict - drop all-digit words and words without a Latin/Cyrillic letter;
         lemma = dictionary lemma or the word; kept only if [а-яёa-z]+.

Plan: the words of a text stay in its row, whatever the size of the dictionary:
``lookup.look_up`` adds their dictionary lemmas as a second array, and the rules
run on the arrays as Spark expressions. So no word is shuffled, and texts only
where the dictionary is too large to be broadcast. A form that a dictionary
holds twice has its smallest lemma.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BROADCAST_MAX_BYTES
from ..session import cut_lineage
from .lookup import PART_BYTES, look_up

WORD_RUN = r"[\p{L}\p{N}_]+"

# Accent folding used to derive a dictionary from a corpus.
FOLD_FROM = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿß"
FOLD_TO = "aaaaaaceeeeiiiinooooouuuuyys"


def word_positions(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.posexplode(F.regexp_extract_all(F.lower(text), F.lit(WORD_RUN), 0)).alias("pos", "word"))


def folding_dictionary(df: DataFrame, key: str, text: str) -> DataFrame:
    """(form, lemma) for every corpus word that starts outside [a-z0-9]:
    lemma = the word with accents folded."""
    w = word_positions(df, key, text).select("word").distinct()
    return (w.where(~F.col("word").rlike("^[a-z0-9]"))
             .select(F.col("word").alias("form"), F.translate("word", FOLD_FROM, FOLD_TO).alias("lemma")))


def _rules(mode: str):
    """(lemma, kept) of a word and its dictionary lemma or null."""
    def index(word, found):
        as_is = word.rlike("^[a-z0-9]")
        lemma = F.when(as_is, word).otherwise(F.coalesce(found, word))
        return lemma, ~word.rlike(r"^\p{Nd}+$") & (as_is | lemma.rlike("(?i)^[а-яёa-z0-9]+$"))

    def strict(word, found):
        lemma = F.coalesce(found, word)
        return lemma, ~word.rlike(r"^\p{Nd}+$") & word.rlike("(?i)[а-яёa-z]") & lemma.rlike("(?i)^[а-яёa-z]+$")

    if mode not in ("index", "strict"):
        raise ValueError(f"unknown mode {mode!r}")
    return index if mode == "index" else strict


def lemmatize(df: DataFrame, lemma_dict: DataFrame, key: str = "doc_id", text: str = "text",
              mode: str = "index", max_bytes: int = BROADCAST_MAX_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """(key, lemmas ARRAY<STRING> in word order, lemma_text STRING)."""
    rules = _rules(mode)
    d = cut_lineage(lemma_dict.where("form IS NOT NULL").groupBy("form").agg(F.min("lemma").alias("lemma")))
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD_RUN), 0)
    rows = df.select(key, F.coalesce(words, F.array().cast("array<string>")).alias("_w"))
    n_bytes = df.agg(F.sum(F.octet_length(text))).first()[0]
    found = look_up(rows, "_w", d.select("form", F.col("lemma").alias("_f")), "form", ("_f",), n_bytes, max_bytes, part_bytes)
    pairs = F.filter(F.arrays_zip("_w", "_f"), lambda x: rules(x["_w"], x["_f"])[1])
    out = found.select(key, F.transform(pairs, lambda x: rules(x["_w"], x["_f"])[0]).alias("lemmas"))
    return out.withColumn("lemma_text", F.array_join("lemmas", " "))


def query_normalizer(lemma_dict: DataFrame, key: str = "query_id", text: str = "query", mode: str = "index"):
    """A ``normalize_query`` hook for lexical search: replaces the query text
    by its lemma text (same rules as the corpus)."""
    def run(queries: DataFrame) -> DataFrame:
        lem = lemmatize(queries.select(key, text), lemma_dict, key, text, mode)
        return queries.drop(text).join(lem.select(key, F.col("lemma_text").alias(text)), key)
    return run
