"""Text vectors trained on the corpus: truncated SVD of the TF-IDF matrix.

The matrix A (texts x terms) stays a table of postings. Power iterations on a
subspace of ``rank + EXTRA`` columns alternate Y = A Z (postings joined with term
vectors, summed by text) and Z = A' Y (joined with text vectors, summed by
term), both with partial sums before the shuffle. What leaves Spark in a step is
the Gram matrix of the columns, a few dozen numbers squared, which makes them
orthonormal. The start needs no table: a term's random row follows from its hash.

A text's vector is its TF-IDF vector times the term vectors, made unit.
``embedder`` gives the hook that search, recall and de-duplication take. Texts
without a known term have zeros.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tfidf import term_counts

RANK, EXTRA, ROUNDS = 32, 8, 6


def _columns(width: int) -> list[str]:
    return [f"c{j}" for j in range(width)]


def _summed(rows: DataFrame, by: str, width: int) -> DataFrame:
    return rows.groupBy(by).agg(*[F.sum(F.col("weight") * F.col(c)).alias(c) for c in _columns(width)])


def _gram(df: DataFrame, width: int) -> np.ndarray:
    """Inner products of the columns: width * (width + 1) / 2 numbers."""
    names = _columns(width)
    sums = [F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0.0)) for i, a in enumerate(names) for b in names[i:]]
    values = iter(df.agg(F.array(*sums).alias("g")).first().g)
    g = np.zeros((width, width))
    for i in range(width):
        for j in range(i, width):
            g[i, j] = g[j, i] = next(values)
    return g


def _turned(df: DataFrame, key: str, m: np.ndarray) -> DataFrame:
    """The columns times a small matrix."""
    names = _columns(m.shape[0])
    return df.select(key, *[sum((F.col(c) * float(m[i, j]) for i, c in enumerate(names)), F.lit(0.0)).alias(f"c{j}") for j in range(m.shape[1])])


def _orthonormal(df: DataFrame, key: str, width: int) -> tuple[DataFrame, np.ndarray]:
    """Orthonormal columns with the same span, by falling strength, and their strengths."""
    values, vectors = np.linalg.eigh(_gram(df, width))
    order = [i for i in np.argsort(-values) if values[i] > 1e-12 * max(values.max(), 1e-300)]
    m = vectors[:, order] / np.sqrt(values[order])
    return _turned(df, key, m), np.sqrt(values[order])


def fit(postings: DataFrame, key: str = "chunk_id", rank: int = RANK, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(term, v ARRAY<DOUBLE>) and singular values, from (term, key, weight)."""
    a = cut_lineage(postings.select("term", F.col(key).alias("text"), "weight"))
    width = rank + EXTRA
    # uniform numbers in -1 .. 1 from a hash of term and column
    start = [(F.xxhash64(F.col("term"), F.lit(j)) / F.lit(float(1 << 63))).alias(f"c{j}") for j in range(width)]
    y = cut_lineage(_summed(a.select("text", "weight", *start), "text", width))
    values = np.zeros(0)
    z = None
    for _ in range(rounds):
        y, _s = _orthonormal(y, "text", width)
        width = len(_s)
        if not width:
            break
        z = cut_lineage(_summed(a.join(y, "text"), "term", width))
        z, values = _orthonormal(z, "term", width)
        width = len(values)
        z = cut_lineage(z)
        y = cut_lineage(_summed(a.join(z, "term"), "text", width))
    if z is None or not width:
        return a.select("term", F.array().cast("array<double>").alias("v")).distinct(), values
    # turn the term vectors to the singular directions of A restricted to them
    strength, turn = np.linalg.eigh(_gram(y, width))
    order = np.argsort(-strength)[:rank]
    best = _turned(z, "term", turn[:, order])
    return best.select("term", F.array(*_columns(len(order))).alias("v")), np.sqrt(np.maximum(strength[order], 0))


def embedder(term_stats: DataFrame, term_vectors: DataFrame):
    """A hook (df, text_col, out_col) -> df with unit vectors of the texts."""
    vectors = cut_lineage(term_vectors.join(term_stats.select("term", "idf"), "term"))
    width = (vectors.agg(F.max(F.size("v"))).first()[0]) or 0

    def embed(df: DataFrame, text_col: str, out_col: str = "embedding") -> DataFrame:
        rows = df.withColumn("_h", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
        texts = rows.select("_h", F.col(text_col).alias("_text")).dropDuplicates(["_h"])
        w = (term_counts(texts, "_h", "_text").join(vectors, "term").withColumn("weight", F.col("tf") * F.col("idf"))
             .select("_h", "weight", *[F.col("v")[j].alias(f"c{j}") for j in range(width)]))
        sums = _summed(w, "_h", width)
        norm = F.sqrt(sum((F.col(c) * F.col(c) for c in _columns(width)), F.lit(0.0)))
        unit = sums.withColumn("_norm", norm).select("_h", F.when(F.col("_norm") > 0, F.array(*[F.col(c) / F.col("_norm") for c in _columns(width)])).alias(out_col))
        zeros = F.array(*[F.lit(0.0)] * width).cast("array<double>")
        return rows.join(unit, "_h", "left").withColumn(out_col, F.coalesce(out_col, zeros)).drop("_h")
    return embed


def angle(a: np.ndarray, b: np.ndarray) -> float:
    """Largest angle between the spans of two sets of orthonormal columns."""
    return math.acos(min(1.0, float(np.linalg.svd(a.T @ b, compute_uv=False).min())))
