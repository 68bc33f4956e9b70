"""MinHash near-duplicate documents with tensored banding.

Two small collections of half keys are computed: u_1..u_m and v_1..v_m, each
made of ``rows`` minhashes. Table (i, j) has the key (u_i, v_j): m * m tables
come from 2 * m * rows minhashes instead of 2 * m * m * rows. Two sets of
similarity s share a table with probability (1 - (1 - s^rows)^m)^2; with
m = 12 and rows = 2 that is 0.9999 at s = 0.75 and higher above.

Plan
1. one pass over the texts gives the set size, a 128-bit hash of the word
   sequence and the half keys. Texts of equal words become one class;
2. a class needs a colliding u and a colliding v to share a table. Half keys
   are counted first (2 m rows a class), and only classes that collide in
   both collections are expanded to their m * m table keys;
3. ``linking.link_components`` confirms candidates on full sets.

Defined cases: null or empty texts and texts of white space have an empty set,
are linked with nothing and kept; each row is judged by its own text, so
repeated rows are copies of each other; rows without a doc_id are never the
smallest of their component; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (Words, few, minhashes, prepare, sequence_hash, shingles, signed, stored, text_bytes, units)
from .linking import link_components

HALVES, ROWS = 12, 2


def _signatures(m: int, rows: int):
    def run(batches):
        for batch in batches:
            texts = text_bytes(batch.column(1))
            w = Words(texts)
            first, length = units([w.doc])
            s, count = shingles(w.h, first, length)
            keys = minhashes(s, count, 2 * m * rows)
            half = np.zeros((len(count), 2 * m), dtype=np.uint64)
            for j in range(rows):
                half = (half ^ keys[:, j::rows]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j + 1)
                half ^= half >> np.uint64(31)
            owner = w.doc[first]
            n = np.zeros(len(texts), dtype=np.int64)
            begin = np.concatenate([[0], np.cumsum(count)])
            for k, d in enumerate(owner):
                n[d] = len(np.unique(s[begin[k]:begin[k + 1]]))
            h = np.zeros((2, len(texts)), dtype=np.int64)
            h[0, owner] = signed(sequence_hash(w.h, first, length, 0x2545F4914F6CDD1D))
            h[1, owner] = signed(sequence_hash(w.h, first, length, 0x9FB21C651E98DF25))
            full = np.zeros((len(texts), 2 * m), dtype=np.int64)
            full[owner] = signed(half)
            lists = lambda x: pa.ListArray.from_arrays(np.arange(0, x.size + 1, m, dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(h[0]), pa.array(h[1]), lists(full[:, :m]), lists(full[:, m:])],
                names=["doc_id", "n_shingles", "h1", "h2", "u", "v"])
    return run


def _sets(batches):
    for batch in batches:
        w = Words(text_bytes(batch.column(0)))
        first, length = units([w.doc])
        s, count = shingles(w.h, first, length)
        begin = np.concatenate([[0], np.cumsum(count)])
        own = [np.unique(s[begin[k]:begin[k + 1]]) for k in range(len(first))]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
        values = signed(np.concatenate(own)) if own else np.zeros(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(signed(sequence_hash(w.h, first, length, 0x2545F4914F6CDD1D))),
             pa.array(signed(sequence_hash(w.h, first, length, 0x9FB21C651E98DF25))),
             pa.ListArray.from_arrays(offsets, pa.array(values))], names=["h1", "h2", "s"])


def table_keys(classes: DataFrame, m: int) -> DataFrame:
    """(key, id) rows of the m * m tables, for classes that collide in both collections."""
    def collide(column):
        rows = classes.select("id", F.posexplode(column).alias("i", "x"))
        often = rows.groupBy("i", "x").agg(F.count("*").alias("n")).where("n > 1").select("i", "x")
        return rows.join(often, ["i", "x"]).select("id").distinct()

    both = classes.join(collide("u"), "id", "left_semi").join(collide("v"), "id", "left_semi")
    left = both.select("id", "v", F.posexplode("u").alias("i", "x"))
    full = left.select("id", "i", "x", F.posexplode("v").alias("j", "y"))
    # the key is a hash of the table and both half keys; a chance collision only adds a candidate
    return full.select(F.xxhash64("i", "j", "x", "y").alias("key"), "id")


def near_duplicates(docs: DataFrame, percent: int = 75, halves: int = HALVES, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    prepare(docs.sparkSession)
    text = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    key = docs.schema["doc_id"].dataType.simpleString()
    sig = stored(text.mapInArrow(_signatures(halves, rows), f"doc_id {key}, n_shingles long, h1 long, h2 long, u array<long>, v array<long>")
                     .withColumn("id", F.monotonically_increasing_id()), "near-sig")
    classes = stored(sig.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.min("doc_id").alias("low")), "near-classes")
    reps = sig.join(classes.select("id"), "id", "left_semi")

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = reps.select("id", "doc_id", "h1", "h2").join(ids, "id", "left_semi")
        who = few(stored(wanted.select(F.col("doc_id").alias("_doc")).distinct(), "near-who"))
        texts = text.join(who, F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi").select("text")
        sets = texts.mapInArrow(_sets, "h1 long, h2 long, s array<long>")
        return wanted.select("id", "h1", "h2").join(sets, ["h1", "h2"]).dropDuplicates(["id"]).select("id", "s")

    comp = link_components(table_keys(reps, halves), sets_of, percent, name="near")
    found = classes.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    lowest = found.groupBy("comp").agg(F.min("low").alias("component_id"))
    of_class = found.join(lowest, "comp").select("h1", "h2", "component_id")
    out = sig.select("doc_id", "n_shingles", "h1", "h2").join(
        of_class, ["h1", "h2"], "left")
    comp_id = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", comp_id.alias("component_id"),
                      F.coalesce(F.col("doc_id").eqNullSafe(comp_id), F.lit(True)).alias("kept"))
