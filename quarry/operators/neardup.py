"""Semantic near-duplicate removal: greedy keep-first at cosine > threshold.

In key order, a row is dropped when it is similar (cosine > 0.85) to an
earlier row that was *kept*. Plan:

1. exact copies collapse first - a later identical vector is always dropped
   (it sees the same kept neighbour as its first copy), so the first copy
   stands for all of them and cliques of copies never become pairs;
2. similar pairs (earlier, later) of the remaining vectors come from a metric
   partition: every vector lives in the cell of its nearest pivot, and visits
   another cell only if that cell can hold a vector within the distance that
   the threshold allows. A vector of cell i is no farther from pivot i than from
   any other pivot, so it lies beyond the plane between both pivots, and the
   visitor's distance from that plane is a bound; the cell's radius gives a
   second one by the triangle inequality. A visitor goes to cells of smaller
   numbers only, so each pair meets once. Cells lie in blocks of at most
   ``block_rows`` vectors (8 MB, if not given), a crowded cell in several; a
   visitor is sent once to a block, whatever the number of its cells that it
   sees, and the visitors from one block meet another block in one group. So
   no group outgrows two blocks, and bounds decide again cell by cell there;
3. the greedy decision runs in rounds: a row whose earlier neighbours are
   all decided is kept when none of them is kept, dropped otherwise. Every
   round is a join and a grouped aggregate over the pair table; its result
   is checkpointed to the shared checkpoint folder. Rounds stop when no row
   is undecided (at most the longest chain of dependent pairs).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .dense import CELL_BYTES, PIECE_ROWS, _sized, _unit, cell_blocks


MAX_PIVOTS, MAX_SAMPLE = 2048, 16384
_SLACK = 1e-6


def pivots(v: DataFrame, n: int, reach: float) -> np.ndarray:
    """Pivots of ``n`` vectors: out of a sample (by a hash of the id, MAX_SAMPLE at
    most) the one farthest from those chosen, again and again, until none is
    farther than a quarter of ``reach`` or a quarter of the sample is chosen. Which
    ones they are decides how much is scored, never what is found."""
    size = min(n, MAX_SAMPLE, max(256, 16 * math.isqrt(n)))
    sample = np.array([r.v for r in v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(size).collect()])
    chosen, far = [0], np.full(len(sample), np.inf)
    for _ in range(min(MAX_PIVOTS, max(1, len(sample) // 4)) - 1):
        far = np.minimum(far, 2 - 2 * sample @ sample[chosen[-1]])
        if far.max() <= (reach / 4) ** 2:
            break
        chosen.append(int(far.argmax()))
    return sample[chosen]


def visits(x: np.ndarray, at: np.ndarray, home: np.ndarray, between: np.ndarray, radius: np.ndarray, reach: float) -> np.ndarray:
    """Marks of the cells (columns) that each vector has to visit, given its
    distances ``at`` to all pivots: those of smaller numbers within both bounds."""
    rows = np.arange(len(x))
    own = at[rows, home][:, None]
    gap = between[home]                                       # distances from the home pivot to all others
    plane = (at ** 2 - own ** 2) / np.maximum(2 * gap, 1e-12)
    near = (plane <= reach + _SLACK) | (gap <= _SLACK)
    return near & (at <= radius[None, :] + reach + _SLACK) & (np.arange(at.shape[1])[None, :] < home[:, None])


def similar_pairs(vectors: DataFrame, threshold: float = 0.85, key: str = "vec_id", vec: str = "embedding",
                  block_rows: int | None = None, work: dict | None = None) -> DataFrame:
    """(earlier, later, score) for every pair with cosine > threshold. ``work``
    receives the number of pairs scored and of all pairs."""
    spark = vectors.sparkSession
    v = cut_lineage(_unit(vectors, key, vec, "vec_id"))
    n, width = _sized(v)
    block_rows = block_rows or max(1, CELL_BYTES // width)
    kt = v.schema["vec_id"].dataType
    schema = T.StructType([T.StructField("earlier", kt), T.StructField("later", kt), T.StructField("score", T.DoubleType())])
    if n == 0:
        return spark.createDataFrame([], schema)
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    p = pivots(v, n, reach)
    between = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))
    bc = spark.sparkContext.broadcast((p, between))           # MAX_PIVOTS vectors and their distances

    def distances(pdf):
        x = np.vstack(pdf["v"].to_numpy())
        return x, np.sqrt(np.maximum(0, 2 - 2 * x @ bc.value[0].T))

    def pieces(batches):
        for batch in batches:
            for lo in range(0, len(batch), PIECE_ROWS):       # a piece times all pivots is what a task holds
                yield batch.iloc[lo:lo + PIECE_ROWS]

    def settle(batches):
        for pdf in pieces(batches):
            _, at = distances(pdf)
            home = at.argmin(axis=1)
            yield pdf.assign(home=home.astype(np.int32), far=at[np.arange(len(pdf)), home])

    vt = T.StructType([*v.schema.fields, T.StructField("home", T.IntegerType()), T.StructField("far", T.DoubleType())])
    lives = cut_lineage(v.mapInPandas(settle, vt))
    radius, count = np.full(len(p), -1e9), np.zeros(len(p), dtype=np.int64)
    for r in lives.groupBy("home").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect():     # one row a pivot
        radius[r.home], count[r.home] = r.far, r.n
    first, parts, n_blocks = cell_blocks(count, block_rows)
    lies = np.zeros((len(p), n_blocks), dtype=np.float32)     # cells by blocks: where their vectors are
    for c in np.nonzero(count)[0]:
        lies[c, first[c]:first[c] + parts[c]] = 1
    cells = spark.sparkContext.broadcast((radius, first, lies))

    def seen(pdf):
        x, at = distances(pdf)
        return x, visits(x, at, pdf["home"].to_numpy(), bc.value[1], cells.value[0], reach)

    def dealt(batches):
        """A vector's row in every block that it visits: those of its cell up to its own, and
        those where the cells lie that it has to see. Blocks follow the numbers of their cells."""
        _, first, lies = cells.value
        for pdf in pieces(batches):
            home, own = pdf["home"].to_numpy(), pdf["own"].to_numpy()
            block = np.arange(lies.shape[1])[None, :]
            go = (seen(pdf)[1] @ lies > 0) | ((block >= first[home][:, None]) & (block <= own[:, None]))
            row, blk = np.nonzero(go)
            for lo in range(0, len(row), 8 * PIECE_ROWS):
                yield pdf.iloc[row[lo:lo + 8 * PIECE_ROWS]].assign(blk=blk[lo:lo + 8 * PIECE_ROWS].astype(np.int32))

    shares = F.broadcast(spark.createDataFrame([(c, int(f), int(x)) for c, (f, x) in enumerate(zip(first, parts))], "home int, at int, parts int"))      # one row a pivot
    placed = lives.join(shares, "home").select("vec_id", "v", "home", (F.col("at") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int").alias("own"))
    dt = T.StructType([*placed.schema.fields, T.StructField("blk", T.IntegerType())])
    guests = placed.mapInPandas(dealt, dt)
    # pairs of blocks that meet: a row each
    meeting = F.broadcast(guests.select(F.col("blk").alias("at"), F.col("own").alias("guest")).distinct())
    residents = (placed.select(F.col("vec_id").alias("rid"), F.col("v").alias("rv"), F.col("home").alias("cell"), F.col("own").alias("at"))
                       .join(meeting, "at"))

    def meet(gp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(gp) and len(rp):
            rp = rp.sort_values("cell", kind="stable")
            rid, rm, cell = rp["rid"].to_numpy(), np.vstack(rp["rv"].to_numpy()), rp["cell"].to_numpy()
            here, start = np.unique(cell, return_index=True)
            end = np.append(start[1:], len(cell))
            lives_here = gp["own"].iloc[0] == gp["blk"].iloc[0]
            for part in pieces([gp]):
                gid, home = part["vec_id"].to_numpy(), part["home"].to_numpy()
                x, see = seen(part)
                for c, lo, hi in zip(here, start, end):
                    g = np.nonzero(see[:, c] | (home == c))[0]
                    hit = x[g] @ rm[lo:hi].T
                    score, hit = hit, hit > threshold
                    if lives_here:          # a cell's own pairs meet once
                        hit &= (home[g] != c)[:, None] | (gid[g][:, None] < rid[lo:hi][None, :])
                    a, b = np.nonzero(hit)
                    if len(a):
                        ga, rb = gid[g[a]], rid[lo:hi][b]
                        out.append(pd.DataFrame({"earlier": np.minimum(ga, rb), "later": np.maximum(ga, rb), "score": score[a, b]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"earlier": rp["rid"].iloc[:0], "later": rp["rid"].iloc[:0], "score": pd.Series([], dtype="float64")})

    if work is not None:
        def counted(batches):
            for pdf in pieces(batches):
                yield pd.DataFrame({"n": [int((seen(pdf)[1] @ count.astype(float)).sum())]})
        among = placed.mapInPandas(counted, "n long").agg(F.sum("n")).first()[0]
        work.update(scored=among + int((count * (count - 1) // 2).sum()), every=n * (n - 1) // 2)
    return guests.groupBy("blk", "own").cogroup(residents.groupBy("at", "guest")).applyInPandas(meet, schema)


def semantic_dedup(vectors: DataFrame, threshold: float = 0.85, key: str = "vec_id", vec: str = "embedding",
                   block_rows: int | None = None) -> DataFrame:
    """(key, kept, reason) for every row: reason 'first', 'copy' or 'similar'.
    Rows without a vector resemble nothing and are kept as 'first'."""
    every = vectors.select(F.col(key).alias("vec_id"), F.col(vec).cast("array<double>").alias("v"))
    without = every.where("v is null").select("vec_id", F.lit(True).alias("kept"), F.lit("first").alias("reason"))
    base = every.where("v is not null")
    first = base.groupBy("v").agg(F.min("vec_id").alias("first_id"))
    tagged = base.join(first, "v")
    copies = tagged.where(F.col("vec_id") != F.col("first_id")).select("vec_id")
    distinct = tagged.where(F.col("vec_id") == F.col("first_id")).select("vec_id", "v")
    edges = cut_lineage(similar_pairs(distinct, threshold, "vec_id", "v", block_rows).select("earlier", "later"))
    status = cut_lineage(distinct.select("vec_id", F.lit(None).cast("boolean").alias("kept")))
    while True:     # each round decides the earliest undecided row at least
        if status.where(F.col("kept").isNull()).isEmpty():
            break
        # per undecided row: are all earlier neighbours decided, is any kept?
        nb = (edges.join(status.withColumnRenamed("vec_id", "earlier").withColumnRenamed("kept", "ek"), "earlier")
                   .groupBy(F.col("later").alias("vec_id"))
                   .agg(F.max(F.col("ek").cast("int")).alias("any_kept"),
                        F.count_if(F.col("ek").isNull()).alias("undecided")))
        decided = F.when(F.col("kept").isNotNull(), F.col("kept")) \
                   .when(F.coalesce(F.col("any_kept"), F.lit(0)) == 1, F.lit(False)) \
                   .when(F.coalesce(F.col("undecided"), F.lit(0)) == 0, F.lit(True))
        status = cut_lineage(status.join(nb, "vec_id", "left").select("vec_id", decided.alias("kept")))
    out = status.select("vec_id", "kept", F.when(F.col("kept"), F.lit("first")).otherwise(F.lit("similar"))
                        .alias("reason"))
    out = out.unionByName(copies.select("vec_id", F.lit(False).alias("kept"), F.lit("copy").alias("reason")))
    return out.unionByName(without).withColumnRenamed("vec_id", key)
