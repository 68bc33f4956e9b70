"""Links between shingle sets that collide in some key.

``link_components`` takes (key, id) rows, finds links among ids that share a
key, confirms each on the full sets and returns connected components. No key
emits all pairs of its ids:

1. each key compares its ids with its smallest one (a star, linear in rows);
2. after joining the confirmed links into components, keys whose ids all lie
   in one component need no more work, however many ids they hold;
3. what is left of a key with at most ``bucket`` ids is compared pair by pair,
   but only across components;
4. ids of larger unfinished keys get an exact prefix-filter join: two sets of
   similarity >= t share one of the rarest n - ceil(t n) + 1 shingles of each
   (rarity counted over those ids), so what many ids share (a common passage)
   never becomes a join key unless the sets can really reach t. The place of a
   shingle in this order bounds the size of a partner that first meets the set
   there; a pair is a candidate only where both bounds hold. There, too,
   a member first meets one member of a larger component, not all of them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stored

BUCKET = 48             # ids of a key that are compared pair by pair
SOME = 6                # members of a component that a candidate meets for each rare shingle, before it meets all
FREQUENT = 200_000      # shingles whose frequency orders the sets


def similar_enough(inter, n_a, n_b, percent: int = 75):
    """100 * intersection >= percent * union, in whole numbers."""
    return F.lit(100) * inter >= F.lit(percent) * (n_a + n_b - inter)


def confirm(pairs: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, name: str) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    pairs = stored(pairs, name + "-pairs")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = stored(sets_of(ids), name + "-sets")
    n_a, n_b = F.size("sa"), F.size("sb")
    # a pair whose sizes differ too much cannot reach the threshold
    size = sets.select("id", F.size("s").cast("long").alias("n"))
    fits = (pairs.join(size.select(F.col("id").alias("a"), F.col("n").alias("na")), "a")
                 .join(size.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
                 .where(F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb")).select("a", "b"))
    met = (fits.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
               .join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
               .where(similar_enough(F.size(F.array_intersect("sa", "sb")), n_a, n_b, percent)))
    return stored(met.select("a", "b"), name + "-links")


def _prefix_rows(sets: DataFrame, percent: int, name: str) -> DataFrame:
    """(id, n, xs, most): the rarest shingles of a set, rarest first, n its size.

    ``most`` is, for each of them, the size of the largest set that can be
    similar enough if this is the first shingle, in the order, that both have:
    then they share at most the n - p shingles from place p on, and sharing
    m >= t / (1 + t) (n + n') bounds n'. So two sets that reach the threshold
    have a first common shingle among their ``xs`` and each is small enough for
    the other's bound there. Shingles whose bound no partner of the least size,
    ceil(t n), meets are left out, and those that no other set has.

    This holds for any one order; putting the frequent ones last only makes it
    selective, so a bounded list of the most frequent ones (FREQUENT) serves
    for it. Shingles beyond a full list count as shared."""
    spark = sets.sparkSession
    often = (sets.select(F.explode("s").alias("x")).groupBy("x").agg(F.count("*").alias("df")).where("df > 1")
                 .orderBy(F.desc("df"), "x").limit(FREQUENT).collect())
    x = np.array([r.x for r in often], dtype=np.int64)
    order = np.argsort(x)
    shared = spark.sparkContext.broadcast((x[order], np.array([r.df for r in often], dtype=np.int64)[order]))
    full = len(often) >= FREQUENT

    def run(batches):
        known, df = shared.value
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            values, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
            rank = np.ones(len(values), dtype=np.int64)
            if len(known) and len(values):
                at = np.minimum(np.searchsorted(known, values), len(known) - 1)
                rank = np.where(known[at] == values, df[at], 1)
            out, bounds, owner, size = [], [], [], []
            for k in range(len(ids)):
                own, r = values[ends[k]:ends[k + 1]], rank[ends[k]:ends[k + 1]]
                n = len(own)
                need = (n * percent + 99) // 100
                first = np.lexsort((own, r))[:n - need + 1]
                bound = np.arange(n, n - len(first), -1) * (100 + percent) // percent - n
                keep = (bound >= need) & (full | (r[first] > 1))
                if not keep.any():
                    continue
                out.append(own[first[keep]])
                bounds.append(bound[keep])
                owner.append(ids[k])
                size.append(n)
            offsets = np.concatenate([[0], np.cumsum([len(v) for v in out])]).astype(np.int32)
            cols = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(v) if v else np.zeros(0, dtype=np.int64))) for v in (out, bounds)]
            yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(size, pa.int64()), *cols], names=["id", "n", "xs", "most"])
    return sets.select("id", "s").mapInArrow(run, "id long, n long, xs array<long>, most array<long>")


def _exact_links(ids: DataFrame, comp: DataFrame, sets_of, percent: int, name: str) -> DataFrame:
    """Links that join components of the ids; none that would is missed.

    A member of a component first meets one member of each larger component
    that shares rare shingles with it. What stays apart is compared further
    only where a member shares enough of its set with the whole component."""
    sets = stored(sets_of(ids), name + "-prefix-sets")
    rows = stored(_prefix_rows(sets, percent, name), name + "-prefix")
    listed = lambda df: (df.withColumn("_p", F.explode(F.arrays_zip("xs", "most"))).withColumn("x", F.col("_p.xs"))
                           .withColumn("most", F.col("_p.most")).drop("_p", "xs"))
    have = lambda want: sets.join(want, "id", "left_semi")

    def placed(labels: DataFrame) -> DataFrame:
        own = sets.select("id").join(labels, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))
        size = own.groupBy("comp").agg(F.count("*").alias("size"))
        return stored(own.join(size, "comp").select("id", F.struct("size", "comp").alias("c")), name + "-placed")

    def near(place: DataFrame) -> DataFrame:
        """(id, other, head) for ids and larger components with a rare shingle in common that both sides' bounds allow."""
        own = listed(rows.join(place, "id"))
        heads = own.groupBy("x", F.col("c").alias("other")).agg(F.min("id").alias("head"), F.min("n").alias("small"), F.max("most").alias("reach"))
        met = own.join(heads, "x").where("other > c and small <= most and reach >= n")
        met = met.groupBy("id", "other", "head").agg(F.count("*").alias("k"))
        best = met.groupBy("id", "other").agg(F.max_by("head", F.struct("k", "head")).alias("head"))
        return stored(best, name + "-near")

    def pair(x: str, y: str):
        return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")

    first = confirm(near(placed(comp)).select(*pair("id", "head")).distinct(), have, percent, name + "-first")
    label = components(first, name + "-comp1", comp)
    place = placed(label)
    apart = near(place).select("id", "other")
    if apart.isEmpty():
        return first
    # a member stays a candidate if the whole component has enough of its set
    spread = sets.join(place, "id").select("id", "c", F.size("s").alias("n"), F.explode("s").alias("x"))
    whole = spread.join(apart.select(F.col("other").alias("c")).distinct(), "c", "left_semi").select(F.col("c").alias("other"), "x").distinct()
    shares = (spread.join(apart, "id").join(whole, ["other", "x"]).groupBy("id", "other")
                    .agg(F.count("*").alias("shared"), F.first("n").alias("n")))
    rest = stored(shares.where(F.lit(100) * F.col("shared") >= F.lit(percent) * F.col("n")).select("id", "other"), name + "-rest")
    if rest.isEmpty():
        return first
    # it meets some members for each rare shingle, and only if none of them links, all members
    own = listed(rows.join(place, "id")).select("x", F.col("c").alias("other"), F.col("id").alias("mate"), F.col("n").alias("n2"), F.col("most").alias("most2"))
    draws = [F.xxhash64("mate", F.lit(k)) for k in range(SOME)]
    some = own.groupBy("x", "other").agg(F.array_distinct(F.array(*[F.min_by("mate", d) for d in draws])).alias("some"))
    met = listed(rows.join(rest, "id")).join(some, ["x", "other"]).select("id", F.explode("some").alias("mate"))
    second = confirm(met.select(*pair("id", "mate")).distinct(), have, percent, name + "-second")
    label = stored(components(second, name + "-comp2", label), name + "-label")
    mark = lambda c: label.select(F.col("id").alias(c), F.col("comp").alias("_" + c))
    still = (rest.withColumn("group", F.col("other.comp")).join(mark("id"), "id", "left").join(mark("group"), "group", "left")
                 .where(F.coalesce("_id", "id") != F.coalesce("_group", "group")).select("id", "other"))
    met = listed(rows.join(still, "id")).join(own, ["x", "other"]).where("n2 <= most and n <= most2").select("id", "mate")
    third = confirm(met.select(*pair("id", "mate")).distinct(), have, percent, name + "-third")
    return first.unionByName(second).unionByName(third)


def _cross(rows: DataFrame, key: str) -> DataFrame:
    """Pairs of ids that share a key and lie in different components."""
    a = rows.select(key, F.col("id").alias("a"), F.col("comp").alias("ca"))
    b = rows.select(key, F.col("id").alias("b"), F.col("comp").alias("cb"))
    return a.join(b, key).where("ca <> cb and a < b").select("a", "b").distinct()


def link_components(cands: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int = 75,
                    bucket: int = BUCKET, name: str = "link") -> DataFrame:
    """(id, comp) of every id with a confirmed link; see the module's text.

    ``sets_of(ids)`` returns (id, s array<long> without repeats) for the ids.
    """
    heads = cands.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1")
    members = stored(cands.join(heads, "key").select("key", "id", "head", "n"), name + "-members")
    star = members.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    links = confirm(star, sets_of, percent, name)
    comp = components(links, name + "-comp")

    placed = (members.join(comp, "id", "left").select("key", "id", "n", F.coalesce("comp", "id").alias("comp")))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    left = stored(placed.join(mixed, "key"), name + "-left")
    if left.isEmpty():
        return comp
    done = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
    pairs = _cross(left.where(F.col("n") <= bucket), "key")
    comp = components(confirm(pairs.join(done, ["a", "b"], "left_anti"), sets_of, percent, name + "-more"), name + "-comp2", comp)
    large = left.where(F.col("n") > bucket).select("id").distinct()
    if large.isEmpty():
        return comp
    return components(_exact_links(large, comp, sets_of, percent, name), name + "-comp3", comp)
