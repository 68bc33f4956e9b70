"""Shards from fixed virtual slots.

Records are hashed into a fixed number of virtual slots (thousands). Bytes are
summed per slot, and a small slot-to-shard map says where each slot lives. The
map is stored in versions; rebalancing edits it by moving whole slots, so
records never change their slot and only moved slots are copied. The law held
is ``bytes``: shards get sizes as near equal as whole slots allow.

The map and the slot totals have one row per slot (``n_slots``, a parameter),
whatever the input; everything per record is a DataFrame job. Raise
``n_slots`` with the number of shards.

Defined cases: a null text has size 1 and CRC 0; rows without a doc_id are
spread by their text; repeated rows share a virtual slot and get positions of
their own; an empty table gives an empty result and an even map.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import prepare, stored, work_path

N_SLOTS = 4096
LAW = "bytes"
MAP = "virtual_slot int, shard int"


def with_slots(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of each record."""
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    sized = docs.select("doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    return sized.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_slots)).cast("int"))


def even_map(n_shards: int, n_slots: int = N_SLOTS) -> dict[int, int]:
    """First version of a map: slots dealt round."""
    return {s: s % n_shards for s in range(n_slots)}


def rebalance(slot_map: dict[int, int], weight: dict[int, int], n_shards: int) -> dict[int, int]:
    """Edit a map. Shards above the mean give up slots, the largest that fit in
    their surplus first; those go, largest first, to the lightest shard. Then
    the heaviest shard hands the lightest one the slot nearest to half their
    difference, as long as that evens them out. Other slots stay where they are."""
    mean = sum(weight.get(s, 0) for s in slot_map) / n_shards
    load = [0] * n_shards
    own: list[set[int]] = [set() for _ in range(n_shards)]
    pool = []
    for s, shard in slot_map.items():
        if shard < n_shards:
            load[shard] += weight.get(s, 0)
            own[shard].add(s)
        else:
            pool.append(s)
    large_first = lambda slots: sorted(slots, key=lambda x: (-weight.get(x, 0), x))
    for shard in range(n_shards):
        for s in large_first(own[shard]):
            w = weight.get(s, 0)
            if w and load[shard] - w >= mean:
                load[shard] -= w
                own[shard].discard(s)
                pool.append(s)
    heap = [(x, i) for i, x in enumerate(load)]
    heapq.heapify(heap)
    for s in large_first(pool):
        total, shard = heapq.heappop(heap)
        own[shard].add(s)
        load[shard] = total + weight.get(s, 0)
        heapq.heappush(heap, (load[shard], shard))
    for _ in slot_map:
        high, low = load.index(max(load)), load.index(min(load))
        gap = load[high] - load[low]
        fits = [s for s in own[high] if 0 < weight.get(s, 0) < gap]
        if not fits:
            break
        s = min(fits, key=lambda x: (abs(2 * weight[x] - gap), x))
        own[high].discard(s)
        own[low].add(s)
        load[high] -= weight[s]
        load[low] += weight[s]
    return {s: shard for shard, slots in enumerate(own) for s in slots}


def write_map(spark: SparkSession, path: str, version: int, slot_map: dict[int, int]) -> None:
    spark.createDataFrame(sorted(slot_map.items()), MAP).coalesce(1).write.parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP).parquet(f"{path}/version={version}")


def place(records: DataFrame, slot_map: DataFrame, totals: DataFrame) -> DataFrame:
    """Shard of each record and its position there (gapless from 0). Positions
    are counted inside each virtual slot and shifted by the records of the
    slots before it, so no task sees a whole shard."""
    before = W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1)
    slots = (slot_map.join(totals, "virtual_slot", "left")
                     .withColumn("before", F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(before), F.lit(0)))
                     .select("virtual_slot", "shard", "before"))
    inside = W.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    numbered = records.withColumn("inside", F.row_number().over(inside) - 1)
    return (numbered.join(F.broadcast(slots), "virtual_slot")      # one row per slot: n_slots rows
                    .withColumn("slot", (F.col("before") + F.col("inside")).cast("long")))


def shard(docs: DataFrame, n_shards: int = 8, n_slots: int = N_SLOTS, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, virtual_slot, map_version.

    Version 1 of the map deals the slots evenly; version 2 is its edit for the
    bytes found. Both are stored below ``path``."""
    spark = docs.sparkSession
    prepare(spark)
    path = path or work_path(spark, "slot-map")
    records = with_slots(docs, n_slots)
    totals = stored(records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "slot-bytes")
    weight = {r.virtual_slot: r.bytes for r in totals.select("virtual_slot", "bytes").collect()}  # n_slots rows at most
    first = even_map(n_shards, n_slots)
    write_map(spark, path, 1, first)
    write_map(spark, path, 2, rebalance(first, weight, n_shards))
    placed = place(records, read_map(spark, path, 2), totals)
    return placed.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", "virtual_slot",
                         F.lit(2).alias("map_version"))
