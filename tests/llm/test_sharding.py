"""Virtual slots: sizes, positions, versions and moves of the map."""
import zlib

from conftest import SF_SMALL
from quarry.llm import sharding


def test_shards_are_near_equal_and_gapless(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = sharding.shard(docs, 4).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    load = {}
    for r in rows:
        assert (r.size, r.text_crc32, r.law) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]), "bytes")
        load.setdefault(r.shard, []).append(r)
    sizes = [sum(r.size for r in own) for own in load.values()]
    assert len(rows) == len(texts) and sorted(load) == [0, 1, 2, 3]
    assert max(sizes) - min(sizes) <= 2 * max(len(t) for t in texts.values())
    for own in load.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))


def test_nulls_repeats_empty_and_clashing_names(spark, tmp_dir):
    rows = [(1, None, 0), (1, None, 1), (None, "é", 2), (None, "x", 3), (2, "", 4), (2, "", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = sharding.shard(df, 2, 16, f"file://{tmp_dir}/maps").collect()
    assert sorted((r.size, r.text_crc32) for r in got) == sorted([(1, 0)] * 4 + [(3, zlib.crc32("é".encode())), (2, zlib.crc32(b"x"))])
    assert len({(r.shard, r.slot) for r in got}) == 6
    assert sharding.shard(spark.createDataFrame([], df.schema), 2, 16).collect() == []
    first, second = (sharding.read_map(spark, f"file://{tmp_dir}/maps", v) for v in (1, 2))
    assert first.count() == second.count() == 16


def test_rebalancing_moves_whole_slots_and_evens_out():
    weight = {s: 1 + (s * 7919) % 97 for s in range(512)} | {5: 900}
    old = sharding.even_map(4, 512)
    new = sharding.rebalance(old, weight, 5)
    load = [sum(weight[s] for s in new if new[s] == k) for k in range(5)]
    assert max(load) - min(load) <= 10
    assert sum(old[s] != new[s] for s in old) < 512 * 0.3          # about a fifth has to move
    fewer = sharding.rebalance(new, weight, 3)
    assert set(fewer.values()) == {0, 1, 2} and sorted(fewer) == sorted(old)
    assert sharding.rebalance(old, {}, 4) == old or set(sharding.rebalance(old, {}, 4)) == set(old)
