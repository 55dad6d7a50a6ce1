from __future__ import annotations

import zlib
from collections import Counter

from pyspark.sql import functions as F

from tessera.llm import sharding


def test_rows_sizes_and_places(spark, docs, documents):
    got = sharding.shard(docs.withColumn("size", F.lit("clash")).withColumn("shard", F.lit(3))).collect()
    assert sorted(r.doc_id for r in got) == sorted(d[0] for d in documents)
    body = {d[0]: (d[1] or "").encode() for d in documents}
    assert all(r["size"] == len(body[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(body[r.doc_id]) and r.grown_shard is None for r in got)
    for s in range(8):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))


def test_sizes_near_equal(spark):
    d = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"))
    load = Counter()
    for r in sharding.shard(d).groupBy("shard").agg(F.sum("size").alias("b")).collect():
        load[r.shard] = r.b
    assert len(load) == 8 and max(load.values()) - min(load.values()) <= 0.002 * sum(load.values())


def test_rebalancing_moves_few(spark, tmp_path):
    before = sharding.measured(spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text")), 256)
    first = sharding.slot_map(sharding.slot_bytes(before), 8)
    sharding.save_map(first, str(tmp_path / "map"))
    after = sharding.slot_bytes(before.withColumn("size", F.when(F.col("virtual_slot") < 40, F.col("size") * 5).otherwise(F.col("size"))))
    second = sharding.rebalanced(sharding.load_map(spark, str(tmp_path / "map")), after, 8)
    sharding.save_map(second, str(tmp_path / "map"))
    old = {r.virtual_slot: r.shard for r in sharding.load_map(spark, str(tmp_path / "map"), 1).collect()}
    new = {r.virtual_slot: r.shard for r in sharding.load_map(spark, str(tmp_path / "map")).collect()}
    size = {r.virtual_slot: r.bytes for r in after.collect()}
    assert old.keys() == new.keys() == size.keys()
    load = Counter()
    for k, s in new.items():
        load[s] += size[k]
    assert max(load.values()) <= 1.1 * sum(load.values()) / 8
    assert sum(old[k] != new[k] for k in old) < len(old) / 2


def test_empty_and_null_ids(spark, empty):
    assert sharding.shard(empty).count() == 0
    assert sharding.shard(spark.createDataFrame([(None, "a"), (None, None), (1, "b"), (1, "b")], "doc_id long, text string")).count() == 4


def test_the_stored_map_is_edited(spark, tmp_path, empty):
    path = f"file://{tmp_path}/map"
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    place = lambda df: {r.doc_id: (r.shard, r.virtual_slot) for r in df.collect()}
    first = place(sharding.mapped(d, path))
    assert first == place(sharding.shard(d))
    full = [k for k, (shard, _) in first.items() if shard == 0]
    grown = d.unionByName(d.filter(F.col("doc_id").isin(full)).withColumn("times", F.explode(F.sequence(F.lit(1), F.lit(5)))).drop("times"))
    second = place(sharding.mapped(grown, path))
    assert sorted(r.version for r in sharding.load_map(spark, path).select("version").distinct().collect()) == [2]
    assert place(sharding.shard(d, mapping=sharding.load_map(spark, path, 1))) == first
    moved = {second[k][1] for k in first if first[k][0] != second[k][0]}
    assert 0 < len(moved) < 0.5 * len({v for _, v in first.values()})
    few = sharding.mapped(d.filter("doc_id < 10"), path)  # slots without records keep their shards
    assert few.count() == 10 and sharding.load_map(spark, path).count() >= sharding.load_map(spark, path, 1).count()
    assert sharding.mapped(empty, f"file://{tmp_path}/none").count() == 0
