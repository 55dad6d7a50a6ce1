"""Sharding by fixed virtual slots: DataFrame functions only.

Records hash into a fixed number of virtual slots, bytes are summed per slot, and a versioned map deals the slots to shards.
Rebalancing edits the map, never the hash, so only the rows of moved slots move.

Defined cases: a null text has size 1 (no bytes, plus 1) and crc32 0; a record's slot goes by its doc_id and its text's crc32, so
that null and repeated doc_ids spread; rows that repeat both fall into one slot; ties are broken by slot number; an empty table gives
an empty result and a map without slots; a very long text counts with all its bytes and makes its slot heavy; extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.columns import cut, exists, narrow

#: Virtual slots: far more than shards, so that whole slots balance to a small part of a shard; the map stays this long for any input.
SLOTS = 4096


def slot_of(*key: Column, slots: int = SLOTS) -> Column:
    """Fixed virtual slot of a record."""
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


def measured(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot; the text itself goes no further than the scan."""
    d = narrow(docs, "doc_id", "text")
    body = F.coalesce(F.col("text"), F.lit(""))
    d = d.select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"))
    return d.withColumn("virtual_slot", slot_of(F.col("doc_id"), F.col("text_crc32"), slots=slots))


def slot_bytes(records: DataFrame) -> DataFrame:
    """Bytes and rows of each virtual slot; partial sums are made before the shuffle."""
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def slot_map(loads: DataFrame, shards: int, version: int = 1) -> DataFrame:
    """Deals slots to shards by bytes, heaviest slot first, each to the lightest shard so far: version, virtual_slot, shard.

    One fold over an array of at most SLOTS entries, whatever the size of the input.
    """
    heaviest = F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("minus"), F.col("virtual_slot").alias("slot"))))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("load"), F.array().cast("array<int>").alias("dealt"))

    def deal(acc: Column, x: Column) -> Column:
        to = F.array_position(acc["load"], F.array_min(acc["load"])).cast("int") - 1
        return F.struct(
            F.transform(acc["load"], lambda v, i: F.when(i == to, v - x["minus"]).otherwise(v)).alias("load"),
            F.concat(acc["dealt"], F.array(to)).alias("dealt"),
        )

    one = loads.agg(heaviest.alias("slots"))
    dealt = one.select("slots", F.aggregate("slots", start, deal, lambda acc: acc["dealt"]).alias("dealt"))
    pairs = dealt.select(F.explode(F.arrays_zip(F.col("slots.slot").alias("slot"), F.col("dealt").alias("shard"))).alias("p"))
    return pairs.select(F.lit(version).alias("version"), F.col("p.slot").alias("virtual_slot"), F.col("p.shard").alias("shard"))


def rebalanced(current: DataFrame, loads: DataFrame, shards: int, tolerance: float = 0.02) -> DataFrame:
    """The next version of a map: slots leave shards above (1 + tolerance) times the mean, lightest slots first, for the lightest
    shards; slots never seen before go there too. All other slots keep their shard, so only moved slots move rows.
    """
    known = loads.join(current, "virtual_slot", "full").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    per = Window.partitionBy("shard").orderBy("bytes", "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    mean = loads.agg((F.sum("bytes") / shards).alias("mean"))
    sized = known.withColumn("above", F.sum("bytes").over(Window.partitionBy("shard"))).join(F.broadcast(mean))
    marked = sized.withColumn("moves", F.col("shard").isNull() | (F.col("shard") >= shards) | (F.sum("bytes").over(per) <= F.col("above") - F.col("mean") * (1 + tolerance)))
    kept = marked.filter(~F.col("moves")).groupBy("shard").agg(F.sum("bytes").alias("load"))
    loads_now = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.coalesce(F.element_at(F.col("kept"), i), F.lit(0)).cast("long"))
    start = kept.agg(F.map_from_entries(F.collect_list(F.struct(F.col("shard").cast("int"), F.col("load")))).alias("kept"))
    movers = marked.filter("moves").agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("minus"), F.col("virtual_slot").alias("slot")))).alias("slots"))

    def deal(acc: Column, x: Column) -> Column:
        to = F.array_position(acc["load"], F.array_min(acc["load"])).cast("int") - 1
        return F.struct(F.transform(acc["load"], lambda v, i: F.when(i == to, v - x["minus"]).otherwise(v)).alias("load"), F.concat(acc["dealt"], F.array(to)).alias("dealt"))

    folded = movers.join(F.broadcast(start)).select("slots", F.aggregate("slots", F.struct(loads_now.alias("load"), F.array().cast("array<int>").alias("dealt")), deal, lambda acc: acc["dealt"]).alias("dealt"))
    moved = folded.select(F.explode(F.arrays_zip(F.col("slots.slot").alias("slot"), F.col("dealt").alias("shard"))).alias("p")).select(F.col("p.slot").alias("virtual_slot"), F.col("p.shard").alias("shard"))
    stay = marked.filter(~F.col("moves")).select("virtual_slot", F.col("shard").cast("int").alias("shard"))
    version = current.agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version"))
    return stay.unionByName(moved).join(F.broadcast(version)).select("version", "virtual_slot", "shard")


def save_map(mapping: DataFrame, path: str) -> None:
    """Appends a version of the map to its table, a folder for each version."""
    mapping.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark, path: str, version: int | None = None) -> DataFrame:
    """A version of the map, the latest by default."""
    table = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
    if version is not None:
        return table.filter(F.col("version") == version)
    return table.join(F.broadcast(table.agg(F.max("version").alias("version"))), "version")


def mapped(docs: DataFrame, path: str, shards: int = 8, slots: int = SLOTS) -> DataFrame:
    """As shard(), by the map whose table is at path. Without a table the first version is dealt and stored; with one, the latest
    version is edited for the loads of docs and stored as the next."""
    spark, records = docs.sparkSession, cut(measured(docs, slots), "sharding-records")  # the texts are read once
    loads = slot_bytes(records)
    save_map(rebalanced(load_map(spark, path), loads, shards) if exists(spark, path) else slot_map(loads, shards), path)
    return shard(docs, shards, slots, load_map(spark, path), records)


def shard(docs: DataFrame, shards: int = 8, slots: int = SLOTS, mapping: DataFrame | None = None, records: DataFrame | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (place in the shard, gapless from 0), grown_shard (null: sizes decide), virtual_slot.

    Places come from rows counted per virtual slot and a row number within each, so no task holds a whole shard. records: what
    measured() gives for docs, where it is at hand.
    """
    records = measured(docs, slots) if records is None else records
    loads = slot_bytes(records)
    mapping = slot_map(loads, shards) if mapping is None else mapping
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    dealt = loads.join(F.broadcast(mapping), "virtual_slot").select("virtual_slot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    numbered = records.withColumn("in_slot", F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")))
    return numbered.join(F.broadcast(dealt), "virtual_slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("offset") + F.col("in_slot") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )
