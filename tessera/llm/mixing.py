"""Mixing sources to target weights by systematic sampling: DataFrame functions only.

Every document of a source is expected e = target / source size times. Documents stand in a fixed order; the running sum of e,
plus one random offset of the source, crosses some integers within each document, and the document is emitted once for each.
The order goes by size class first, so taken words stay within a few documents' sizes of the target.

Defined cases: a null text has size 0; documents of size 0 are kept with what they get, which takes no words; a null source is
a source of its own, last in order; a source or table without words has target 0 and takes nothing; ties and repeated doc_ids
are ordered by hash, then size; a very long text is one document of its size, taken whole or not at all; an empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.columns import cut

#: Buckets of each source and size class, so that a source with a third of all rows is numbered by many tasks.
SALT = 32
WEIGHTS = (3, 1, 2)


def words_in(text: Column) -> Column:
    """Number of runs of characters other than space, tab and line breaks; each run follows a separator or the start."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.regexp_count(flat, F.lit("[^ ]+")).cast("long")


def allotted(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """Targets of sources: in proportion to weights, none above limit times its size, the excess reshared by weight.

    The fixed point is target = min(limit * size, level * weight): sources reach their limit in order of limit * size / weight.
    One row per source; the windows run over that table alone.
    """
    everything = Window.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    t = ranked.withColumn("weight", w).withColumn("cap", F.col("source_size") * limit).withColumn("all_size", F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    t = t.withColumn("level_here", (F.col("all_size") * share - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before")))
    free = F.when(F.col("level_here") * F.col("weight") < F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("level_here").alias("level")))
    t = t.withColumn("level", F.min(free).over(everything)["level"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return t.select("source", "source_size", "source_docs", target.cast("double").alias("target"))


def hashed(value: Column, digits: int = 8) -> Column:
    """An integer from md5, which any engine can recompute."""
    return F.conv(F.substring(F.md5(F.encode(F.coalesce(value.cast("string"), F.lit("\x00null")), "UTF-8")), 1, digits), 16, 10).cast("long")


def _placed(docs: DataFrame, *carried: Column) -> DataFrame:
    """doc_id, source, size, the carried columns, and each document's place in the order: hash, size class, bucket."""
    d = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), words_in(F.col("text").cast("string")).alias("size"), *carried)
    h = hashed(F.col("doc_id"))
    return d.withColumn("_h", h).withColumn("_class", F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")) * 4)).otherwise(-1).cast("long")).withColumn("_bucket", F.col("_h") % SALT)


def _with_copies(counted: DataFrame, rows: DataFrame, seed: str, weights: tuple[int, ...], share: float, limit: float) -> DataFrame:
    """rows with source_size, target and copies. Rows are numbered in three steps: rows per (source, size class, bucket) of counted,
    where each bucket starts, and a row number within the bucket; the last shares its partitioning with the join."""
    key = ["source", "_class", "_bucket"]
    buckets = counted.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"), F.sum("size").alias("_size"))
    sources = allotted(buckets.groupBy("source").agg(F.sum("_size").alias("source_size"), F.sum("_rows").alias("source_docs")), weights, share, limit).alias("s")
    before = Window.partitionBy("source").orderBy("_class", "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0))).alias("b")
    starts = starts.join(sources, F.col("b.source").eqNullSafe(F.col("s.source"))).select(*(F.col(f"b.{k}").alias(k) for k in key), "_start", F.col("s.source_size").alias("source_size"), "target")
    n = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("_h", "size", "doc_id"))).alias("d")
    same = F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d._class") == F.col("b._class")) & (F.col("d._bucket") == F.col("b._bucket"))
    e = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(limit)))).otherwise(0.0)
    u = hashed(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("d.source"), F.lit("\x00null"))), 6) / F.lit(float(16**6))
    place = F.col("_start") + F.col("_n")
    copies = F.least(F.floor(place * e + u) - F.floor((place - 1) * e + u), F.ceil(e)).cast("long")
    return n.join(starts.alias("b"), same).select("d.*", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, seed: str = "mix-1", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, for each document."""
    d = cut(_placed(docs), "sizes")  # words are counted once; what is kept has no texts
    m = _with_copies(d, d, seed, weights, share, limit)
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, seed: str = "mix-1", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """The rows of docs, each as often as it is taken; words are counted and texts shuffled once. Documents without words are never
    taken."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    d = cut(_placed(docs, row), "placed")
    m = _with_copies(d.drop("_row"), d, seed, weights, share, limit)
    taken = m.filter((F.col("copies") > 0) & (F.col("size") > 0))
    return taken.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_row.*")
