"""Duplicate detection: by hash within a tenant, by vector within a block, by text within a time window."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import content_hash
from tessera.operators import pairs, search, similar
from tessera.sources.shared import cut

#: Rows of a block that are compared at once with as many others.
PART = 8192
LEAST_LENGTH = 10
SIMILAR = 0.95


def first_of_each(rows: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """The first row of each group."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def hash_matches(incoming: DataFrame, stored: DataFrame, tenant: bool = True) -> DataFrame:
    """Incoming rows whose content is stored, in the same tenant by default: point_id, existing_id (the least)."""
    keys = ["content_hash", *(["group_id"] if tenant else [])]
    known = stored.withColumn("content_hash", content_hash(F.col("content"))).groupBy(*keys).agg(F.min("point_id").alias("existing_id"))
    return incoming.withColumn("content_hash", content_hash(F.col("content"))).join(known, keys).select("point_id", "existing_id")


def nearest(incoming: DataFrame, stored: DataFrame, block: list[str], least: float = SIMILAR) -> DataFrame:
    """For each incoming row the most similar stored row of its block, if similar enough: point_id, existing_id, similarity.

    Exact, and so a product within each block: also to measure similar.near() by. Rows of a block are dealt into parts of about PART;
    every two parts are one matrix product, so a task holds two parts, and hands on at most one row for each incoming one.
    """
    have = F.col("embedding").isNotNull() & F.col("point_id").isNotNull()
    i, s = (d.filter(have).select(*block, "point_id", "embedding") for d in (incoming, stored))
    parts = lambda d, name: d.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias(name))
    sizes = parts(i, "_i").join(parts(s, "_s"), block)
    own = lambda n: F.pmod(F.xxhash64("point_id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # named anew, as both sides may come from one table
    named = [F.col(c).alias(c) for c in (*block, "point_id", "embedding")]
    left = i.join(sizes, block).select(*named, own("_i").alias("_i"), each("_s").alias("_s"))
    right = s.join(sizes, block).select(*named, each("_i").alias("_i"), own("_s").alias("_s"))
    keys = [*block, "_i", "_s"]

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        return pairs.most_similar(a, b, least)

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, f"point_id {dict(i.dtypes)['point_id']}, existing_id {dict(s.dtypes)['point_id']}, similarity double")
    best = F.max(F.struct("similarity", "existing_id"))
    return found.groupBy("point_id").agg(best.alias("b")).select("point_id", F.col("b.existing_id").alias("existing_id"), F.col("b.similarity").alias("similarity"))


def checked(incoming: DataFrame, stored: DataFrame, block: list[str], near: Callable[[DataFrame, DataFrame, list[str], float], DataFrame] = similar.near) -> DataFrame:
    """point_id, is_duplicate, reason, existing_id: guards, then hashes, then vectors; only what is left reaches the next test.

    Rows are marked in one pass: a guard and the stored row of equal content stand beside each, which is written once; the vectors of
    the rest are then looked up, and one join tells what each row is. near: how vectors are looked up, nearest() being exact.
    """
    n = F.length("content")
    guard = F.when(F.coalesce(n, F.lit(0)) == 0, "empty_content").when(n < LEAST_LENGTH, "content_too_short")
    keys = ["content_hash", "group_id"]
    known = stored.select("group_id", content_hash(F.col("content")).alias("content_hash"), F.col("point_id").alias("_id")).groupBy(*keys).agg(F.min("_id").alias("_same"))
    marked = incoming.select("point_id", "group_id", *(c for c in block if c != "group_id"), "embedding", guard.alias("_guard"), content_hash(F.col("content")).alias("content_hash"))
    marked = cut(marked.join(known, keys, "left").withColumn("_same", F.when(F.col("_guard").isNull(), F.col("_same"))).drop("content_hash"), "dedup-marked")
    found = near(marked.filter("_guard IS NULL AND _same IS NULL"), stored, block, SIMILAR).select("point_id", F.col("existing_id").alias("_near"))
    reason = F.coalesce("_guard", F.when(F.col("_same").isNotNull(), "hash_match").when(F.col("_near").isNotNull(), "semantic_similarity").otherwise("unique"))
    existing = F.coalesce("_same", "_near")
    return marked.join(found, "point_id", "left").select("point_id", existing.isNotNull().alias("is_duplicate"), reason.alias("reason"), existing.alias("existing_id"))


def across_collections(asked: DataFrame, memories: DataFrame, least: float = 0.85, most: int = 5) -> DataFrame:
    """point_id, same (rows of other collections with equal content), similar (at most so many ids of other collections, nearest
    first, where none is equal), collides (another row with its unique_id), is_duplicate (equal or colliding), for a stated set of rows.

    asked and memories: point_id, collection, unique_id, content, embedding. Vectors are compared in broadcast blocks of asked rows.
    """
    m = memories.withColumn("_h", content_hash(F.col("content")))
    a = asked.withColumn("_h", content_hash(F.col("content")))
    per = m.groupBy("_h", "collection").agg(F.count(F.lit(1)).alias("_n"))
    total = per.groupBy("_h").agg(F.sum("_n").alias("_all"))
    own = per.select("_h", "collection", F.col("_n").alias("_own"))
    same = a.join(total, "_h", "left").join(own, ["_h", "collection"], "left").select("point_id", (F.coalesce("_all", F.lit(0)) - F.coalesce("_own", F.lit(0))).alias("same"))
    ids = m.filter("unique_id IS NOT NULL").groupBy("unique_id").agg(F.count(F.lit(1)).alias("_ids"))
    collides = a.filter("unique_id IS NOT NULL").join(ids, "unique_id").select("point_id", (F.col("_ids") > 1).alias("collides"))
    q = a.select(F.col("point_id").alias("query_id"), "collection", F.col("embedding").alias("query"))
    near = search.nearest(m.select("point_id", "collection", "embedding"), q, most, least, 9, apart="collection").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "point_id"))).alias("_r"))
    near = near.select(F.col("query_id").alias("point_id"), F.transform("_r", lambda x: x["point_id"]).alias("_similar"))
    out = same.join(collides, "point_id", "left").join(near, "point_id", "left")
    similar_ids = F.when(F.col("same") == 0, F.coalesce("_similar", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    hit = F.coalesce("collides", F.lit(False))
    return out.select("point_id", "same", similar_ids.alias("similar"), hit.alias("collides"), ((F.col("same") > 0) | hit).alias("is_duplicate"))


def within_minutes(messages: DataFrame, keys: list[str], at: str, minutes: int = 5) -> DataFrame:
    """Marks messages that repeat an earlier one of equal keys, no more than so many minutes before."""
    before = F.lag(at).over(Window.partitionBy(*keys).orderBy(at))
    return messages.withColumn("is_repeat", F.coalesce(F.unix_micros(F.col(at)) - F.unix_micros(before) <= minutes * 60_000_000, F.lit(False)))
