"""Versioned tables: merges, closings, deletions and backfills, each as one plan that rewrites what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def versioned_upsert(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the next state. current: keys, content_hash, version, is_current, synced_at; incoming: keys, content_hash, synced_at.

    An unchanged item is touched; a changed one closes its row and adds the next version, which names what it supersedes; a new one
    starts at 1. Hashes are of what is stored, and only current rows are compared, so a return to an older content is a change.
    """
    now = current.filter("is_current").select(*keys, F.col("content_hash").alias("_hash"), F.col("version").alias("_version"))
    old = current.join(incoming.select(*keys, F.col("content_hash").alias("_new"), F.col("synced_at").alias("_at")), keys, "left")
    same = F.col("is_current") & (F.col("content_hash") == F.col("_new"))
    changed = F.col("is_current") & (F.col("content_hash") != F.col("_new"))
    kept = old.select(
        *keys, "content_hash", "version", (F.col("is_current") & ~F.coalesce(changed, F.lit(False))).alias("is_current"),
        F.when(F.coalesce(same, F.lit(False)), F.col("_at")).otherwise(F.col("synced_at")).alias("synced_at"), "supersedes",
    )
    added = incoming.join(now, keys, "left").filter(F.col("_hash").isNull() | (F.col("_hash") != F.col("content_hash"))).select(
        *keys, "content_hash", (F.coalesce("_version", F.lit(0)) + 1).alias("version"), F.lit(True).alias("is_current"), "synced_at", F.col("_version").alias("supersedes"),
    )
    return kept.unionByName(added)


def difference(stored: DataFrame, tree: DataFrame, key: str, digest: str) -> DataFrame:
    """key and state of each file: new, changed, unchanged or deleted."""
    s, t = stored.select(key, F.col(digest).alias("_s")), tree.select(key, F.col(digest).alias("_t"))
    state = F.when(F.col("_s").isNull(), "new").when(F.col("_t").isNull(), "deleted").when(F.col("_s") == F.col("_t"), "unchanged").otherwise("changed")
    return s.join(t, key, "full_outer").select(key, state.alias("state"))


def updated(table: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The table with columns replaced where updates name a key."""
    u = updates.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    j = table.join(u, key, "left")
    return j.select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns))


def replaced(table: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Delete and insert: rows of incoming keys go, incoming rows come."""
    return table.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming)
