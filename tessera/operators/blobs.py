"""Code files kept as versions of chunks: one plan tells what happens to every file, and applies it to its chunks.

A file whose hash is as stored is touched: its chunks are seen again, nothing is cut. A file that differs is superseded: its current
chunks stop being current and the chunks of the new text come in under the next version. A new file's chunks are inserted; a file that
is gone is closed. Texts of unchanged files are never cut into chunks.

Defined cases: a path that comes twice in the tree is an error of the tree and keeps its greatest hash; files that were closed and come
back are inserted again under the next version; an empty tree closes everything; an empty store inserts everything; a file whose text
gives no chunks is superseded or closed like any other and has no rows of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: file_path, blob_hash, version, chunk_index, total_chunks, content, is_current, synced_at
STATE = "file_path string, blob_hash string, version int, chunk_index int, total_chunks int, content string, is_current boolean, synced_at long"


def actions(state: DataFrame, tree: DataFrame) -> DataFrame:
    """file_path, action (touch, supersede, insert, close), version (the next one; as it is where touched or closed), blob_hash (of the
    tree). The stored side is one row for each file."""
    stored = state.groupBy("file_path").agg(F.max("version").alias("_version"), F.max(F.when(F.col("is_current"), F.col("blob_hash"))).alias("_hash"))
    now = tree.groupBy("file_path").agg(F.max("blob_hash").alias("blob_hash"))
    both = stored.join(now, "file_path", "full")
    action = (
        F.when(F.col("blob_hash").isNull() & F.col("_hash").isNull(), None).when(F.col("blob_hash").isNull(), "close").when(F.col("_hash").isNull(), "insert")
        .when(F.col("_hash") == F.col("blob_hash"), "touch").otherwise("supersede")
    )
    known = F.coalesce("_version", F.lit(0))
    version = F.when(action.isin("insert", "supersede"), known + 1).otherwise(known)
    return both.select("file_path", action.alias("action"), version.cast("int").alias("version"), "blob_hash").filter("action IS NOT NULL")


def merged(state: DataFrame, tree: DataFrame, chunks: Column, at: Column) -> DataFrame:
    """The store after a sync at a time. tree: file_path, blob_hash, content; chunks: an array of the chunks of a content."""
    todo = actions(state, tree)
    what = todo.select("file_path", "action")
    gone = F.col("is_current") & F.coalesce(F.col("action").isin("supersede", "close"), F.lit(False))
    seen = F.col("is_current") & F.coalesce(F.col("action") == "touch", F.lit(False))
    kept = state.join(what, "file_path", "left").withColumn("is_current", F.col("is_current") & ~gone).withColumn("synced_at", F.when(seen, at).otherwise(F.col("synced_at"))).drop("action")
    new = tree.join(todo.filter(F.col("action").isin("insert", "supersede")).drop("action"), ["file_path", "blob_hash"])
    cut = new.withColumn("_chunks", chunks).select("file_path", "blob_hash", "version", F.size("_chunks").alias("total_chunks"), F.posexplode("_chunks").alias("chunk_index", "content"))
    rows = cut.select("file_path", "blob_hash", "version", "chunk_index", "total_chunks", "content", F.lit(True).alias("is_current"), at.alias("synced_at"))
    return kept.select(*rows.columns).unionByName(rows)


def summary(state: DataFrame, tree: DataFrame) -> DataFrame:
    """Files of each action."""
    return actions(state, tree).groupBy("action").agg(F.count(F.lit(1)).alias("files"))
