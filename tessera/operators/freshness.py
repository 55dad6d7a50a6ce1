"""How current memories about files are, from the history of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Changes since a memory was stored, and what a tier's score is multiplied by.
AGING, STALE, EXPIRED = 3, 10, 25
PENALTY = {"fresh": 1.0, "aging": 0.9, "stale": 0.0, "expired": 0.0, "unverified": 1.0, "unknown": 0.8}


def changes_since(memories: DataFrame, commits: DataFrame) -> DataFrame:
    """memories with commit_count: current changes to their file, strictly after they were stored.

    Changes are exploded to (file, time) and counted; with the memories of the file between them in order of time, a running sum gives
    each its count, so a file costs its changes plus its memories, never their product. The sum runs within a day of a file, on top of
    the sums of its later days, so a file that most changes touch is not one task's work.
    """
    touched = commits.filter("is_current").select(F.explode(F.array_distinct("files_changed")).alias("file_path"), F.col("committed_at").alias("at")).groupBy("file_path", "at").agg(F.count(F.lit(1)).alias("n"))
    line = touched.select("file_path", "at", "n", F.lit(None).cast("string").alias("point_id")).unionByName(memories.select("file_path", F.col("stored_at").alias("at"), F.lit(0).cast("long").alias("n"), F.col("point_id").cast("string")))
    line = line.withColumn("_day", F.floor(F.unix_seconds(F.col("at")) / 86_400))
    days = Window.partitionBy("file_path").orderBy(F.col("_day").desc()).rowsBetween(Window.unboundedPreceding, -1)
    after = touched.groupBy("file_path", F.floor(F.unix_seconds(F.col("at")) / 86_400).alias("_day")).agg(F.sum("n").alias("_own"))
    seen = line.select("file_path", "_day").distinct().join(after, ["file_path", "_day"], "left").withColumn("_later", F.coalesce(F.sum("_own").over(days), F.lit(0))).drop("_own")
    later = Window.partitionBy("file_path", "_day").orderBy(F.col("at").desc(), F.col("point_id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)  # at one moment the memory stands before the change
    count = line.join(seen, ["file_path", "_day"]).withColumn("commit_count", F.sum("n").over(later) + F.col("_later")).filter("point_id IS NOT NULL").select("point_id", "commit_count")
    return memories.join(count, "point_id", "left").withColumn("commit_count", F.coalesce("commit_count", F.lit(0)))


def tier(known: Column, matches: Column, count: Column) -> Column:
    """Tier: unknown without ground truth, expired where hashes differ (null: not compared), else by count."""
    return (
        F.when(~known, "unknown").when(F.coalesce(~matches, F.lit(False)), "expired").when(count >= EXPIRED, "expired").when(count >= STALE, "stale").when(count >= AGING, "aging").otherwise("fresh")
    )


def reason(known: Column, matches: Column, count: Column) -> Column:
    n = count.cast("string")
    return (
        F.when(~known, "no ground truth").when(F.coalesce(~matches, F.lit(False)), "content changed")
        .when(count >= AGING, F.concat(n, F.lit(" changes since stored"))).otherwise(F.concat(n, F.lit(" changes, below the limit")))
    )


def scanned(memories: DataFrame, blobs: DataFrame, commits: DataFrame) -> DataFrame:
    """point_id, collection, tier, reason of memories (file_path, blob_hash, stored_at): ground truth is whether their file is among
    the current blobs (file_path, blob_hash), and whether its hash is still the one that they were stored with; a memory that was
    stored without a hash is judged by the changes alone."""
    now = blobs.groupBy("file_path").agg(F.max("blob_hash").alias("_now"))
    m = changes_since(memories, commits).join(now, "file_path", "left")
    known, same, n = F.col("_now").isNotNull(), F.col("blob_hash") == F.col("_now"), F.col("commit_count")
    return m.select("point_id", "collection", tier(known, same, n).alias("tier"), reason(known, same, n).alias("reason"))


def penalty(status: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in PENALTY.items() for x in kv)), F.coalesce(status, F.lit("unverified"))), F.lit(PENALTY["unknown"]))


def penalised(found: DataFrame) -> DataFrame:
    """Scores of code patterns times their tier's penalty; other collections keep theirs."""
    return found.withColumn("score", F.when(F.col("collection") == "code-patterns", F.col("score") * penalty(F.col("freshness_status"))).otherwise(F.col("score")))
