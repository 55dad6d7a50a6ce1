"""Backfills that can be stopped and taken up again: what is done is a table, and only what it lacks is worked on."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.chunking import column
from tessera.operators.versions import updated


def pending(rows: DataFrame, checkpoint: DataFrame | None, kind: str, key: str) -> DataFrame:
    """Rows beyond the checkpoint (kind, last) of their kind; all of a kind that has none."""
    if checkpoint is None:
        return rows
    c = checkpoint.select(F.col(kind).alias("_kind"), F.col("last").alias("_last"))
    return rows.join(F.broadcast(c), F.col(kind) == F.col("_kind"), "left").filter(F.col("_last").isNull() | (F.col(key) > F.col("_last"))).drop("_kind", "_last")


def reclassified(rows: DataFrame, checkpoint: DataFrame | None, classify: Callable[[Column, Column], Column], most: int | None = None, key: str = "point_id", kinds: tuple[str, ...] = ("user_message", "agent_response")) -> tuple[DataFrame, DataFrame]:
    """Changes (key, type, old_type) among the next rows of those kinds, and the checkpoint (type, last, processed, changed) after
    them. classify(content, type) gives a struct with type. most: rows of this run, in order of the key; the rest is for the next."""
    todo = pending(rows.filter(F.col("type").isin(*kinds)), checkpoint, "type", key)
    todo = todo if most is None else todo.orderBy(key).limit(most)
    done = todo.select(key, F.col("type").alias("old_type"), classify(F.col("content"), F.col("type"))["type"].alias("type"))
    changed = F.col("type") != F.col("old_type")
    state = done.groupBy(F.col("old_type").alias("type")).agg(F.max(key).alias("last"), F.count(F.lit(1)).alias("processed"), F.count_if(changed).alias("changed"))
    if checkpoint is not None:
        both = checkpoint.select("type", "last", "processed", "changed").unionByName(state)
        state = both.groupBy("type").agg(F.max("last").alias("last"), F.sum("processed").alias("processed"), F.sum("changed").alias("changed"))
    return done.filter(changed).select(key, "type", "old_type"), state


def reembedded(rows: DataFrame, embed: Callable[[DataFrame], DataFrame], done: DataFrame | None = None, key: str = "point_id") -> tuple[DataFrame, DataFrame]:
    """Rows with new embeddings, and progress (total, processed, skipped, already): rows without content are skipped, those of done
    are not embedded again."""
    left = rows if done is None else rows.join(done.select(key), key, "left_anti")
    new = embed(left.filter(F.coalesce(F.trim("content"), F.lit("")) != ""))
    total = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce(F.trim("content"), F.lit("")) == "").alias("blank"))
    counts = new.agg(F.count(F.lit(1)).alias("processed"))
    progress = total.crossJoin(F.broadcast(counts)).select("total", "processed", F.col("blank").alias("skipped"), (F.col("total") - F.col("processed") - F.col("blank")).alias("already"))
    return new, progress


def embed_pending(rows: DataFrame, embed: Callable[[DataFrame], DataFrame], key: str = "point_id") -> DataFrame:
    """rows (content, embedding, embedding_status) with what is pending embedded: those get a vector and are complete; rows without
    content stay pending. Only pending rows are embedded."""
    todo = rows.filter((F.col("embedding_status") == "pending") & (F.coalesce(F.trim("content"), F.lit("")) != "")).select(key, "content")
    new = embed(todo).filter("embedding IS NOT NULL").select(key, "embedding", F.lit("complete").alias("embedding_status"))
    return updated(rows, new, key, ["embedding", "embedding_status"])


def embed_by_offset(rows: DataFrame, embed: Callable[[DataFrame], DataFrame], size: int, key: str) -> DataFrame:
    """key, i, content, embedding of every piece of so many characters of each content, in order of place."""
    n = F.ceil(F.length("content") / size)
    at = F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    pieces = rows.filter(n > 0).select(key, at.alias("i"), "content").select(key, "i", F.substr("content", (F.col("i") * size + 1).cast("int"), F.lit(size)).alias("content"))
    return embed(pieces)


def purged(memories: DataFrame, collections: list[str], group_id: str | None, cutoff: Column) -> DataFrame:
    """What a purge leaves: all but what was stored before the cutoff in some collections, of one tenant or of all. Rows without a
    time stay."""
    old = F.col("collection").isin(*collections) & (F.col("stored_at") < cutoff)
    return memories.filter(~F.coalesce(old if group_id is None else old & (F.col("group_id") == group_id), F.lit(False)))


ENTRY = ("content", "group_id", "memory_type")


def entry(line: str) -> dict[str, str]:
    """line and state of one line of a queue."""
    for text, state in ((line, "valid"), (line + "}", "recovered")):
        try:
            value = json.loads(text)
        except ValueError:
            if not (line.startswith("{") and not line.endswith("}")):
                break
            continue
        if isinstance(value, dict) and all(f in value for f in ENTRY):
            return {"line": text, "state": state}
        if state == "valid":
            return {"line": line, "state": "incomplete"}
    return {"line": line, "state": "broken"}


def repaired(lines: DataFrame) -> DataFrame:
    """line, state of the lines of a queue: valid (all fields are there), recovered (valid once its closing brace is put back; line
    is then whole), incomplete or broken. Blank lines are left out."""
    raw = lines.select(F.trim("value").alias("value")).filter("value <> ''")
    state = column(lambda t: entry(t)["state"], "string", F.col("value"))
    return raw.withColumn("state", state).select(F.when(F.col("state") == "recovered", F.concat("value", F.lit("}"))).otherwise(F.col("value")).alias("line"), "state")


def written_back(rows: DataFrame, changes: DataFrame, key: str = "point_id") -> DataFrame:
    """rows with the types of the changes."""
    return updated(rows, changes.select(key, "type"), key, ["type"])
