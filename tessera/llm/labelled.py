"""Labelled rows for training: a bounded sample, the same on every run, with the fold of held-out rows left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.columns import narrow

#: Labelled documents that a classifier is fitted on at most. This bounds what is sent to the driver.
MOST = 4000
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the doc_id as text leaves 0 modulo 5. A null doc_id is not held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS == 0, F.lit(False))


def chosen(docs: DataFrame, labels: DataFrame, label: str, most: int = MOST) -> DataFrame:
    """doc_id, whole text, label of the labelled rows with the least hashes; rows without label or doc_id are passed over. A doc_id
    with several texts is taken with the one of the least hash, so there are no more rows than doc_ids."""
    known = narrow(labels, "doc_id", label).filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    least = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    d = narrow(docs, "doc_id", "text").join(F.broadcast(least), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label")
    return d.withColumn("_h", F.xxhash64("text")).withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("_h", "text"))).filter("_n = 1").select("doc_id", "text", "label")


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int = MOST) -> list[tuple[str, int]]:
    """(whole text, label) of the chosen rows."""
    return [(r.text, r.label) for r in sorted(chosen(docs, labels, label, most).collect(), key=lambda r: r.doc_id)]
