"""Near-duplicate vectors without comparing all with all: signatures of random hyperplanes, in tables of bands, probed and verified.

Two vectors at an angle fall on the same side of a random plane with a chance that depends on the angle alone. A band of so many
planes is a bucket; there are as many bands as a target recall takes at the least similarity. An incoming vector also looks into the
buckets that differ in one of its least certain planes. What meets in a bucket is verified exactly.

Vectors are compared as distinct ones, so very many copies of one cost one comparison. A bucket of more than MOST stored vectors is
dealt into parts, each of which the incoming ones visit, so no task holds a whole bucket however many rows a tenant or a cluster has.

Defined cases: null vectors and those of length zero are near to nothing; a row is never near to itself (its own point_id); of stored
rows with equal vectors one is named.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import vector

#: Stored vectors of one part of a bucket, the vectors that a bucket is meant to hold, and the fewest and most planes of a band.
MOST, MEANT = 2000, 64
FEWEST, MANY = 6, 24


def agreement(similarity: float) -> float:
    """The chance that a random plane does not part two vectors of a cosine."""
    return 1 - math.acos(max(-1.0, min(1.0, similarity))) / math.pi


@dataclass(frozen=True)
class Planes:
    """Normals of all planes, band by band; how many make a band, and how many of them are also tried the other way."""

    normals: np.ndarray
    bits: int
    probes: int

    @property
    def bands(self) -> int:
        return len(self.normals) // self.bits

    def buckets(self, x: np.ndarray, probed: bool) -> np.ndarray:
        """The bucket of each row in each band, and where probed those that differ in one of the least certain planes."""
        side = x @ self.normals.T
        n = len(x)
        side = side.reshape(n, self.bands, self.bits)
        code = ((side > 0) << np.arange(self.bits)).sum(2)
        out = [code]
        if probed:
            weak = np.argsort(np.abs(side), axis=2)[:, :, : self.probes]
            out += [code ^ (1 << weak[:, :, k]) for k in range(weak.shape[2])]
        first = np.arange(self.bands, dtype=np.int64) << self.bits
        return np.concatenate([first + c for c in out], axis=1)


def planes(dimensions: int, rows: int, least: float, recall: float = 0.995, probes: int = 3, seed: int = 17) -> Planes:
    """As many planes a band as spread the rows over buckets of the meant size, and as many bands as reach the recall at the least
    similarity: a band finds a pair that no plane parts, or that one plane parts which is among the probed ones (taken as no likelier
    than the others, though the least certain planes are)."""
    bits = max(FEWEST, min(MANY, round(math.log2(max(1, rows) / MEANT))))
    p, probes = agreement(least), min(probes, bits)
    found = p**bits + probes * p ** (bits - 1) * (1 - p)
    bands = 1 if found >= recall else math.ceil(math.log(1 - recall) / math.log(1 - found))
    return Planes(np.random.default_rng(seed).standard_normal((bands * bits, dimensions)).astype(np.float32), bits, probes)


def _signed(embedding: Column, held, probed: bool) -> Column:
    def buckets(column: pd.Series) -> pd.Series:
        if not len(column):
            return pd.Series([], dtype=object)
        return pd.Series(list(held.value.buckets(np.stack([np.asarray(v, np.float32) for v in column]), probed)))

    buckets.__annotations__ = {"column": pd.Series, "return": pd.Series}
    return F.pandas_udf(buckets, "array<long>")(embedding)


def near(incoming: DataFrame, stored: DataFrame, block: list[str], least: float, differs: list[str] | None = None, recall: float = 0.995) -> DataFrame:
    """point_id, existing_id, similarity: for each incoming row the most similar stored row of its block that is similar enough, as far
    as the bands find it. differs: columns in which the two must differ."""
    differs = differs or []
    spark, keys = stored.sparkSession, [*block, *differs]
    have = F.col("embedding").isNotNull() & (vector.norm(F.col("embedding")) > 0)
    s = stored.filter(have).groupBy(*keys, "embedding").agg(F.max("point_id").alias("_last"), F.min("point_id").alias("_first"))
    i = incoming.filter(have).select(*keys, "embedding").distinct()
    size = stored.filter(have).agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    held = spark.sparkContext.broadcast(planes(size[1] or 1, size[0], least, recall))
    named = {c: f"_{c}" for c in differs}
    sides = s.withColumns({"_bucket": F.explode(_signed(F.col("embedding"), held, False)), "_n": vector.square(F.col("embedding"))}).withColumnsRenamed({"embedding": "_e", **named})
    asked = i.withColumns({"_asked": F.xxhash64(*keys, "embedding"), "_bucket": F.explode(_signed(F.col("embedding"), held, True)), "_m": vector.square(F.col("embedding"))})
    # buckets beyond the size are few: each holds many rows
    large = sides.groupBy(*block, "_bucket").agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > MOST).select(*block, "_bucket", F.ceil(F.col("_size") / MOST).cast("int").alias("_parts"))
    at = [*block, "_bucket"]
    parts = F.coalesce("_parts", F.lit(1))
    sides = sides.join(large, at, "left").withColumn("_part", F.pmod(F.xxhash64("_last"), parts).cast("int")).drop("_parts")
    asked = asked.join(large, at, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    sim = vector.cosine(F.col("embedding"), F.col("_e"), F.col("_m"), F.col("_n"))
    pairs = asked.join(sides, [*at, "_part"]).withColumn("similarity", sim).filter(F.col("similarity") >= least)
    for c, other in named.items():
        pairs = pairs.filter(F.col(c) != F.col(other))
    # the same two may meet in several bands; a row's own vector may be the nearest one, so the next is kept beside it
    once = pairs.groupBy("_asked", "_last", "_first").agg(F.max("similarity").alias("similarity"))
    w = Window.partitionBy("_asked").orderBy(F.col("similarity").desc(), F.col("_last").desc())
    best = once.withColumn("_r", F.row_number().over(w)).filter("_r <= 2")
    rows = incoming.filter(have).select("point_id", F.xxhash64(*keys, "embedding").alias("_asked")).join(best, "_asked")
    other = F.when(F.col("_last") != F.col("point_id"), F.col("_last")).when(F.col("_first") != F.col("point_id"), F.col("_first"))
    named_rows = rows.withColumn("existing_id", other).filter("existing_id IS NOT NULL")
    top = F.max(F.struct("similarity", "existing_id")).alias("b")
    return named_rows.groupBy("point_id").agg(top).select("point_id", F.col("b.existing_id").alias("existing_id"), F.col("b.similarity").alias("similarity"))
