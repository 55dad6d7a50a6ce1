"""Vectors as one byte a dimension: a quarter of the bytes to scan, and the exact vectors only of what that scan proposes.

Each dimension is cut into 256 steps between its least and greatest value over all rows. A search scores the codes with a matrix
product for whole batches, keeps every row that may be among the hits by the greatest error of a code, and scores those again on the
exact vectors, so the hits are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vector
from tessera.operators import search

#: Queries that are scored together, and what single precision may add to the error of codes.
TOGETHER, SINGLE = 256, 2e-5


@dataclass(frozen=True)
class Scale:
    """The least value of each dimension and its step."""

    low: np.ndarray
    step: np.ndarray

    def encode(self, x: np.ndarray) -> np.ndarray:
        return (np.clip(np.rint((x - self.low) / self.step), 0, 255) - 128).astype(np.int8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return (codes.astype(np.float32) + 128) * self.step + self.low


def rows_of(column: pa.Array) -> np.ndarray:
    """A column of vectors of one length as a matrix."""
    flat = column.flatten()
    return np.asarray(flat, np.float32).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.float32)


def fit(memories: DataFrame) -> Scale:
    """Bounds of every dimension over all rows; a row for each dimension reaches the driver."""

    def bounds(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for b in iterator:
            if b.num_rows:
                x = rows_of(b.column(0))
                low, high = (x.min(0), x.max(0)) if low is None else (np.minimum(low, x.min(0)), np.maximum(high, x.max(0)))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low), dtype=np.int32)), pa.array(low.astype(np.float64)), pa.array(high.astype(np.float64))], ["at", "low", "high"])

    per = memories.filter("embedding IS NOT NULL").select("embedding").mapInArrow(bounds, "at int, low double, high double")
    found = sorted(per.groupBy("at").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect())
    low, high = np.array([r.low for r in found], np.float32), np.array([r.high for r in found], np.float32)
    return Scale(low, np.maximum((high - low) / 255, 1e-9).astype(np.float32))


def coded(memories: DataFrame, scale: Scale) -> DataFrame:
    """memories with code (a byte for each dimension) and norm in place of embedding; rows without a vector are left out."""
    held = memories.sparkSession.sparkContext.broadcast(scale)

    def encode(column: pd.Series) -> pd.Series:
        if not len(column):
            return pd.Series([], dtype=object)
        codes = held.value.encode(np.stack([np.asarray(v, np.float32) for v in column]))
        return pd.Series([row.tobytes() for row in codes])

    encode.__annotations__ = {"column": pd.Series, "return": pd.Series}
    norm = vector.norm(F.col("embedding")).cast("float")
    return memories.filter("embedding IS NOT NULL").withColumn("norm", norm).withColumn("code", F.pandas_udf(encode, "binary")("embedding")).drop("embedding")


class Top:
    """Of each query, batch by batch, the rows whose score and slack reach what so many rows have at least."""

    def __init__(self, queries: int, most: int) -> None:
        self.most, self.least = most, np.full(queries, -np.inf)
        self.rows = [(np.zeros(0, np.float32), np.zeros(0, np.float32), np.zeros(0, object)) for _ in range(queries)]

    def add(self, score: np.ndarray, slack: np.ndarray, ids: np.ndarray, first: int) -> None:
        """Scores of queries from the first on, a row each, for a batch's ids, and how far from the exact ones they may be."""
        for k in range(len(score)):
            new = score[k] + slack[k] >= self.least[first + k]
            if not new.any():
                continue
            s, e, i = (np.concatenate(p) for p in zip(self.rows[first + k], (score[k][new], slack[k][new], ids[new]), strict=True))
            if len(s) >= self.most:
                self.least[first + k] = np.partition(s - e, -self.most)[-self.most]
                keep = s + e >= self.least[first + k]
                s, e, i = s[keep], e[keep], i[keep]
            self.rows[first + k] = (s, e, i)


def proposed(codes: DataFrame, queries: DataFrame, scale: Scale, most: int) -> DataFrame:
    """query_id, point_id, score, slack: all rows that may be among the best so many of each query, by codes and their error. The queries are a stated set, taken in blocks of a
    checked size; each block is broadcast."""
    spark = codes.sparkSession
    size = queries.agg(F.sum(F.size("query").cast("long") * 4 + 64)).first()[0] or 0
    blocks, out = max(1, -(-size // search.MOST_BYTES)), None
    schema = f"query_id {dict(queries.dtypes)['query_id']}, point_id {dict(codes.dtypes)['point_id']}, score float, slack float"
    for b in range(blocks):
        part = (queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).select("query_id", "query").toArrow().combine_chunks()
        if not part.num_rows:
            continue
        q = rows_of(part.column("query").combine_chunks())
        length = np.linalg.norm(q, axis=1, keepdims=True)
        q = np.divide(q, length, out=np.zeros_like(q), where=length > 0)
        held = spark.sparkContext.broadcast((part.column("query_id").combine_chunks(), q * scale.step, q @ (scale.low + 128 * scale.step), np.abs(q * scale.step).sum(1) * 0.51 + SINGLE))

        def scan(iterator: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            names, weights, shift, error = held.value
            best, kind = Top(len(weights), most), None
            for batch in iterator:
                kind = batch.column(0).type
                if batch.num_rows:
                    x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int8).reshape(batch.num_rows, -1).astype(np.float32)
                    norm, ids = np.asarray(batch.column(2), np.float32), np.array(batch.column(0).to_pylist(), object)
                    norm = np.where(norm > 0, norm, np.inf)
                    for k in range(0, len(weights), TOGETHER):
                        best.add((weights[k : k + TOGETHER] @ x.T + shift[k : k + TOGETHER, None]) / norm, error[k : k + TOGETHER, None] / norm + SINGLE, ids, k)
            if kind is not None:
                at = np.repeat(np.arange(len(weights)), [len(s) for s, _, _ in best.rows])
                ids = pa.array([i for _, _, own in best.rows for i in own], kind)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(at)), ids, *(pa.array(np.concatenate([r[n] for r in best.rows]).astype(np.float32)) for n in (0, 1))], ["query_id", "point_id", "score", "slack"])

        found = codes.select("point_id", "code", "norm").mapInArrow(scan, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], schema)
    least = search.top(out.withColumn("_least", F.col("score") - F.col("slack")), most, "_least").filter(F.col("rank") == most).select("query_id", "_least")
    return out.join(least, "query_id", "left").filter(F.col("_least").isNull() | (F.col("score") + F.col("slack") >= F.col("_least"))).drop("_least")


def rescored(found: DataFrame, memories: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best of the proposed rows by their exact vectors."""
    pairs = found.select("query_id", "point_id").join(memories, "point_id").join(queries.select("query_id", "query"), "query_id")
    return search.top(pairs.withColumn("score", vector.cosine(F.col("embedding"), F.col("query"))).drop("embedding", "query"), k)


def searched(codes: DataFrame, memories: DataFrame, queries: DataFrame, scale: Scale, k: int = 10, filters: search.Filters | None = None) -> DataFrame:
    """The k best rows of each query: a scan of the codes that pass the filters, and the exact vectors of all that may be among them."""
    passed = codes if filters is None else codes.filter(filters.condition())
    return rescored(proposed(passed, queries, scale, k), memories, queries, k)
