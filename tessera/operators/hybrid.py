"""Search by vectors and words at once, by the best means that a query has: late interaction, fused ranks, or its one vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import vector
from tessera.operators import late
from tessera.operators.search import Filters, lexical, nearest, rrf, tokens, top
from tessera.sources.shared import cut

COLBERT, RRF, DECAYED, DENSE = "hybrid_colbert", "hybrid_rrf", "hybrid_rrf_decay", "dense"


def mode(text: Column, vectors: Column, reranked: bool, decayed: bool) -> Column:
    """How a query is answered: without words by its vector alone; with decay by fused ranks and age; else by late interaction where
    it has many vectors and the memories do, and by fused ranks where not."""
    words = F.size(tokens(F.coalesce(text, F.lit("")))) > 0
    many = (F.lit(reranked) & vectors.isNotNull() & (F.size(vectors) > 0)) if reranked else F.lit(False)
    return F.when(~words, DENSE).when(F.lit(decayed), DECAYED).when(many, COLBERT).otherwise(RRF)


def _rounded(found: DataFrame, column: str, digits: int | None) -> DataFrame:
    return found if digits is None else found.withColumn(column, F.round(column, digits))


def legs(memories: DataFrame, queries: DataFrame, most: int, threshold: float | None = None, digits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The best memories by vector and by words: query_id, point_id, rank."""
    first = nearest(memories, queries.select("query_id", "query"), most, threshold, digits)
    return first, lexical(memories, queries.select("query_id", "text"), most, digits)


def searched(memories: DataFrame, queries: DataFrame, k: int = 5, filters: Filters | None = None, vectors: DataFrame | None = None, now: Column | None = None, weight: float = vector.SEMANTIC_WEIGHT, digits: int | None = None) -> DataFrame:
    """query_id, point_id, mode, score, rank of the k best memories of each query (query_id, query, text, vectors; text and vectors
    may be null). The means is chosen for each query within one plan.

    vectors: point_id, vectors of memories, for late interaction; memories without any are then not found by it. now: scores are
    weighed with age, on fused ranks. digits: scores are rounded before they are ranked.
    """
    m, most = memories.filter((filters or Filters()).condition()), max(50, 5 * k)
    q = queries.withColumn("mode", mode(F.col("text"), F.col("vectors"), vectors is not None, now is not None))
    # the legs are a few rows for each query and are read by every means: they are written once
    first, second = (cut(leg, "hybrid-leg") for leg in legs(m, q, most, digits=digits))
    how = q.select("query_id", "mode")
    by = lambda found, *names: found.join(how.filter(F.col("mode").isin(*names)), "query_id")
    fused = _rounded(rrf(first, second), "score", digits)
    parts = [top(by(first, DENSE).withColumn("score", F.col("similarity")), k)]
    if now is None:
        parts.append(top(by(fused, RRF), k))
    else:
        near = top(by(fused, DECAYED), most).drop("rank").withColumnRenamed("score", "_fused")
        aged = near.join(m.select("point_id", "stored_at", "type", "collection", "access_count"), "point_id")
        time = vector.temporal(vector.age_days(F.col("stored_at"), now), vector.half_life(F.col("type"), F.col("collection")), F.col("access_count"))
        parts.append(top(_rounded(aged.withColumn("score", vector.fused(F.col("_fused"), time, weight)), "score", digits), k))
    if vectors is not None and now is None:
        pairs = by(first, COLBERT).select("query_id", "point_id").unionByName(by(second, COLBERT).select("query_id", "point_id")).distinct()
        ranked = late.rerank(pairs, vectors, q.select("query_id", "vectors"), most)
        parts.append(top(_rounded(ranked.drop("rank"), "score", digits), k).withColumn("mode", F.lit(COLBERT)))
    out = None
    for p in parts:
        p = p.select("query_id", "point_id", "mode", "score", "rank")
        out = p if out is None else out.unionByName(p)
    return out
