"""Gating and packing of retrieved rows into a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import estimated_tokens, short_hash

# Gates of the best score by collection, and the floor below which nothing is injected.
FLOOR, OTHER_GATE = 0.45, 0.60
GATES = {"conventions": 0.65, "code-patterns": 0.55, "discussions": 0.60}
SOFT_MARGIN = 0.05
BUDGET = (500, 1500)
WEIGHTS = (0.5, 0.3, 0.2)


def gate(best: Column, collection: Column) -> Column:
    """hard_skip below the floor, full at the collection's gate, soft_gate just below it, soft_skip between."""
    limit = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in GATES.items() for x in kv)), collection), F.lit(OTHER_GATE))
    return F.when(best < FLOOR, "hard_skip").when(best >= limit, "full").when(best >= limit - SOFT_MARGIN, "soft_gate").otherwise("soft_skip")


def budget(best: Column, density: Column, drift: Column, low: int = BUDGET[0], high: int = BUDGET[1]) -> Column:
    """Tokens to inject: more for better, denser and newer topics."""
    q, d, r = WEIGHTS
    signal = F.greatest(F.least(best, F.lit(1.0)), F.lit(0.0)) * q + density * d + drift * r
    return F.least(F.greatest(low + F.floor((high - low) * signal).cast("int"), F.lit(low)), F.lit(high))


def greedy(found: DataFrame, budgets: DataFrame, gap: float = 0.7, excluded: tuple[str, ...] = ()) -> DataFrame:
    """query_id, selected (point_ids in order), tokens. Rows are taken in rank order while they fit; a row too large is skipped, the
    next may fit. Blank rows, excluded ones, repeated contents and those far below the best are passed over.

    The fold runs per query over its ranked candidates, which the search before it has limited.
    """
    row = F.struct("rank", "point_id", "content", "score", short_hash(F.col("content"), 16).alias("hash"), estimated_tokens(F.col("content")).alias("tokens"))
    grouped = found.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.coalesce(F.max(F.when(F.col("score") < 1.0, F.col("score"))), F.lit(0.0)).alias("best")).join(budgets, "query_id")
    state = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("ids"))

    def step(best: Column, limit: Column):
        def add(acc: Column, x: Column) -> Column:
            passed = F.array_contains(F.array(*(F.lit(e) for e in excluded)), x["point_id"]) if excluded else F.lit(False)
            blank, repeated = F.trim(x["content"]) == "", F.array_contains(acc["seen"], x["hash"])
            far, fits = (best > 0) & (x["score"] < best * gap), acc["used"] + x["tokens"] <= limit
            new = ~(passed | blank | repeated)
            take = new & ~far & fits
            return F.struct(
                F.when(take, acc["used"] + x["tokens"]).otherwise(acc["used"]).alias("used"),
                F.when(new, F.array_append(acc["seen"], x["hash"])).otherwise(acc["seen"]).alias("seen"),
                F.when(take, F.array_append(acc["ids"], x["point_id"])).otherwise(acc["ids"]).alias("ids"),
            )

        return add

    done = grouped.withColumn("r", F.aggregate("rows", state, step(F.col("best"), F.col("budget"))))
    return done.select("query_id", F.col("r.ids").alias("selected"), F.col("r.used").alias("tokens"))


def rendered(found: DataFrame, full: float = 0.90, least: float = 0.50, cut: int = 500) -> DataFrame:
    """query_id, text: high hits whole, others cut, in rank order; weak ones left out."""
    body = F.when(F.col("score") >= full, F.col("content")).when(F.col("score") >= least, F.when(F.length("content") > cut, F.concat(F.substring("content", 1, cut), F.lit("..."))).otherwise(F.col("content")))
    line = F.concat(F.lit("- ["), F.col("type"), F.lit("] "), body)
    parts = F.array_sort(F.collect_list(F.when(body.isNotNull(), F.struct(F.col("rank"), line.alias("line")))))
    return found.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("text"))
