"""Statistics of collections, queues and metric series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WARNING, CRITICAL = 10_000, 50_000


def collection_stats(memories: DataFrame) -> DataFrame:
    """Points and last update of each collection and project."""
    return memories.groupBy("collection", "group_id").agg(F.count(F.lit(1)).alias("points"), F.max("stored_at").alias("last_update"))


def warnings(stats: DataFrame, warning: int = WARNING, critical: int = CRITICAL) -> DataFrame:
    """One row for each threshold that a collection or project has passed."""
    total = stats.groupBy("collection").agg(F.sum("points").alias("points"))
    level = F.when(F.col("points") >= critical, "CRITICAL").when(F.col("points") >= warning, "WARNING")
    limit = F.when(F.col("points") >= critical, critical).otherwise(warning).cast("string")
    whole = total.select(F.concat(level, F.lit(": "), F.col("collection"), F.lit(" has "), F.col("points").cast("string"), F.lit(" memories (threshold: "), limit, F.lit(")")).alias("warning"))
    part = stats.filter(F.col("points") >= warning).select(F.concat(F.lit("WARNING: Project '"), F.col("group_id"), F.lit("' has "), F.col("points").cast("string"), F.lit(" memories")).alias("warning"))
    return whole.filter("warning IS NOT NULL").unionByName(part)


def histogram(values: DataFrame, by: list[str], value: Column, edges: list[float]) -> DataFrame:
    """Cumulative buckets: by, le, n; the last edge is infinite."""
    counts = [F.count_if(value <= e).alias(f"_{i}") for i, e in enumerate(edges)]
    wide = values.groupBy(*by).agg(*counts, F.count(value).alias("_all"))
    items = F.array(*(F.struct(F.lit(float(e)).alias("le"), F.col(f"_{i}").alias("n")) for i, e in enumerate(edges)), F.struct(F.lit(float("inf")).alias("le"), F.col("_all").alias("n")))
    return wide.select(*by, F.explode(items).alias("b")).select(*by, "b.le", "b.n")


def quantile(buckets: DataFrame, by: list[str], q: float) -> DataFrame:
    """A quantile from cumulative buckets, linear within the bucket; above the last finite edge it is that edge."""
    w = Window.partitionBy(*by).orderBy("le")
    b = buckets.withColumn("_le", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("_n", F.coalesce(F.lag("n").over(w), F.lit(0))).withColumn("_target", F.max("n").over(Window.partitionBy(*by)) * q)
    inside = F.when(F.isnan("le") | (F.col("le") == float("inf")), F.col("_le")).otherwise(F.col("_le") + (F.col("le") - F.col("_le")) * (F.col("_target") - F.col("_n")) / (F.col("n") - F.col("_n")))
    return b.filter((F.col("n") >= F.col("_target")) & (F.col("_n") < F.col("_target"))).groupBy(*by).agg(F.min(inside).alias("quantile"))


def increase(series: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """Growth of a counter, a fall being a restart from 0: by, increase, resets."""
    w = Window.partitionBy(*by).orderBy(at)
    step = F.col(value) - F.lag(value).over(w)
    d = series.withColumn("_d", F.when(step >= 0, step).when(step < 0, F.col(value)).otherwise(0)).withColumn("_r", F.coalesce(step < 0, F.lit(False)))
    return d.groupBy(*by).agg(F.sum("_d").alias("increase"), F.count_if("_r").alias("resets"))


def over_range(series: DataFrame, by: list[str], at: str, value: str, seconds: int) -> DataFrame:
    """by, at, increase, rate, changes of a counter over the time before each sample, the sample included: a frame of a range of time.

    at: a whole number of seconds, no two samples of a series alike. A fall is a restart from 0 wherever it stands in the frame. What
    the frame's samples show is stretched to its edge: to the edge itself where the first sample is as near as samples are apart (to a
    tenth), else by half of what they are apart, but never below what makes the counter 0. Fewer than two samples give null.
    """
    w = Window.partitionBy(*by).orderBy(at)
    step = F.col(value) - F.lag(value).over(w)
    grown = F.coalesce(F.when(step >= 0, step).otherwise(F.when(step < 0, F.col(value))), F.lit(0.0))
    s = series.withColumn("_g", grown).withColumn("_c", F.coalesce((step != 0).cast("long"), F.lit(0)))
    s = s.withColumn("_sum", F.sum("_g").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_changes", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    frame = w.rangeBetween(-(seconds - 1), 0)
    first = lambda c: F.first(c).over(frame)
    s = s.select(*by, at, "_sum", "_changes", F.count(F.lit(1)).over(frame).alias("_n"), first("_sum").alias("_s0"), first("_changes").alias("_c0"), first(at).alias("_t0"), first(value).alias("_v0"))
    raw, span = F.col("_sum") - F.col("_s0"), (F.col(at) - F.col("_t0")).cast("double")
    apart = span / (F.col("_n") - 1)
    before = (F.col("_t0") - (F.col(at) - seconds)).cast("double")
    reach = F.when(before < apart * 1.1, before).otherwise(apart / 2)
    zero = F.when((raw > 0) & (F.col("_v0") >= 0), span * F.col("_v0") / raw)
    stretched = raw * (span + F.least(reach, F.coalesce(zero, reach))) / span
    two = F.col("_n") > 1
    return s.select(*by, at, F.when(two, stretched).alias("increase"), F.when(two, stretched / seconds).alias("rate"), (F.col("_changes") - F.col("_c0")).alias("changes"))


def ready(queue: DataFrame, now: Column) -> DataFrame:
    return queue.filter((F.col("next_retry_at") <= now) & (F.col("retry_count") < F.col("max_retries")))


def queue_stats(queue: DataFrame, now: Column) -> DataFrame:
    exhausted = F.col("retry_count") >= F.col("max_retries")
    return queue.groupBy("failure_reason").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~exhausted & (F.col("next_retry_at") <= now)).alias("ready"),
        F.count_if(~exhausted & (F.col("next_retry_at") > now)).alias("awaiting"), F.count_if(exhausted).alias("exhausted"),
    )


def backoff_minutes(failures: Column) -> Column:
    """Minutes before the next try: 1, 5, then 15."""
    return F.when(failures <= 0, 1).when(failures == 1, 5).otherwise(15)


def newest_until(rows: DataFrame, by: list[str], at: str, size: str, most: int) -> DataFrame:
    """The newest rows whose sizes still fit."""
    w = Window.partitionBy(*by).orderBy(F.col(at).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_s", F.sum(size).over(w)).filter(F.col("_s") <= most).drop("_s")


def compared(baseline: DataFrame, new: DataFrame) -> DataFrame:
    """How recall (query_id, recalled) changed; shares are of all queries of the baseline, also of those that were not asked again."""
    b, n = baseline.select("query_id", F.col("recalled").alias("b")), new.select("query_id", F.col("recalled").alias("n"))
    j = b.join(n, "query_id", "left")
    up, down = F.coalesce(F.col("n") & ~F.col("b"), F.lit(False)), F.coalesce(F.col("b") & ~F.col("n"), F.lit(False))
    t = j.agg(F.count(F.lit(1)).alias("total_queries"), F.count_if(up).alias("recall_improved"), F.count_if(down).alias("recall_regressed"), F.coalesce(F.min(F.col("n").cast("int")), F.lit(1)).cast("double").alias("min_recall_at_5"))
    share = lambda c: F.when(F.col("total_queries") > 0, F.col(c) / F.col("total_queries")).otherwise(0.0)
    return t.withColumn("improvement_pct", share("recall_improved")).withColumn("regression_pct", share("recall_regressed"))


def evaluated(traces: DataFrame, key: str, at: str, since: Column, until: Column, fits: Column, rate: float, judge: Column) -> DataFrame:
    """key, sampled, score of the traces of a time: those that fit are sampled by a hash of their key, so a rerun takes the same ones,
    and scored if they have an output."""
    h = F.conv(F.substring(F.md5(F.encode(F.col(key).cast("string"), "UTF-8")), 1, 6), 16, 10).cast("long") % 100
    t = traces.filter((F.col(at) >= since) & (F.col(at) < until))
    sampled = F.coalesce(fits & (h < round(rate * 100)) & F.col("output").isNotNull(), F.lit(False))
    return t.select(key, sampled.alias("sampled"), F.when(sampled, judge).alias("score"))


def alerts(scores: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """evaluator, score (mean), alert: below the evaluator's own threshold."""
    limits = F.create_map(*(F.lit(x) for kv in thresholds.items() for x in kv))
    return scores.groupBy("evaluator").agg(F.avg("score").alias("score")).select("evaluator", "score", (F.col("score") < F.element_at(limits, F.col("evaluator"))).alias("alert"))


def newest_within(rows: DataFrame, at: str, key: str, size: str, most: int, buckets: int = 200) -> DataFrame:
    """The newest rows whose sizes sum to no more than most. Sums per bucket of time tell which buckets are kept whole; only the bucket
    in which the sum is reached is ordered row by row."""
    low, high = rows.agg(F.min(F.unix_micros(F.col(at).cast("timestamp"))), F.max(F.unix_micros(F.col(at).cast("timestamp")))).first()
    if low is None:
        return rows
    span = max(1, (high - low) // buckets + 1)
    b = rows.withColumn("_b", F.floor((F.unix_micros(F.col(at).cast("timestamp")) - low) / span))
    above = Window.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = b.groupBy("_b").agg(F.sum(size).alias("_own")).withColumn("_above", F.coalesce(F.sum("_own").over(above), F.lit(0)))
    near = b.join(F.broadcast(sums), "_b").filter(F.col("_above") <= most)
    w = Window.partitionBy("_b").orderBy(F.col(at).desc(), F.col(key).desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole, cut = near.filter(F.col("_above") + F.col("_own") <= most), near.filter(F.col("_above") + F.col("_own") > most)
    return whole.select(*rows.columns).unionByName(cut.withColumn("_run", F.col("_above") + F.sum(size).over(w)).filter(F.col("_run") <= most).select(*rows.columns))
