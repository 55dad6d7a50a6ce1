"""Vector and scoring expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Half-lives in days by collection and by type, and the one for anything else.
COLLECTION_HALF_LIFE = {"code-patterns": 14, "discussions": 21, "conventions": 60, "jira-data": 30, "github": 14}
TYPE_HALF_LIFE = {
    "github_ci_result": 7, "agent_task": 14, "github_code_blob": 14, "github_commit": 14, "github_issue": 30, "github_pr": 30, "jira_issue": 30, "agent_memory": 30, "guideline": 60, "rule": 60,
    "agent_handoff": 180, "agent_insight": 180, "architecture_decision": 90,
}
OTHER_HALF_LIFE = 21
SEMANTIC_WEIGHT = 0.7
PROTECTED_ACCESSES = 3


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def square(a: Column) -> Column:
    """Squared length."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def norm(a: Column) -> Column:
    return F.sqrt(square(a))


def cosine(a: Column, b: Column, square_a: Column | None = None, square_b: Column | None = None) -> Column:
    """Cosine similarity, within -1 and 1; a vector of length zero is similar to nothing (0). One root of the product of squares, so a
    vector is similar to itself by exactly 1."""
    n = F.sqrt((square(a) if square_a is None else square_a) * (square(b) if square_b is None else square_b))
    c = dot(a, b) / n
    return F.when(n == 0, F.lit(0.0)).otherwise(F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(1.0)), F.lit(-1.0))))


def max_sim(query: Column, document: Column) -> Column:
    """Late interaction: for each query vector the best product with a document vector, summed."""
    best = F.transform(query, lambda q: F.array_max(F.transform(document, lambda d: dot(q, d))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x)


def _map(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def half_life(kind: Column, collection: Column) -> Column:
    """Days: by type, else by collection, else the common one."""
    return F.coalesce(_map(TYPE_HALF_LIFE, F.coalesce(kind, F.lit(""))), _map(COLLECTION_HALF_LIFE, F.coalesce(collection, F.lit(""))), F.lit(OTHER_HALF_LIFE)).cast("double")


def age_days(stored_at: Column, now: Column) -> Column:
    """Days since a moment, never below 0; a missing one counts as the start of 2020."""
    then = F.coalesce(stored_at, F.timestamp_seconds(F.lit(1577836800)))
    return F.greatest((F.unix_micros(now) - F.unix_micros(then)) / F.lit(86400e6), F.lit(0.0))


def temporal(age: Column, half: Column, accesses: Column | None = None) -> Column:
    """0.5 to the power of half-lives passed; what was accessed often is protected."""
    t = F.pow(F.lit(0.5), age / half)
    return t if accesses is None else F.when(F.coalesce(accesses, F.lit(0)) >= PROTECTED_ACCESSES, F.lit(1.0)).otherwise(t)


def fused(similarity: Column, time: Column, weight: float = SEMANTIC_WEIGHT) -> Column:
    return similarity * weight + time * (1 - weight)


def attribution(collection: Column, kind: Column, score: Column) -> Column:
    """[collection:type] (87%), the percentage cut off."""
    return F.concat(F.lit("["), collection, F.lit(":"), kind, F.lit("] ("), F.floor(score * 100).cast("int").cast("string"), F.lit("%)"))
