"""Records of a forge to versioned documents: pull requests with reviews, issues, commits, check runs; cycles with a cursor per type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import compose
from tessera.operators.versions import versioned_upsert

PULL = "number long, title string, body string, state string, merged_at string, updated_at string, user string, base string, head string, reviews array<struct<id: long, state: string, body: string, user: string, submitted_at: string>>"
ISSUE = "number long, title string, body string, state string, labels array<string>, updated_at string, pull_request string"
COMMIT = "sha string, message string, author string, date string, files array<struct<filename: string, additions: int, deletions: int>>"
RUN = "id long, name string, conclusion string, status string, head_branch string, head_sha string, created_at string, updated_at string"

#: Types in the order in which a cycle takes them.
ORDER = ("pull_requests", "issues", "commits", "ci_results")
COLUMNS = ["kind", "item", "content", "state", "at"]


def _parsed(raw: DataFrame, schema: str) -> DataFrame:
    return raw.select(F.from_json("raw", schema).alias("r")).select("r.*")


def reviews(raw: DataFrame) -> DataFrame:
    """Reviews of pull requests; comments without a body say nothing and are left out, approvals and requests stay."""
    r = _parsed(raw, PULL).select("number", F.explode("reviews").alias("v")).select("number", "v.*")
    kept = r.filter(~((F.coalesce("body", F.lit("")) == "") & (F.upper(F.coalesce("state", F.lit(""))) == "COMMENTED")))
    content = compose.review(F.col("number"), F.col("user"), F.col("state"), F.col("body"))
    return kept.select(F.lit("github_pr_review").alias("kind"), F.concat_ws("/", F.col("number").cast("string"), F.col("id").cast("string")).alias("item"), content.alias("content"), F.lower(F.coalesce("state", F.lit("commented"))).alias("state"), F.col("submitted_at").alias("at"))


def pull_requests(raw: DataFrame) -> DataFrame:
    """Pull requests and their reviews."""
    p = _parsed(raw, PULL)
    none, merged = F.array().cast("array<string>"), F.col("merged_at").isNotNull()
    content = compose.pull_request(F.col("number"), F.col("title"), F.coalesce("body", F.lit("")), merged, F.col("state"), F.col("base"), F.col("head"), none, none)
    state = F.when(merged, "merged").otherwise(F.col("state"))
    own = p.select(F.lit("github_pr").alias("kind"), F.col("number").cast("string").alias("item"), content.alias("content"), state.alias("state"), F.col("updated_at").alias("at"))
    return own.unionByName(reviews(raw))


def issues(raw: DataFrame) -> DataFrame:
    """Issues; what is a pull request is left out."""
    i = _parsed(raw, ISSUE).filter(F.col("pull_request").isNull())
    none = F.array().cast("array<string>")
    content = compose.forge_issue(F.col("number"), F.col("title"), F.coalesce("body", F.lit("")), F.coalesce("labels", none), none, F.lit(""), F.col("state"))
    return i.select(F.lit("github_issue").alias("kind"), F.col("number").cast("string").alias("item"), content.alias("content"), "state", F.col("updated_at").alias("at"))


def commits(raw: DataFrame) -> DataFrame:
    """Commits with their sizes and files."""
    c = _parsed(raw, COMMIT)
    total = lambda f: F.aggregate(F.coalesce("files", F.array().cast("array<struct<filename: string, additions: int, deletions: int>>")), F.lit(0), lambda s, x: s + F.coalesce(x[f], F.lit(0)))
    names = F.coalesce(F.col("files.filename"), F.array().cast("array<string>"))
    added, removed = total("additions"), total("deletions")
    content = compose.commit(F.col("sha"), F.col("message"), F.col("author"), added + removed, added, removed, names)
    return c.select(F.lit("github_commit").alias("kind"), F.col("sha").alias("item"), content.alias("content"), F.lit("stored").alias("state"), F.col("date").alias("at"))


def ci_results(raw: DataFrame) -> DataFrame:
    """Completed check runs; what they concluded is their state."""
    r = _parsed(raw, RUN).filter("status = 'completed'")
    state = F.coalesce("conclusion", "status", F.lit("unknown"))
    content = compose.check_run(F.col("name"), state, F.col("head_branch"), F.col("head_sha"))
    return r.select(F.lit("github_ci_result").alias("kind"), F.col("id").cast("string").alias("item"), content.alias("content"), state.alias("state"), F.coalesce("updated_at", "created_at").alias("at"))


READERS: dict[str, Callable[[DataFrame], DataFrame]] = {"pull_requests": pull_requests, "issues": issues, "commits": commits, "ci_results": ci_results}


def cycle(store: DataFrame, cursors: DataFrame, landed: dict[str, DataFrame], synced_at: int, full: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The store after a cycle, the cursors (name, last_synced) and a report (name, synced, skipped).

    store: kind, item, content_hash, version, is_current, synced_at, supersedes. Of each type, in order, records later than its cursor
    are taken (all where it has none, or in a full cycle). A record whose current version has the same content is skipped; else it
    becomes the next version.
    """
    documents = None
    for name in ORDER:
        if name in landed:
            d = READERS[name](landed[name]).select(*COLUMNS).withColumn("name", F.lit(name))
            documents = d if documents is None else documents.unionByName(d)
    c = cursors.select(F.col("name").alias("_name"), F.col("last_synced").alias("_last"))
    new = documents.join(F.broadcast(c), F.col("name") == F.col("_name"), "left")
    new = new.filter(F.lit(full) | F.col("_last").isNull() | (F.col("at") > F.col("_last"))).drop("_name", "_last").withColumn("content_hash", F.sha2(F.encode("content", "UTF-8"), 256))
    now = store.filter("is_current").select("kind", "item", F.col("content_hash").alias("_hash"))
    seen = new.join(now, ["kind", "item"], "left").withColumn("skipped", F.coalesce(F.col("_hash") == F.col("content_hash"), F.lit(False)))
    report = seen.groupBy("name").agg(F.count_if(~F.col("skipped")).alias("synced"), F.count_if("skipped").alias("skipped"), F.max("at").alias("last"))
    after = versioned_upsert(store, new.drop("name").withColumn("synced_at", F.lit(synced_at).cast("long")), ["kind", "item"])
    moved = cursors.join(report.select("name", "last"), "name", "full").select("name", F.greatest("last_synced", "last").alias("last_synced"))
    return after, moved, report.select("name", "synced", "skipped")
