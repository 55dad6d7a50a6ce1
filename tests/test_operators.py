from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import classify, compose, scan, text, vector
from tessera.operators import packing, search, versions
from tessera.streaming import state


def values(spark, strings, column):
    d = spark.createDataFrame([(i, s) for i, s in enumerate(strings)], "i int, s string")
    return [r.v for r in d.select("i", column(F.col("s")).alias("v")).orderBy("i").collect()]


def test_topics(spark):
    assert values(spark, ["Why did we choose port 26350?", "What was decided about auth", "How do I do it?", None], classify.decision_topic) == ["choose port 26350", "about auth", None, None]
    assert values(spark, ["What have we done on the memory system?", "What's the project status?"], classify.session_topic) == ["on the memory system", "project status"]
    assert values(spark, ["What are the best practices for Python logging?", "What's the naming convention for hooks?", "How do I implement auth?", "tell me the best practice"], classify.practice_topic) == ["Python logging", "hooks", "implement auth", "tell me the"]


def test_errors_and_significance(spark):
    assert values(spark, ["TypeError: expected str\nmore", "Traceback x\n", "Error: no route\nx", "fine", "  "], classify.error_signature) == ["TypeError: expected str", "Traceback detected", "Error: no route", None, None]
    assert values(spark, ["ok", "sounds good to me, thank you", "we decided to go with plan b", "a plain text of some length", None], classify.significance) == ["skip", "low", "high", "medium", "skip"]


def test_project_names(spark):
    assert values(spark, ["My Project v2.0", "  ", "--a--b--", "x" * 60, None], text.project_name) == ["my-project-v2-0", "unnamed-project", "a-b", "x" * 50, "unnamed-project"]


def test_masks_resolve_overlaps(spark):
    got = values(spark, ["a bob@x.io b 4111 1111 1111 1111 c", "plain", "ssn 123-45-6789 and 8.8.8.8, not 10.1.2.3", "@alice @pytest"], lambda c: scan.masked(c, scan.resolved(scan.findings(c, secrets=False))))
    assert got == ["a [EMAIL_REDACTED] b [CC_REDACTED] c", "plain", "ssn [SSN_REDACTED] and [IP_REDACTED], not 10.1.2.3", "[HANDLE_REDACTED] @pytest"]


def test_composed_pull_request(spark):
    none = F.array().cast("array<string>")
    files = F.transform(F.sequence(F.lit(1), F.lit(22)), lambda i: F.concat(F.lit("f"), i.cast("string")))
    got = spark.range(1).select(compose.pull_request(F.lit(7), F.lit("T"), F.lit(""), F.lit(True), F.lit("closed"), F.lit("main"), F.lit("dev"), none, files).alias("t")).first().t
    assert got == "PR #7: T\n\nState: merged | Branch: main <- dev | Files changed: " + ", ".join(f"f{i}" for i in range(1, 21)) + " (+2 more)"


def test_greedy_fill_skips_what_does_not_fit(spark):
    rows = [("q", 1, "a", "x" * 40, 0.9), ("q", 2, "b", "y" * 400, 0.8), ("q", 3, "c", "x" * 40, 0.8), ("q", 4, "d", " ", 0.8), ("q", 5, "e", "z" * 20, 0.75), ("q", 6, "f", "w" * 8, 0.3), ("q", 7, "g", "v" * 8, 0.7)]
    found = spark.createDataFrame(rows, "query_id string, rank int, point_id string, content string, score double")
    got = packing.greedy(found, spark.createDataFrame([("q", 20)], "query_id string, budget int"), 0.7, excluded=("g",)).first()
    assert got.selected == ["a", "e"] and got.tokens == 15


def test_upsert_after_a_return_to_older_content(spark):
    cur = spark.createDataFrame([(1, "a", 1, False, 1, None), (1, "b", 2, True, 2, 1), (2, "c", 1, True, 1, None)], "k int, content_hash string, version int, is_current boolean, synced_at long, supersedes int")
    inc = spark.createDataFrame([(1, "a", 9), (2, "c", 9), (3, "d", 9)], "k int, content_hash string, synced_at long")
    got = sorted(tuple(r) for r in versions.versioned_upsert(cur, inc, ["k"]).fillna(0).collect())
    assert got == [(1, "a", 1, False, 1, 0), (1, "a", 3, True, 9, 2), (1, "b", 2, False, 2, 1), (2, "c", 1, True, 9, 0), (3, "d", 1, True, 9, 0)]


@settings(max_examples=30, deadline=None)
@given(st.floats(0, 5000), st.floats(0.5, 400))
def test_decay_bounds(age, half):
    t = 0.5 ** (age / half)
    assert 0 <= t <= 1


def test_decay_orders_by_age(spark):
    d = spark.createDataFrame([(0.0, 21.0), (21.0, 21.0), (42.0, 21.0)], "a double, h double").select(vector.temporal(F.col("a"), F.col("h")).alias("t"))
    assert [r.t for r in d.collect()] == [1.0, 0.5, 0.25]


def test_zero_vectors_are_similar_to_nothing(spark):
    d = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert d.select(vector.cosine(F.col("a"), F.col("b")).alias("c")).first().c == 0.0


def test_cascade_adds_only_where_weak(spark):
    s = "query_id int, point_id string, score double, rank int"
    strong = [(1, f"p{i}", 0.9 - i / 10, i) for i in range(3)] + [(2, "p9", 0.6, 1)]
    second = [(q, f"s{q}", 0.95, 1) for q in (1, 2, 3)]
    got = {(r.query_id, r.point_id) for r in search.cascade(spark.createDataFrame(strong, s), spark.createDataFrame(second, s)).collect()}
    assert got == {(1, "p0"), (1, "p1"), (1, "p2"), (2, "p9"), (2, "s2"), (3, "s3")}


def test_token_bucket_and_circuit(spark):
    calls = [("a", i, False) for i in range(5)] + [("a", 30, True), ("a", 70, True), ("a", 71, True)]
    c = spark.createDataFrame(calls, "k string, at long, ok boolean").select("k", F.timestamp_seconds("at").alias("at"), "ok")
    got = state.circuit(c, ["k"], "at", "ok").first()
    assert got.states == ["closed"] * 5 + ["open", "half_open", "closed"] and got.state == "closed"
    r = spark.createDataFrame([("a", i, 4.0) for i in (0, 1, 2, 10)], "k string, at long, tokens double").select("k", F.timestamp_seconds("at").alias("at"), "tokens")
    b = state.token_bucket(r, ["k"], "at", "tokens").first()
    assert b.allowed == [True, True, True, True] and b.left == pytest.approx(4.0)


def test_streams_drop_repeats(spark, tmp_path):
    rows = [("s", "hi", "2024-01-01 00:00:00"), ("s", "hi", "2024-01-01 00:01:00"), ("s", "ho", "2024-01-01 00:02:00"), ("t", "hi", "2024-01-01 00:02:00")]
    spark.createDataFrame(rows, "session_id string, text string, at string").select("session_id", "text", F.to_timestamp("at").alias("event_time")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session_id string, text string, event_time timestamp").parquet(str(tmp_path / "in"))
    q = state.new_messages(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    assert sorted((r.session_id, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("s", "hi"), ("s", "ho"), ("t", "hi")]


def test_keys_with_many_events_are_stepped_through_in_order(spark):
    """Far more events than one batch holds, half of all of one key; a fold that copies its list at every event does not end."""
    n = 120_000
    e = spark.range(n).select(F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id") % 7).cast("int").alias("k"), F.timestamp_seconds(F.col("id") * 3 % n).alias("at"), "id", (F.col("id") % 5 == 0).alias("ok"), F.lit(2.0).alias("tokens"))
    got = {r.k: (r.calls, r.refused, r.last, r.state) for r in state.circuit_steps(e, ["k"], "at", "ok", 3, 50.0).groupBy("k").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("met") == "open").alias("refused"), F.max("n").alias("last"), F.max_by("state", "n").alias("state")).collect()}
    passed = {r.k: r.n for r in state.bucket_steps(e, ["k"], "at", "tokens", 0.1).groupBy("k").agg(F.count_if("allowed").alias("n")).collect()}
    per = {}
    for i in sorted(range(n), key=lambda i: (i * 3 % n, i)):
        per.setdefault(-1 if i % 2 == 0 else i % 7, []).append((i * 3 % n, i % 5 == 0))
    assert set(got) == set(per)
    for k, calls in per.items():
        now, bad, since, refused, left, before, ok = "closed", 0, 0, 0, 10.0, calls[0][0], 0
        for at, good in calls:
            left, before = min(10.0, left + (at - before) * 0.1), at
            left, ok = (left - 2, ok + 1) if left >= 2 else (left, ok)
            met = "half_open" if now == "open" and at - since > 50 else now
            if met == "open":
                refused += 1
                continue
            bad = 0 if good else bad + 1
            now = "closed" if good else "open" if met == "half_open" or bad >= 3 else "closed"
            since = at if now == "open" else since
        assert got[k] == (len(calls), refused, len(calls) - 1, now) and passed[k] == ok
