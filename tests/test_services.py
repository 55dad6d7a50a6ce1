from __future__ import annotations

import os
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions import validation
from tessera.operators import backfill, providers, search, stats
from tessera.sources import files, sync
from tessera.streaming import state

FOLDER = os.environ.get("TESSERA_TESTDATA", "/root/testdata/sf0.001")
given_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def asked(spark, name):
    return catalog.queries()[name](spark, FOLDER).collect()


@given_tables
def test_every_branch_occurs(spark):
    """The derived tables reach each outcome of these operators."""
    kinds = lambda name, column: {r[column] for r in asked(spark, name)}
    assert kinds("D1_two_stage_dedup", "reason") == {"empty_content", "content_too_short", "hash_match", "semantic_similarity", "unique"}
    assert kinds("P3_gating", "gate") >= {"hard_skip", "soft_skip", "full"}
    assert kinds("N1_freshness_scan", "tier") >= {"fresh", "aging", "expired", "unknown"}
    assert asked(spark, "F26_forge_filters") and asked(spark, "J5_hash_duplicates") and asked(spark, "J11_vector_near_duplicates")
    assert any(r.point_id.startswith("n") for r in asked(spark, "V17_semantic_duplicates"))
    assert kinds("J12_repeated_messages", "is_repeat") == {True, False} and kinds("F20_empty_sessions", "empty") == {True, False}
    assert kinds("K15_provider_chain", "provider") == {"first", "second", "fallback"}
    seen = {p.split(":")[1] for r in asked(spark, "K15_provider_chain") for p in r.passed_over.split(",") if p}
    assert seen == {"error", "circuit_open", "rate_limited", "low_confidence"}
    said = " ".join(r.errors for r in asked(spark, "F12_payload_validation"))
    assert all(x in said for x in ("Missing required field: content", "exceeds maximum", "too short", "Invalid type", "Invalid source_hook"))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_gates_and_tiers_at_a_larger_scale(spark):
    gates = {r.gate for r in catalog.queries()["P3_gating"](spark, "/root/testdata/sf0.1").collect()}
    tiers = {r.tier for r in catalog.queries()["N1_freshness_scan"](spark, "/root/testdata/sf0.1").collect()}
    assert gates == {"hard_skip", "soft_skip", "soft_gate", "full"} and tiers == {"fresh", "aging", "stale", "expired", "unknown"}


def bucket(rows, rate, burst=10.0):
    left, at, out = burst, None, []
    for now, n in rows:
        left = min(burst, left + (0 if at is None else (now - at) * rate))
        at = now
        out.append(left >= n)
        left -= n if left >= n else 0
    return out


@given_tables
def test_buckets_and_breakers_equal_plain_versions(spark):
    events = spark.read.parquet(f"{FOLDER}/events.parquet").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).collect()
    per = defaultdict(list)
    for e in sorted(events, key=lambda e: (e.at, e.event_id)):
        per[e.user_id].append(e)
    got = {r.user_id: (r.allowed, r.asked) for r in asked(spark, "T3_token_bucket")}
    assert got == {u: (sum(bucket([(e.at / 1e6, 4.0) for e in es], 0.0001)), len(es)) for u, es in per.items()}
    got = {r.user_id: r.allowed for r in asked(spark, "T4_dual_bucket")}
    for u, es in per.items():
        a, b = bucket([(e.at / 1e6, 1.0) for e in es], 0.0001), bucket([(e.at / 1e6, e.event_id % 5 + 1.0) for e in es], 0.0005, 20.0)
        assert got[u] == sum(x and y for x, y in zip(a, b, strict=True))
    lines = defaultdict(list)
    for e in sorted(events, key=lambda e: (e.at, e.event_id)):
        lines[e.user_id % 20].append((e.at / 1e6, e.event_type != "error"))
    got = {r.provider: (r.state, r.refused) for r in asked(spark, "T5_circuit_breaker")}
    for p, calls in lines.items():
        now, n, since, refused = "closed", 0, 0.0, 0
        for at, ok in calls:
            met = "half_open" if now == "open" and at - since > 3600 else now
            if met == "open":
                refused += 1
                continue
            n = 0 if ok else n + 1
            now = "closed" if ok else "open" if met == "half_open" or n >= 2 else "closed"
            since = at if now == "open" else since
        assert got[p] == (now, refused)


@given_tables
def test_greedy_fill_equals_a_plain_version(spark):
    found = spark.createDataFrame([(q, r, f"p{q}-{r}", ("same" if r % 4 == 3 else f"content {r} ") * (r % 5 + 1), 0.95 - r * 0.04) for q in range(6) for r in range(1, 16)], "query_id int, rank int, point_id string, content string, score double")
    from tessera.operators import packing

    got = {r.query_id: (r.selected, r.tokens) for r in packing.greedy(found, found.select("query_id").distinct().withColumn("budget", F.lit(12) + F.col("query_id") * 4), 0.6).collect()}
    for q in range(6):
        rows, used, seen, out = sorted((r for r in found.collect() if r.query_id == q), key=lambda r: r.rank), 0, set(), []
        best = max(r.score for r in rows)
        for r in rows:
            if r.content in seen:
                continue
            seen.add(r.content)
            n = len(r.content) // 4
            if r.score >= best * 0.6 and used + n <= 12 + q * 4:
                out.append(r.point_id)
                used += n
        assert got[q] == (out, used)


def test_retries_wait_with_full_jitter_and_only_for_timeouts():
    waits, bounds, calls = [], [], []

    def call():
        calls.append(1)
        if len(calls) < 4:
            raise providers.Timeout
        return "done"

    draw = lambda low, high: bounds.append((low, high)) or high / 2
    assert providers.with_retries(call, 3, 1.0, 3.0, waits.append, draw) == "done"
    assert bounds == [(0.0, 1.0), (0.0, 2.0), (0.0, 3.0)] and waits == [0.5, 1.0, 1.5]
    with pytest.raises(providers.Timeout):
        providers.with_retries(lambda: (_ for _ in ()).throw(providers.Timeout()), 2, sleep=waits.append, draw=draw)
    before = len(waits)
    with pytest.raises(ValueError):
        providers.with_retries(lambda: int("x"), 3, sleep=waits.append, draw=draw)
    assert len(waits) == before


def test_embedding_in_batches(spark):
    def client():
        def embed(texts):
            assert len(texts) <= 4
            return [[float(len(t))] for t in texts]

        return embed

    d = spark.createDataFrame([(i, None if i == 3 else " " if i == 5 else "x" * i) for i in range(1, 12)], "k int, content string")
    got = {r.k: r.embedding for r in providers.embedded(d, client, batch=4).collect()}
    assert got == {i: None if i in (3, 5) else [float(i)] for i in range(1, 12)}


def test_provider_chain(spark):
    def made():
        def first(content, kind):
            if content == "boom":
                raise RuntimeError
            return "rule", 0.9 if content == "sure" else 0.2

        return {"first": first, "second": lambda content, kind: ("decision", 0.75)}

    calls = [(0, "boom"), (1, "boom"), (2, "sure"), (70, "sure"), (71, "weak"), (72, "sure")]
    rows = spark.createDataFrame([("c", t, t, text, "user_message") for t, text in calls], "caller string, at long, id long, content string, type string").withColumn("at", F.timestamp_seconds("at"))
    got = sorted(tuple(r) for r in providers.classified(rows, "caller", "at", "id", made, lambda: providers.Guard(failures=2, seconds=60, rate=0.1, burst=4.0)).collect())
    assert [(r[3], r[4]) for r in got] == [("second", "first:error"), ("second", "first:error"), ("second", "first:circuit_open"), ("first", ""), ("second", "first:low_confidence"), ("first", "")]
    tight = providers.classified(rows, "caller", "at", "id", made, lambda: providers.Guard(rate=0.0, burst=1.0)).orderBy("id").collect()
    assert [r.provider for r in tight][1:3] == ["fallback"] * 2 or "first:rate_limited" in tight[1].passed_over
    assert tight[-1].type == "user_message" and tight[-1].confidence == 1.0


def test_reclassification_takes_up_where_it_stopped(spark):
    rows = spark.createDataFrame([(k, "x" if k % 3 else "y", ("user_message", "agent_response", "session")[k % 3]) for k in range(30)], "point_id int, content string, type string")
    rule = lambda content, kind: F.struct(F.when(content == "y", "rule").otherwise(kind).alias("type"))
    first, state1 = backfill.reclassified(rows, None, rule, most=5)
    second, state2 = backfill.reclassified(rows, state1, rule)
    whole, _ = backfill.reclassified(rows, None, rule)
    assert sorted(r.point_id for r in first.unionByName(second).collect()) == sorted(r.point_id for r in whole.collect()) == [k for k in range(30) if k % 3 == 0]
    assert {r.type: (r.last, r.processed, r.changed) for r in state2.collect()} == {"user_message": (27, 10, 10), "agent_response": (28, 10, 0)}
    after = {r.point_id: r.type for r in backfill.written_back(rows, whole).collect()}
    assert after[3] == "rule" and after[4] == "agent_response" and after[2] == "session"


def test_queue_lines_are_repaired(spark):
    ok = '{"content": "a", "group_id": "g", "memory_type": "m"}'
    lines = [ok, "", ok[:-1], '{"content": "a"}', '{"content": ', "[1]", '"text"', '{"content": 1', "nothing", ok + " x"]
    got = [(r.line, r.state) for r in backfill.repaired(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1)).collect()]
    assert got[:2] == [(ok, "valid"), (ok, "recovered")] and [s for _, s in got[2:]] == ["incomplete", "broken", "incomplete", "incomplete", "broken", "broken", "broken"]


def test_cycles_skip_what_is_stored(spark):
    raw = lambda *rows: spark.createDataFrame([(r,) for r in rows], "raw string")
    commit = '{"sha": "%s", "message": "%s", "date": "%s", "files": [{"filename": "a.py", "additions": 2, "deletions": 1}]}'
    none = spark.createDataFrame([], "kind string, item string, content_hash string, version int, is_current boolean, synced_at long, supersedes int")
    cursors = spark.createDataFrame([("commits", "2026-01-02")], "name string, last_synced string")
    store, moved, report = sync.cycle(none, cursors, {"commits": raw(commit % ("s1", "old", "2026-01-01"), commit % ("s2", "new", "2026-01-03"))}, 1)
    assert [tuple(r) for r in report.collect()] == [("commits", 1, 0)] and moved.first().last_synced == "2026-01-03"
    again = {"commits": raw(commit % ("s2", "new", "2026-01-03"), commit % ("s1", "old", "2026-01-01"))}
    store2, _, report = sync.cycle(store, moved, again, 2, full=True)
    assert [tuple(r) for r in report.collect()] == [("commits", 1, 1)]
    store3, _, _ = sync.cycle(store2, moved, {"commits": raw(commit % ("s2", "changed", "2026-01-04"))}, 3)
    assert sorted((r["item"], r.version, r.is_current, r.synced_at) for r in store3.collect()) == [("s1", 1, True, 2), ("s2", 1, False, 2), ("s2", 2, True, 3)]


def test_reviews_without_words_are_left_out(spark):
    v = lambda i, s, b: f'{{"id": {i}, "state": "{s}", "body": {b}}}'
    pull = '{"number": 7, "title": "T", "state": "closed", "merged_at": "2026-01-01", "reviews": [%s]}' % ",".join([v(1, "COMMENTED", '""'), v(2, "commented", "null"), v(3, "APPROVED", '""'), v(4, "COMMENTED", '"why?"')])
    got = sync.pull_requests(spark.createDataFrame([(pull,)], "raw string")).collect()
    assert sorted((r.kind, r["item"], r.state) for r in got) == [("github_pr", "7", "merged"), ("github_pr_review", "7/3", "approved"), ("github_pr_review", "7/4", "commented")]


def test_deep_metadata_and_snippets(spark):
    d = spark.createDataFrame([(1, 5, "`a` ```\nx\n\ny\n```"), (2, 101, "none")], "k int, depth int, c string")
    names = {n: F.lit(v) for n, v in (("type", "decision"), ("importance", None), ("agent", None), ("source_hook", "Stop"), ("group_id", "abc"), ("unique_id", None), ("created_at", None), ("component", None))}
    names = {n: c.cast("string") for n, c in names.items()}
    r = {x.k: x.r for x in d.select("k", validation.metadata_report(names, F.lit("{}"), F.col("depth")).alias("r")).collect()}
    assert r[1].valid and not r[2].valid and r[2].errors[0].startswith("JSON too deeply nested")
    assert [x.n for x in d.select(validation.snippets(F.col("c")).alias("n")).collect()] == [[1, 2], []]


def test_newest_within_equals_a_running_sum(spark):
    rows = [(i, i * 7 % 50, (i * 13) % 30 + 1) for i in range(300)]
    d = spark.createDataFrame(rows, "k int, s int, n int").withColumn("at", F.timestamp_seconds("s"))
    for most in (0, 1, 40, 500, 10**6):
        total, want = 0, set()
        for k, _, n in sorted(rows, key=lambda r: (-r[1], -r[0])):
            total += n
            want |= {k} if total <= most else set()
        assert {r.k for r in stats.newest_within(d, "at", "k", "n", most, 7).collect()} == want
    assert stats.newest_within(d.limit(0), "at", "k", "n", 5).count() == 0


def test_search_in_blocks_gives_the_same(spark, monkeypatch):
    m = spark.createDataFrame([(f"p{i}", [float(i % 5), float(i % 3), 1.0]) for i in range(40)], "point_id string, embedding array<float>")
    q = spark.createDataFrame([(i, [float(i), 1.0, 0.5]) for i in range(9)], "query_id int, query array<float>")
    key = lambda df: sorted((r.query_id, r.point_id, round(r.similarity, 6)) for r in df.collect())
    whole = key(search.scored(m, q, 0.3))
    monkeypatch.setattr(search, "MOST_BYTES", 200)
    assert key(search.scored(m, q, 0.3)) == whole and len(whole) > 50


def test_constraints_and_projects(spark, tmp_path):
    for name, body in (("global/CONSTRAINTS.md", "be brief"), ("build/constraints.md", "test first"), ("global/other.md", "no")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    read = lambda phase: files.constraints(spark, str(tmp_path), phase).first().text
    assert read(None) == "be brief\n\n---\nConstraints loaded: 1 global + 0 phase-specific"
    assert read("bu/../ild") == "be brief\n\n---\n\ntest first\n\n---\nConstraints loaded: 1 global + 1 phase-specific"


def test_captures_run_side_by_side_and_failures_are_raised(spark, tmp_path):
    state.captured({"a": spark.range(5), "b": spark.range(7)}, f"file://{tmp_path}/out", 120.0)
    assert Counter(r.capture for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == {"a": 5, "b": 7}
    with pytest.raises(Exception, match="(?i)divi"):
        state.captured({"a": spark.range(5), "bad": spark.range(3).selectExpr("1 / (id - id) AS x")}, f"file://{tmp_path}/bad", 120.0)


def test_index_reaches_the_recall_and_holds_every_row(spark, tmp_path):
    import numpy as np

    from tessera.operators import index

    rng = np.random.default_rng(1)
    middle = rng.normal(size=(40, 16))
    x = middle[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 16))
    m = spark.createDataFrame([(f"p{i:04d}", [float(v) for v in row]) for i, row in enumerate(x)], "point_id string, embedding array<float>")
    q = spark.createDataFrame([(i, [float(v) for v in x[i * 30]]) for i in range(100)], "query_id int, query array<float>")
    cells = index.fit(m, sample=1000)
    assert cells.probes < len(cells.centroids)
    index.store(m, cells, f"file://{tmp_path}/index")
    stored = spark.read.parquet(f"file://{tmp_path}/index")
    assert stored.count() == 3000 and stored.filter("cell IS NULL").count() == 0
    found, exact = index.search(stored, q, cells, 10), search.dense(m, q, 10, threshold=None)
    assert found.count() == 1000 and index.recall(found, exact).first().recall >= 0.9
    assert index.search(index.indexed(m.limit(0), cells), q, cells).count() == 0


@given_tables
def test_index_on_the_given_tables(spark):
    from tessera.operators import index

    m, q = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select(F.concat(F.lit("p"), F.lpad(F.col("vec_id").cast("string"), 6, "0")).alias("point_id"), "embedding", "vec_id"), None
    q = m.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    got = catalog.queries()["V1_indexed_search"](spark, FOLDER)
    assert index.recall(got, search.dense(m, q, 10, threshold=None)).first().recall >= 0.9
