"""Keyed state, versions of chunks, ranges of counters, entropy, phrases, templates and error places against plain versions."""

from __future__ import annotations

import math
import os
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions import chunking, classify, errors, phrases, scan, text, validation
from tessera.operators import backfill, blobs, freshness, stats
from tessera.plans import tables
from tessera.streaming import keyed

FOLDER = os.environ.get("TESSERA_TESTDATA", "/root/testdata/sf0.001")
given_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
HOUR = 3600


# Keyed state
def batches(spark, tmp_path, rows, schema, run, mode="append"):
    """What a stream gives for each of some batches, one file for each."""
    out = []
    source = f"file://{tmp_path}/in"
    for n, batch in enumerate(rows):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        stream = run(spark.readStream.schema(schema).parquet(source))
        got = []
        with keyed.state_store(spark):
            stream.writeStream.outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/at").trigger(availableNow=True).foreachBatch(lambda df, _: got.extend(df.collect())).start().awaitTermination()  # noqa: B023
        out.append(sorted(tuple(r) for r in got))
        assert n < 9
    return out


def test_first_edits_are_forgotten_after_a_day(spark, tmp_path):
    schema = "session_id string, file_path string, event_time timestamp"
    at = lambda h: F.timestamp_seconds(F.lit(int(1_700_000_000 + h * HOUR)))
    t = lambda h: spark.range(1).select(at(h).alias("t")).first().t
    got = batches(spark, tmp_path, [
        [("s", "a", t(0)), ("s", "b", t(1)), ("s", "a", t(2)), ("u", "a", t(2))],
        [("s", "a", t(20)), ("s", "c", t(21)), ("u", "a", t(25.9))],
        [("s", "a", t(45.5)), ("s", "a", t(50)), ("u", "a", t(80))],
    ], schema, lambda e: keyed.first_edits(e.select("session_id", "file_path", "event_time")))
    hours = [[(s, p, round((ms / 1000 - 1_700_000_000) / HOUR, 1)) for s, p, ms in b] for b in got]
    assert hours[0] == [("s", "a", 0.0), ("s", "b", 1.0), ("u", "a", 2.0)]
    assert hours[1] == [("s", "c", 21.0)]  # within a day of the last edit nothing is forgotten
    assert hours[2] == [("s", "a", 45.5), ("u", "a", 80.0)]  # more than 24 hours of silence


def test_sessions_keep_drift_and_compactions(spark, tmp_path):
    schema = "session_id string, event_time timestamp, `order` long, kind string, point_id string, tokens long, query array<double>"
    t = lambda m: spark.range(1).select(F.timestamp_seconds(F.lit(1_700_000_000 + m * 60)).alias("t")).first().t
    give = lambda m, p, n=10: ("s", t(m), m, "inject", p, n, None)
    got = batches(spark, tmp_path, [
        [give(1, "a"), give(2, "b"), give(3, "a"), ("s", t(4), 4, "query", None, None, [1.0, 0.0])],
        [("s", t(5), 5, "query", None, None, [1.0, 1.0]), ("s", t(6), 6, "compact", None, None, None), give(7, "a")],
        [("s", t(60 * 40), 8, "query", None, None, [0.0, 1.0]), give(60 * 40 + 1, "z", 7)],
    ], schema, keyed.sessions, "update")
    assert got[0] == [("s", 2, 20, 1, 0, 0.5)]
    assert got[1] == [("s", 1, 30, 2, 1, pytest.approx(1 - 1 / math.sqrt(2)))]
    assert got[2] == [("s", 1, 7, 1, 0, 0.5)]


# Entropy
def naive_entropy(t):
    found = set()
    for run in scan._RUN.finditer(t):
        r = run.group(0)
        least = scan.HEX_BITS if scan._HEX.fullmatch(r) else scan.BITS
        good = [i for i in range(len(r) - scan.WINDOW + 1) if -sum(n / scan.WINDOW * math.log2(n / scan.WINDOW) for n in Counter(r[i : i + scan.WINDOW]).values()) >= least - 1e-9]
        marks = sorted({run.start() + j for i in good for j in range(i, i + scan.WINDOW)})
        while marks:
            k = next((n for n in range(1, len(marks)) if marks[n] != marks[n - 1] + 1), len(marks))
            a, b = marks[0], marks[k - 1] + 1
            if any(c.isdigit() for c in t[a:b]) and any(c.isalpha() for c in t[a:b]):
                found.add((a, b))
            marks = marks[k:]
    return found


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["plain words here ", "aaaaaaaaaaaaaaaaaaaaaaaa", "Qx7Zp2Lm9Rt4Vw8Ks1Ny6Bd", "deadbeef0123456789abcdef", " ", "x", "=", "Hg5Jk3", "theseareonlylettersinarow", "\n", "é"]), max_size=10))
def test_entropy_places_equal_a_plain_version(parts):
    t = "".join(parts)
    assert {(f[1], f[2]) for f in scan.high_entropy(t)} == naive_entropy(t)


@given_tables
def test_entropy_over_whole_documents_and_in_strict_mode(spark):
    import base64
    from hashlib import sha256

    key = lambda i: base64.b64encode(sha256(str(i).encode()).digest()).decode()
    rows = {r.doc_id: (r.content + (" " + key(r.doc_id) if r.doc_id % 4 == 1 else ""), r.source_type) for r in tables.exposed(spark, FOLDER).collect()}
    got = {}
    for r in catalog.queries()["X5_entropy_places"](spark, FOLDER).collect():
        got.setdefault(r.doc_id, set()).add((r.start, r.end))
        assert rows[r.doc_id][0][r.start : r.end] == r.text
    assert got == {i: x for i, (t, _) in rows.items() if (x := naive_entropy(t))}
    actions = {r.doc_id: r.action for r in catalog.queries()["X9_strict_scan"](spark, FOLDER).collect()}
    for i, (t, kind) in rows.items():
        if kind == "jira":
            assert actions[i] == "passed"
        elif i % 2 and naive_entropy(t):
            assert actions[i] == "blocked"
    assert "blocked" in actions.values() and "masked" in actions.values()


# Phrases
@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*classify.DECISION_PHRASES[:6], *classify.PRACTICE_PHRASES[:6], "Best Practice", "x", " ", "WHY did", "é", "how"]), max_size=6))
def test_first_phrases_equal_a_scan_of_the_lists(parts):
    lists = {"a": classify.DECISION_PHRASES, "b": classify.PRACTICE_PHRASES, "c": classify.WHY, "d": ["how", "ow", "h"]}
    t = " ".join(parts)
    assert phrases.Phrases(lists).first(t) == [next((p for p in ps if p in t.lower()), None) for ps in lists.values()]


def test_triggers_of_null_and_empty_texts(spark):
    d = spark.createDataFrame([(None,), ("",), ("Why did we",)], "t string").select(classify.triggers(F.col("t")).alias("p"))
    assert [(r.p.decision, r.p.why) for r in d.collect()] == [(None, None), (None, None), ("why did we", "why did")]


# Counters
def test_ranges_of_counters_equal_a_plain_version(spark):
    rng = random.Random(3)
    rows, span = [], 100
    for k in range(4):
        t, v = 0, 0.0
        for _ in range(60):
            t, v = t + rng.randint(1, 40), rng.choice([v, v + rng.randint(0, 9), float(rng.randint(0, 3))])
            rows.append((k, t, v))
    got = {(r.k, r.t): r for r in stats.over_range(spark.createDataFrame(rows, "k int, t long, v double"), ["k"], "t", "v", span).collect()}
    for k, t, _ in rows:
        s = [(b, v) for a, b, v in rows if a == k and t - span < b <= t]
        r = got[k, t]
        assert r.changes == sum(a[1] != b[1] for a, b in zip(s, s[1:], strict=False))
        if len(s) < 2:
            assert r.increase is None and r.rate is None
            continue
        raw = sum(b[1] - a[1] if b[1] >= a[1] else b[1] for a, b in zip(s, s[1:], strict=False))
        apart, before, width = (t - s[0][0]) / (len(s) - 1), s[0][0] - (t - span), t - s[0][0]
        reach = before if before < apart * 1.1 else apart / 2
        if raw > 0:
            reach = min(reach, width * s[0][1] / raw)
        assert r.increase == pytest.approx(raw * (width + reach) / width) and r.rate == pytest.approx(r.increase / span)


# Versions of chunks
def test_chunks_over_four_cycles(spark):
    trees = [{"a": "1\n2", "b": "x"}, {"a": "1\n3", "b": "x", "c": "y"}, {"a": "1\n3"}, {"a": "1\n3", "b": "x", "c": ""}]
    state = spark.createDataFrame([], blobs.STATE)
    done = []
    for n, tree in enumerate(trees, 1):
        t = spark.createDataFrame([(p, str(hash(c)), c) for p, c in tree.items()], "file_path string, blob_hash string, content string")
        done.append({r.file_path: r.action for r in blobs.actions(state, t).collect()})
        rows = blobs.merged(state, t, F.when(F.col("content") != "", F.split("content", "\n")).otherwise(F.array().cast("array<string>")), F.lit(n).cast("long")).collect()
        state = spark.createDataFrame(rows, blobs.STATE)
    assert done == [{"a": "insert", "b": "insert"}, {"a": "supersede", "b": "touch", "c": "insert"}, {"a": "touch", "b": "close", "c": "close"}, {"a": "touch", "b": "insert", "c": "insert"}]
    current = sorted((r.file_path, r.version, r.chunk_index, r.total_chunks, r.content, r.synced_at) for r in state.filter("is_current").collect())
    assert current == [("a", 2, 0, 2, "1", 4), ("a", 2, 1, 2, "3", 4), ("b", 2, 0, 1, "x", 4)]
    assert state.filter("NOT is_current").count() == 4 and blobs.merged(spark.createDataFrame([], blobs.STATE), t.limit(0), F.array("content"), F.lit(1).cast("long")).count() == 0


# Ground truth
def test_tiers_follow_the_text_of_a_file(spark):
    m = spark.createDataFrame([("p1", "c", "a.py", "h1", 0), ("p2", "c", "a.py", None, 0), ("p3", "c", "gone.py", "h", 0)], "point_id string, collection string, file_path string, blob_hash string, s int").withColumn("stored_at", F.timestamp_seconds("s"))
    none = spark.createDataFrame([], "commit_id long, committed_at timestamp, files_changed array<string>, is_current boolean")
    tiers = lambda h: {r.point_id: r.tier for r in freshness.scanned(m, spark.createDataFrame([("a.py", h)], "file_path string, blob_hash string"), none).collect()}
    assert tiers("h1") == {"p1": "fresh", "p2": "fresh", "p3": "unknown"}
    assert tiers("h2") == {"p1": "expired", "p2": "fresh", "p3": "unknown"}


# Templates
def test_eval_needs_a_warning_near_it(spark):
    said = ["Never use eval(x)", "Do not call eval(x) here", "Use eval(x) for speed", "avoid " + "x" * 40 + " eval(x)", "use eval(x), not exec", "Don't: EVAL(x)", "instead of eval( use literal_eval(", None, "no such call"]
    d = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string").select("i", validation.unwarned_eval(F.col("s")).alias("v")).orderBy("i")
    assert [r.v for r in d.collect()] == [False, False, True, True, True, False, False, None, False]  # ten characters after it are looked at


def test_templates_are_made_plain(spark):
    d = spark.createDataFrame([("  Prefer short functions. ", " Python", None, None, ["A", "a ", "b"], " https://x.example/y "), ("short", "p", "x", "y", ["q;"] * 11, "ftp://x")], "c string, d string, k string, i string, t array<string>, s string")
    a, b = [r.r for r in d.select(validation.template_report(*(F.col(n) for n in "cdkits")).alias("r")).collect()]
    assert a.valid and (a.content, a.domain, a.type, a.importance, a.tags, a.source) == ("Prefer short functions.", "python", "guideline", "medium", ["a", "b"], "https://x.example/y")
    assert b.errors == ["content:short", "domain:short", "type:unknown", "importance:unknown", "tags:many", "tags:signs", "source:address"]


# Errors, projects, files that are read
def test_listings_are_no_errors(spark):
    rows = [(None, "src/error-handling.md\ndocs/FAILED.txt\n"), (0, "Error: No module named 'x'"), (1, "ok"), (0, "ok"), (None, "Traceback (most recent call last):\n  File foo.py\nTypeError: x"), (None, None), (0, "bash: foo: command not found"), (None, "")]
    d = spark.createDataFrame(rows, "code int, out string").select(errors.is_error(F.col("code"), F.col("out")).alias("e"))
    assert [r.e for r in d.collect()] == [False, True, True, False, True, False, True, False]


def test_places_in_three_forms(spark):
    out = 'tests/test_foo.py:25\nsrc/main.py:142:8\n  File "script.py", line 42\n    at module.py:156\ntests/test_foo.py:25'
    r = spark.createDataFrame([(out,), ("none",)], "o string").select(errors.references(F.col("o")).alias("r")).collect()
    assert [tuple(x) for x in r[0].r] == [("tests/test_foo.py", 25, None), ("src/main.py", 142, 8), ("module.py", 156, None), ("script.py", 42, None)] and r[1].r == []


def test_projects_of_folders(spark):
    rows = [("My App", "/x", None), (None, "/", None), (None, "/home/u", None), (None, "/tmp/build-3", None), (None, "/tmp/pytest-0/my-project", None), (None, "/tmp/mine", None), (" ", "/srv/x", "https://git.example.org/Org/Repo.git"), (None, None, None)]
    d = spark.createDataFrame(rows, "n string, f string, r string").select(text.project(F.col("n"), F.col("f"), F.lit("/home/u"), F.col("r")).alias("p"))
    assert [r.p for r in d.collect()] == ["my-app", "root-project", "home-project", "temp-project", "my-project", "mine", "org/repo", "unknown-project"]


def test_read_context(spark):
    d = spark.createDataFrame([("src/memory/storage.py",), ("README.md",), ("Makefile",), ("x/api",), ("a/docker/Dockerfile.x",)], "p string").select(classify.read_context(F.col("p")).alias("c"))
    got = [r.c and tuple(r.c) for r in d.collect()]
    assert got == [("py", "memory", "Best practices for Python files in memory component"), ("md", "", "Best practices for Markdown files"), None, None, ("x", "Dockerfile.x", "Best practices for X files in Dockerfile.x component")]


# Embeddings, tokens, purge
@given_tables
def test_exact_tokens_are_those_of_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(tables.tokenizer_file())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = {r.doc_id: r.tokens for r in catalog.queries()["C16_exact_tokens"](spark, FOLDER).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}
    d = spark.createDataFrame([(None,), ("",)], "t string").select(chunking.exact_tokens(F.col("t"), tables.tokenizer_file()).alias("n"))
    assert [r.n for r in d.collect()] == [None, 0]


def test_purge_keeps_what_has_no_time_or_another_tenant(spark):
    rows = [(1, "a", "g", 0), (2, "a", "h", 0), (3, "b", "g", 0), (4, "a", "g", 99), (5, "a", "g", None), (6, "a", None, 0)]
    m = spark.createDataFrame(rows, "k int, collection string, group_id string, s int").withColumn("stored_at", F.timestamp_seconds("s"))
    left = lambda g: sorted(r.k for r in backfill.purged(m, ["a"], g, F.timestamp_seconds(F.lit(50))).collect())
    assert left("g") == [2, 3, 4, 5, 6] and left(None) == [3, 4, 5]


def test_code_too_deep_for_the_parser_is_cut_by_lines():
    deep = "x = " + "(" * 5000 + "1" + ")" * 5000
    assert chunking.python_chunks(deep) == [deep] and chunking.python_symbols(deep) == [] and chunking.python_imports(deep) == []


def test_changes_since_over_days_equal_a_count_of_pairs(spark):
    rng = random.Random(6)
    at = lambda: rng.choice([0, 86_399, 86_400, 86_401, rng.randrange(10 * 86_400)])
    commits = [(i, at(), rng.sample(["a", "b", "hot"], rng.randint(1, 2)) + ["hot"] * (i % 2), i % 7 != 0) for i in range(300)]
    memories = [(f"p{i}", rng.choice(["a", "b", "hot", "none"]), at()) for i in range(60)] + [("null", "a", None)]
    c = spark.createDataFrame(commits, "commit_id long, s long, files_changed array<string>, is_current boolean").withColumn("committed_at", F.timestamp_seconds("s"))
    m = spark.createDataFrame(memories, "point_id string, file_path string, s long").withColumn("stored_at", F.timestamp_seconds("s"))
    got = {r.point_id: r.commit_count for r in freshness.changes_since(m, c).collect()}
    assert got == {p: sum(cur and f in files and s is not None and t > s for _, t, files, cur in commits) for p, f, s in memories}
