"""Queries of chunkers, composers, sources, versions over time, streams and state machines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import chunking, classify, compose, errors, scan, text
from tessera.functions import code as structure
from tessera.operators import packing, search, stats, versions
from tessera.plans import tables
from tessera.plans.registry import query
from tessera.plans.tables import code, exposed, memories, prompts, queries_table, sessions, table
from tessera.sources import files
from tessera.sources.shared import shared_dir as _shared
from tessera.streaming import state


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    schema, path = table(spark, sf_dir, name).schema, spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(schema)
    return reader.parquet(f"{sf_dir}/{name}.parquet") if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all there is and reads what it wrote."""
    spark = stream.sparkSession
    out, at = _shared(spark, name), _shared(spark, f"{name}-checkpoint")
    if mode == "append":
        q = stream.writeStream.outputMode("append").option("checkpointLocation", at).trigger(availableNow=True).format("parquet").start(out)
    else:
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", at).trigger(availableNow=True).foreachBatch(lambda df, n: df.write.mode("append").parquet(f"{out}/batch={n}")).start()
    q.awaitTermination()
    schema = stream.schema if mode == "append" else T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(schema).parquet(out)


# Chunking and truncation
def _texts(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


@query("C1_chunk_router")
def router(spark, d):
    c = chunking.column(chunking.routed_chunks, "array<string>", F.col("content"), F.col("file_path"))
    return code(spark, d).select("doc_id", F.posexplode(c).alias("chunk_index", "chunk"))


@query("C4_prose_chunks")
def prose(spark, d):
    return _texts(spark, d).select("doc_id", F.posexplode(chunking.column(chunking.prose_chunks, "array<string>", F.col("text"))).alias("chunk_index", "chunk"))


@query("C5_sentences")
def sentences(spark, d):
    return _texts(spark, d).select("doc_id", F.posexplode(chunking.column(chunking.sentences, "array<string>", F.col("text"))).alias("i", "sentence"))


#: Suffixes of the texts of code(), one for each.
_SUFFIXES = [".py", ".py", ".py", ".py", ".py", ".py", ".js", ".md", ".py", ".go", ".sql", ".txt"]


def _by_structure(content: str, path: str) -> list[str]:
    """Chunks by definitions where the language is read so, and of what is too large, or another language, by windows of lines."""
    found = structure.chunks(content, path) if structure.language(path) else chunking.line_windows(content)
    return [p for c in found for p in chunking.sub_chunks(c)]


@query("C9_code_chunks")
def code_chunks(spark, d):
    path = F.concat(F.lit("src/f"), tables.pick(_SUFFIXES, F.col("doc_id")))
    return code(spark, d).select("doc_id", F.posexplode(chunking.column(_by_structure, "array<string>", F.col("content"), path)).alias("chunk_index", "chunk"))


@query("C12_line_windows")
def windows(spark, d):
    return _texts(spark, d).select("doc_id", F.posexplode(chunking.column(chunking.line_windows, "array<string>", F.col("text"))).alias("chunk_index", "chunk"))


@query("C15_trivial_chunk_filter", "SELECT doc_id, x AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) WHERE length(x) // 4 >= 5")
def trivial(spark, d):
    return _texts(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(text.estimated_tokens(F.col("line")) >= 5)


@query("C17_smart_end")
def smart_end(spark, d):
    return _texts(spark, d).select("doc_id", chunking.column(lambda t: chunking.end_at_sentence(t, 100), "string", F.col("text")).alias("cut"))


@query("C19_structured_truncate")
def structured(spark, d):
    return _texts(spark, d).select("doc_id", chunking.column(lambda t: chunking.structured(t[:80], t[80:160], t, 200), "string", F.col("text")).alias("cut"))


# Composition
_K = "vec_id"


@query("C30_tracker_issue", "SELECT point_id, '[PROJ-' || vec_id || '] ' || content || chr(10) || 'Type: ' || type || ' | Priority: ' || coalesce(source, 'None') || ' | Status: ' || coalesce(freshness_status, 'Unknown') || chr(10) || 'Reporter: ' || agent_id || ' | Assigned: ' || CASE WHEN vec_id % 2 = 0 THEN session_id ELSE 'Unassigned' END || chr(10) || 'Labels: ' || CASE WHEN vec_id % 3 = 0 THEN 'None' ELSE 'x, y' END || chr(10) || 'Created: 2026-02-01 | Updated: 2026-02-07' || chr(10) || chr(10) || 'Description:' || chr(10) || '(No description)' AS text FROM {memories}")
def tracker_issue(spark, d):
    v, n = F.col("vec_id"), F.lit(None).cast("string")
    labels = F.when(v % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("x"), F.lit("y")))
    return memories(spark, d).select("point_id", compose.tracker_issue(F.concat(F.lit("PROJ-"), v.cast("string")), F.col("content"), F.col("type"), F.col("source"), F.col("freshness_status"), F.col("agent_id"), F.when(v % 2 == 0, F.col("session_id")), labels, F.lit("2026-02-01T10:00:00.000+0000"), F.lit("2026-02-07T15:30:00.000+0000"), n).alias("text"))


@query("C31_tracker_comment", "SELECT point_id, '[PROJ-' || vec_id || '] ' || content || ' (' || type || ', ' || coalesce(source, 'None') || ', Open)' || chr(10) || chr(10) || 'Comment by ' || agent_id || ' (2026-02-07):' || chr(10) || 'body ' || label AS text FROM {memories}")
def tracker_comment(spark, d):
    return memories(spark, d).select("point_id", compose.tracker_comment(F.concat(F.lit("PROJ-"), F.col("vec_id").cast("string")), F.col("content"), F.col("type"), F.col("source"), F.lit("Open"), F.col("agent_id"), F.lit("2026-02-07T14:00"), F.concat(F.lit("body "), F.col("label").cast("string"))).alias("text"))


@query("C32_forge_documents", "SELECT point_id, 'Issue #' || vec_id || ': ' || content || CASE WHEN vec_id % 2 = 0 THEN chr(10) || chr(10) || 'a body' ELSE '' END || chr(10) || chr(10) || CASE WHEN vec_id % 3 = 0 THEN 'Labels: bug, ui | ' ELSE '' END || 'State: open' AS issue, 'CI ' || agent_id || ': ' || CASE WHEN vec_id % 5 = 0 THEN 'failure' ELSE 'success' END || chr(10) || 'Branch: main | Commit: ' || substr(md5(point_id), 1, 8) || CASE WHEN vec_id % 5 = 0 THEN chr(10) || 'Status: FAILED -- check workflow logs for details' ELSE '' END AS ci, 'Commit ' || substr(md5(point_id), 1, 8) || ': ' || content || chr(10) || 'Files: a.py, b.py' || chr(10) || 'Author: ' || agent_id AS commit FROM {memories}")
def forge(spark, d):
    v, none = F.col("vec_id"), F.array().cast("array<string>")
    sha = F.md5(F.encode("point_id", "UTF-8"))
    null = F.lit(None).cast("int")
    return memories(spark, d).select(
        "point_id", compose.forge_issue(v, F.col("content"), F.when(v % 2 == 0, "a body").otherwise(""), F.when(v % 3 == 0, F.array(F.lit("bug"), F.lit("ui"))).otherwise(none), none, F.lit(""), F.lit("open")).alias("issue"),
        compose.check_run(F.col("agent_id"), F.when(v % 5 == 0, "failure").otherwise("success"), F.lit("main"), sha).alias("ci"),
        compose.commit(sha, F.col("content"), F.col("agent_id"), null, null, null, F.array(F.lit("a.py"), F.lit("b.py"))).alias("commit"),
    )


@query("V24_chunks_by_offset", "SELECT doc_id, i, substr(text, i * 500 + 1, 500) AS piece FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 499) // 500)) AS i FROM documents)")
def by_offset(spark, d):
    n = F.ceil(F.length("text") / 500)
    return _texts(spark, d).filter(n > 0).select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("i"), "text").select("doc_id", "i", F.substr("text", (F.col("i") * 500 + 1).cast("int"), F.lit(500)).alias("piece"))


_PARTS = "list_filter(string_split(file_path, '/'), lambda p: p <> '')"
_FOLDER = "list_position(list_transform(" + _PARTS + f", lambda p: p IN {tuple(classify.COMPONENT_FOLDERS)}), true)"
_CALLED = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in classify.FILE_TYPES.items()) + " ELSE upper(kind) END"


@query("K9_read_context", f"SELECT doc_id, file_path, kind AS file_type, CASE WHEN kind IS NOT NULL THEN part END AS component, 'Best practices for ' || {_CALLED} || ' files' || CASE WHEN part <> '' THEN ' in ' || part || ' component' ELSE '' END AS question FROM (SELECT *, nullif(regexp_extract(file_path, '[^/.]\\.([^./]*)$', 1), '') AS kind, CASE WHEN f > 0 THEN coalesce(parts[f + 1], parts[f]) ELSE '' END AS part FROM (SELECT *, {_PARTS} AS parts, {_FOLDER} AS f FROM {{code}}))")
def read_context(spark, d):
    return code(spark, d).select("doc_id", "file_path", classify.read_context(F.col("file_path")).alias("c")).select("doc_id", "file_path", "c.file_type", "c.component", "c.question")


@query("X2_personal_patterns", "SELECT kind, replacement FROM (VALUES ('pii_email', '[EMAIL_REDACTED]'), ('pii_phone', '[PHONE_REDACTED]'), ('pii_ip', '[IP_REDACTED]'), ('pii_cc', '[CC_REDACTED]'), ('pii_ssn', '[SSN_REDACTED]'), ('pii_handle', '[HANDLE_REDACTED]'), ('pii_internal_url', '[INTERNAL_URL_REDACTED]')) v(kind, replacement)")
def patterns(spark, d):
    return spark.createDataFrame([(k, r) for k, _, r, _ in scan.PERSONAL], "kind string, replacement string")


@query("X7_segments", "SELECT doc_id, i, substr(text, i * 2000 + 1, 2000) AS segment FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 1999) // 2000)) AS i FROM documents)")
def segments(spark, d):
    n = F.ceil(F.length("text") / 2000)
    return _texts(spark, d).filter(n > 0).select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("i"), "text").select("doc_id", "i", F.substr("text", (F.col("i") * 2000 + 1).cast("int"), F.lit(2000)).alias("segment"))


_PLACES = ["tests/test_foo.py:25 failed", "src/main.py:142:8: bad", "  File \"script.py\", line 42, in f", "    at module.py:156", "nothing here", "a.ts:1 and a.ts:1 and b.go:7:3"]
_REFS = "list_transform(range(1, len(regexp_extract_all(o, {p}, 1)) + 1), lambda i: regexp_extract_all(o, {p}, 1)[i] || '|' || regexp_extract_all(o, {p}, 2)[i]::INT || '|' || coalesce(nullif({c}, ''), ''))"
_ALL_REFS = " || ".join(_REFS.format(p="'" + p + "'", c=f"regexp_extract_all(o, '{p}', 3)[i]") for p in errors.NAMED)


@query("H2_file_references", f"SELECT doc_id, array_to_string(list_transform(list_sort(list_distinct(list_transform(l, lambda x: {{'p': list_position(l, x), 'x': x}}))), lambda s: s.x), ',') AS places FROM (SELECT doc_id, {_ALL_REFS} AS l FROM (SELECT doc_id, {tables.pick_sql(_PLACES, 'doc_id')} || chr(10) || text AS o FROM documents))")
def references(spark, d):
    """Places that outputs name, in three forms: file, line, column."""
    output = F.concat(tables.pick(_PLACES, F.col("doc_id")), F.lit("\n"), "text")
    shown = F.transform(errors.references(output), lambda r: F.concat(r["file"], F.lit("|"), r["line"].cast("string"), F.lit("|"), F.coalesce(r["column"].cast("string"), F.lit(""))))
    return _texts(spark, d).select("doc_id", F.array_join(shown, ",").alias("places"))


@query("H3_error_document", "SELECT doc_id, '[error_pattern]' || chr(10) || 'Command: make' || chr(10) || 'Error: ' || left(prompt, 30) || chr(10) || 'Exit Code: ' || (doc_id % 3) || chr(10) || 'Output: ' || left(text, 500) AS document FROM {prompts}")
def error_document(spark, d):
    return prompts(spark, d).select("doc_id", compose.error_document(F.lit("make"), F.substring("prompt", 1, 30), F.col("doc_id") % 3, F.array().cast("array<string>"), F.col("text")).alias("document"))


@query("H10_session_context")
def session_context(spark, d):
    found = search.dense(memories(spark, d), queries_table(spark, d), 20, threshold=None)
    picked = packing.greedy(found, found.select("query_id").distinct().withColumn("budget", F.lit(30)), 0.0)
    kept = found.join(picked.select("query_id", F.explode("selected").alias("point_id")), ["query_id", "point_id"])
    return packing.rendered(kept, 0.9, 0.0, 200)


@query("P2_budget", "SELECT event_id, least(greatest(500 + floor(1000 * (least(value / 100, 1) * 0.5 + ((event_id % 11) / 10) * 0.3 + ((event_id % 7) / 7) * 0.2))::INT, 500), 1500) AS budget FROM events")
def budget(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select("event_id", packing.budget(F.least(F.col("value") / 100, F.lit(1.0)), e % 11 / 10, e % 7 / 7).alias("budget"))


# Sources and sinks
@query("S11_queue_source", "SELECT id::VARCHAR AS id, retry_count FROM {queue} WHERE id % 10 <> 0")
def queue_source(spark, d):
    out = _shared(spark, "queue")
    q = tables.queue(spark, d)
    line = F.when(F.col("id") % 10 == 0, F.lit('{"id": ')).otherwise(F.to_json(F.struct(F.col("id").cast("string").alias("id"), "failure_reason", "retry_count", "max_retries")))
    q.select(line.alias("value")).write.text(out)
    return files.retry_queue(spark, out).select("id", "retry_count")


@query("S12_audit_sink", f"SELECT point_id, substr(sha256(content), 1, 16) AS content_hash FROM {{memories}}")
def audit(spark, d):
    out = _shared(spark, "audit")
    files.append_audit(memories(spark, d).select("point_id", "content"), out)
    return spark.read.schema("point_id string, content_hash string").json(out)


@query("S16_transcript_source", "SELECT conv_id::VARCHAR AS session_id, count(*) AS turns FROM conversations GROUP BY 1")
def transcript(spark, d):
    out = _shared(spark, "transcript")
    c = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), "turn", "role", F.col("text").alias("content"))
    c.write.option("compression", "gzip").json(out)
    return files.transcript(spark, out).groupBy("session_id").agg(F.count(F.lit(1)).alias("turns"))


@query("S24_trace_sink", "SELECT event_id::VARCHAR AS trace_id, length(props) AS n FROM events WHERE event_type = 'error'")
def trace_sink(spark, d):
    out = _shared(spark, "traces")
    e = table(spark, d, "events").filter("event_type = 'error'").select(F.col("event_id").cast("string").alias("trace_id"), "event_type", F.col("props").alias("data"))
    files.write_traces(e, out)
    return spark.read.schema(files.TRACE_SCHEMA).json(out).select("trace_id", F.length("data").alias("n"))


@query("S28_backup_restore", "SELECT point_id, content FROM {memories}")
def backup(spark, d):
    out = _shared(spark, "backup")
    files.backup(memories(spark, d).select("point_id", "content"), out, "v1")
    return files.restore(spark, out, "v1")


@query("S31_partitioned_table", "SELECT point_id, label FROM {memories} WHERE collection = 'github' AND group_id = 'g2'")
def partitioned(spark, d):
    out = _shared(spark, "memories")
    files.store(memories(spark, d), out)
    return spark.read.parquet(out).filter("collection = 'github' AND group_id = 'g2'").select("point_id", "label")


# Versions over time
@query("G8_delete_and_insert", "SELECT conv_id, turn, 'new' AS state FROM conversations WHERE conv_id % 3 = 0 UNION ALL SELECT conv_id, turn, 'old' FROM conversations WHERE conv_id % 3 <> 0")
def delete_and_insert(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.lit("old").alias("state"))
    return versions.replaced(c, c.filter("conv_id % 3 = 0").withColumn("state", F.lit("new")), ["conv_id"])


@query("G9_cursor", "SELECT conv_id, max(ts) AS cursor FROM {sessions} GROUP BY 1")
def cursor(spark, d):
    return sessions(spark, d).groupBy("conv_id").agg(F.max("ts").cast("timestamp_ntz").alias("cursor"))


@query("B1_pending_backfill", "SELECT point_id, CASE WHEN vec_id % 6 = 0 THEN 'complete' ELSE 'unchanged' END AS status FROM {memories}")
def pending(spark, d):
    m = memories(spark, d).select("point_id", "vec_id", F.lit("unchanged").alias("status"))
    return versions.updated(m, m.filter("vec_id % 6 = 0").select("point_id", F.lit("complete").alias("status")), "point_id", ["status"]).select("point_id", "status")


# Streams and state machines
@query("T2_first_edits", "SELECT DISTINCT user_id::VARCHAR AS session_id, event_type AS file_path FROM events")
def first_edits(spark, d):
    e = _stream(spark, d, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("file_path"), F.col("ts").cast("timestamp").alias("event_time"))
    return _drained(state.first_edits(e, "60 days"), "first-edits").select("session_id", "file_path")


@query("T1_session_state", "SELECT user_id::VARCHAR AS session_id, count(DISTINCT event_type)::INT AS injected, count(DISTINCT event_type) * 10 AS tokens, 0 AS compactions FROM events GROUP BY 1")
def session_state(spark, d):
    e = _stream(spark, d, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("point_id"), F.lit("inject").alias("kind"), F.lit(10).alias("tokens"), F.col("ts").cast("timestamp").alias("event_time"))
    return _drained(state.sessions(e), "sessions", "update").groupBy("session_id").agg(F.max("injected").alias("injected"), F.max("tokens").alias("tokens"), F.max("compactions").alias("compactions"))


@query("T10_interval_metrics", "SELECT epoch(time_bucket(INTERVAL 1 DAY, ts))::BIGINT AS begin, event_type, count(*) AS n FROM events WHERE time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 MINUTE GROUP BY 1, 2")
def interval_metrics(spark, d):
    e = _stream(spark, d, "events").select("event_type", "value", F.col("ts").cast("timestamp").alias("event_time"))
    m = _drained(state.metrics(e, "1 day"), "metrics")
    return m.select(F.col("window.start").cast("long").alias("begin"), "event_type", "n")


@query("T3_token_bucket")
def bucket(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"), "event_id", F.lit(4.0).alias("tokens"))
    return state.bucket_steps(e, ["user_id"], "at", "tokens", rate=0.0001).groupBy("user_id").agg(F.count_if("allowed").cast("int").alias("allowed"), F.count(F.lit(1)).cast("int").alias("asked"))


@query("T4_dual_bucket")
def dual_bucket(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"), "event_id", F.lit(1.0).alias("tokens"), (F.col("event_id") % 5 + 1).cast("double").alias("size"))
    a = state.bucket_steps(e.select("user_id", "at", "event_id", "tokens"), ["user_id"], "at", "tokens", rate=0.0001).select("user_id", "n", F.col("allowed").alias("a"))
    b = state.bucket_steps(e.select("user_id", "at", "event_id", F.col("size").alias("tokens")), ["user_id"], "at", "tokens", rate=0.0005, burst=20.0).select("user_id", "n", F.col("allowed").alias("b"))
    return a.join(b, ["user_id", "n"]).groupBy("user_id").agg(F.count_if(F.col("a") & F.col("b")).cast("int").alias("allowed"))


@query("T5_circuit_breaker")
def circuit(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 20).alias("provider"), F.col("ts").cast("timestamp").alias("at"), "event_id", (F.col("event_type") != "error").alias("ok"))
    steps = state.circuit_steps(e, ["provider"], "at", "ok", failures=2, seconds=3600.0)
    return steps.groupBy("provider").agg(F.max_by("state", "n").alias("state"), F.count_if(F.col("met") == "open").cast("int").alias("refused"))


@query("T7_queue_batches", "SELECT CASE WHEN event_id % 4 <> 0 THEN 'done' WHEN (event_id // 3) % 5 + 1 >= 3 THEN 'dead' ELSE 'retry' END AS outcome, count(*) AS n FROM events GROUP BY 1")
def queue_batches(spark, d):
    out = {k: _shared(spark, k) for k in ("done", "dead", "retry")}
    q = tables.queue(spark, d)
    state.process_queue(q, lambda b: b.select("id", F.when(F.col("id") % 4 == 0, F.lit("failed")).alias("error")), out["done"], out["dead"], out["retry"])
    parts = [spark.read.parquet(p).select(F.lit(k).alias("outcome")) for k, p in out.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
