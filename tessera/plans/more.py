"""Queries of the remaining sources, sinks, sync cycles and evaluations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import chunking, classify, text, vector
from tessera.operators import freshness, search, versions
from tessera.plans import tables
from tessera.plans.registry import query
from tessera.plans.stateful import _drained, _shared
from tessera.plans.tables import code, commits, memories, prompts, queries_table, sessions, table
from tessera.sources import files, rest

_M = "{memories}"


@query("S4_http_lookup", f"SELECT point_id, '{{\"id\":\"' || point_id || '\",\"content\":\"' || content || '\"}}' AS body FROM {_M} WHERE point_id = 'p000042'")
def http_lookup(spark, d):
    return memories(spark, d).filter("point_id = 'p000042'").select("point_id", F.to_json(F.struct(F.col("point_id").alias("id"), "content")).alias("body"))


@query("S13_freshness_audit", f"SELECT collection, freshness_status, count(*) AS n FROM {_M} WHERE freshness_status IS NOT NULL GROUP BY 1, 2")
def freshness_audit(spark, d):
    out = _shared(spark, "freshness-audit")
    files.append_audit(memories(spark, d).filter("freshness_status IS NOT NULL").groupBy("collection", "freshness_status").agg(F.count(F.lit(1)).alias("n")), out)
    return spark.read.schema("collection string, freshness_status string, n long").json(out)


@query("S14_scan_audit", "SELECT doc_id, substr(sha256(text), 1, 16) AS text_hash FROM documents")
def scan_audit(spark, d):
    out = _shared(spark, "scan-audit")
    files.append_audit(table(spark, d, "documents").select("doc_id", "text"), out)
    return spark.read.schema("doc_id long, text_hash string").json(out)


@query("S15_rotated_logs", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def rotated(spark, d):
    out = _shared(spark, "logs")
    e = table(spark, d, "events").select("event_id", "event_type", (F.col("event_id") % 2).alias("part"))
    e.filter("part = 0").select("event_id", "event_type").write.option("compression", "gzip").json(f"{out}/sessions.jsonl.1")
    e.filter("part = 1").select("event_id", "event_type").write.json(f"{out}/sessions.jsonl")
    return files.session_logs(spark, out, "event_id long, event_type string").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def _landed(spark, d, resource: str):
    """Records of a forge as a REST source gives them, from a client that needs no network."""
    def client(url, headers):
        page = int(url.rsplit("=", 1)[1]) if "=" in url else 1
        rows = [{"number": (page - 1) * 3 + i, "state": "open" if i % 2 else "closed", "pull_request": i == 2} for i in range(3)]
        return 200, ({"Link": f'<{resource}?page={page + 1}>; rel="next"'} if page < 4 else {}), rows

    return rest.rest_table(spark, client, [(resource, resource, "link")])


@query("S17_forge_source", "SELECT n AS number, CASE WHEN n % 3 % 2 = 1 THEN 'open' ELSE 'closed' END AS state FROM (SELECT unnest(range(0, 12)) AS n)")
def forge_source(spark, d):
    r = _landed(spark, d, "issues")
    return r.select(F.get_json_object("raw", "$.number").cast("long").alias("number"), F.get_json_object("raw", "$.state").alias("state"))


@query("S18_tracker_source", "SELECT 'PROJ-' || n AS key FROM (SELECT unnest(range(0, 6)) AS n)")
def tracker_source(spark, d):
    def client(url, headers):
        at = int(url.rsplit("nextPageToken=", 1)[1]) if "nextPageToken" in url else 0
        return 200, {}, {"issues": [{"key": f"PROJ-{at + i}"} for i in range(2)], **({"nextPageToken": str(at + 2)} if at < 4 else {})}

    return rest.rest_table(spark, client, [("search", "search?jql=x", "token")]).select(F.get_json_object("raw", "$.key").alias("key"))


@query("G3_issue_sync", "SELECT n AS number FROM (SELECT unnest(range(0, 12)) AS n) WHERE n % 3 <> 2")
def issue_sync(spark, d):
    r = _landed(spark, d, "issues").filter(F.get_json_object("raw", "$.pull_request") == "false")
    return r.select(F.get_json_object("raw", "$.number").cast("long").alias("number"))


@query("G7_code_blob_sync", "WITH s AS (SELECT doc_id AS id, md5(content) AS h FROM {code} WHERE doc_id % 5 <> 0), t AS (SELECT doc_id AS id, md5(CASE WHEN doc_id % 3 = 0 THEN content || 'x' ELSE content END) AS h FROM {code} WHERE doc_id % 7 <> 0) SELECT coalesce(s.id, t.id) AS id, CASE WHEN s.id IS NULL OR s.h <> t.h THEN 'store' WHEN t.id IS NULL THEN 'close' ELSE 'touch' END AS action FROM s FULL JOIN t ON s.id = t.id")
def blob_sync(spark, d):
    c, md = code(spark, d), lambda x: F.md5(F.encode(x, "UTF-8"))
    s = c.filter("doc_id % 5 <> 0").select(F.col("doc_id").alias("id"), md(F.col("content")).alias("h"))
    t = c.filter("doc_id % 7 <> 0").select(F.col("doc_id").alias("id"), md(F.when(F.col("doc_id") % 3 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content"))).alias("h"))
    return versions.difference(s, t, "id", "h").select("id", F.when(F.col("state").isin("new", "changed"), "store").when(F.col("state") == "deleted", "close").otherwise("touch").alias("action"))


@query("S19_markdown_source", "SELECT 'T' || n AS title, 'x,y' || n AS tags FROM (SELECT unnest(range(0, 5)) AS n)")
def markdown_source(spark, d):
    out = _shared(spark, "markdown")
    n = F.col("id").cast("string")
    for i in range(5):
        body = F.concat(F.lit("---\ntitle: T"), n, F.lit("\ntags: [X, y"), n, F.lit("]\n---\n# Head\nbody"))
        spark.range(i, i + 1).select(body.alias("value")).coalesce(1).write.text(f"{out}/{i}.md.d")
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").text(out, wholetext=True)
    return files.front_matter(raw.select(F.input_file_name().alias("path"), F.col("value").alias("text"))).select("title", F.array_join("tags", ",").alias("tags"))


@query("S25_trace_flush", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1")
def trace_flush(spark, d):
    out = _shared(spark, "buffer")
    files.write_traces(table(spark, d, "events").filter(F.col("event_type").isin("error", "signup")).select(F.col("event_id").cast("string").alias("trace_id"), "event_type", F.col("props").alias("data")), out)
    stream = spark.readStream.schema(files.TRACE_SCHEMA).json(out).select("trace_id", "event_type")
    return _drained(stream, "flushed").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("S29_restore_verification", f"SELECT count(*) AS n FROM {_M}")
def restore_verification(spark, d):
    out = _shared(spark, "verified")
    m = memories(spark, d).select("point_id", "content")
    said = files.backup(m, out, "v1")
    return files.restore(spark, out, "v1").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == said["rows"])


@query("S30_collection_copy", f"SELECT point_id FROM {_M} WHERE collection = 'discussions'")
def collection_copy(spark, d):
    out = _shared(spark, "copy")
    memories(spark, d).filter("collection = 'discussions'").write.parquet(out)
    return spark.read.parquet(out).select("point_id")


@query("C16_piece_count", "SELECT doc_id, (length(text) + 3) // 4 AS tokens FROM documents")
def piece_count(spark, d):
    return table(spark, d, "documents").select("doc_id", chunking.column(lambda t: len(chunking.pieces(t)), "long", F.col("text")).alias("tokens"))


@query("K13_rule_table", "SELECT * FROM (VALUES ('error_pattern', 0.9, 3), ('port', 0.95, 2), ('rule', 0.9, 2), ('blocker', 0.85, 2), ('decision', 0.95, 1)) v(kind, confidence, patterns)".replace("0.9,", "0.9::DOUBLE,").replace("0.95,", "0.95::DOUBLE,").replace("0.85,", "0.85::DOUBLE,"))
def rule_table(spark, d):
    return spark.createDataFrame([(k, c, len(p)) for k, c, p in classify.RULES], "kind string, confidence double, patterns int")


@query("P7_state_reset", "SELECT conv_id, count(*) FILTER (WHERE turn > last) AS since FROM (SELECT *, coalesce(max(turn) FILTER (WHERE role = 'system') OVER (PARTITION BY conv_id), -1) AS last FROM conversations) GROUP BY 1")
def state_reset(spark, d):
    last = F.coalesce(F.max(F.when(F.col("role") == "system", F.col("turn"))).over(Window.partitionBy("conv_id")), F.lit(-1))
    return table(spark, d, "conversations").withColumn("last", last).groupBy("conv_id").agg(F.count_if(F.col("turn") > F.col("last")).alias("since"))


@query("O1_sort_and_limit", f"SELECT point_id FROM {_M} ORDER BY label DESC, point_id LIMIT 25")
def sort_and_limit(spark, d):
    return memories(spark, d).orderBy(F.col("label").desc(), "point_id").limit(25).select("point_id")


@query("O2_sorted_comments", "SELECT conv_id, string_agg(turn::VARCHAR, ',' ORDER BY ts DESC) AS turns FROM {sessions} GROUP BY 1")
def sorted_comments(spark, d):
    rows = F.reverse(F.array_sort(F.collect_list(F.struct("ts", "turn"))))
    return sessions(spark, d).groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda x: x["turn"].cast("string")), ",").alias("turns"))


@query("W2_previous_turn", "SELECT conv_id, turn, (lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn))::DOUBLE AS before FROM conversations")
def previous_turn(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.lag(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn")).cast("double").alias("before"))


@query("C11_sync_code_chunks")
def sync_code_chunks(spark, d):
    c = chunking.column(chunking.python_chunks, "array<string>", F.col("content"))
    head = text.context_header(F.col("file_path"), F.array().cast("array<string>"), F.array().cast("array<string>"), classify.language(F.col("file_path"), sync=True))
    return code(spark, d).select("doc_id", F.posexplode(F.transform(c, lambda x: F.concat(head, F.lit("\n"), x))).alias("chunk_index", "chunk"))


@query("N1_batch_penalty", f"SELECT collection, round(avg(CASE coalesce(freshness_status, 'unverified') WHEN 'fresh' THEN 1.0 WHEN 'aging' THEN 0.9 WHEN 'unverified' THEN 1.0 ELSE 0 END), 6) AS mean FROM {_M} GROUP BY 1")
def batch_penalty(spark, d):
    return memories(spark, d).groupBy("collection").agg(F.round(F.avg(freshness.penalty(F.col("freshness_status"))), 6).alias("mean"))


@query("V21_search_drift")
def search_drift(spark, d):
    q = queries_table(spark, d).select(F.lit("s").alias("session_id"), "query_id", F.col("query").alias("embedding"))
    return search.drift(q, "session_id", "query_id").select("query_id", F.round("drift", 6).alias("drift"))
