"""Queries of scans, predicates, joins, aggregates, windows, deduplication, freshness, packing and versions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import classify, errors, text, validation, vector
from tessera.operators import backfill, dedup, freshness, packing, search, stats, versions
from tessera.plans import tables
from tessera.plans.registry import query
from tessera.plans.tables import NOW, code, commits, memories, prompts, queries_table, queue, sessions, table

_M = "{memories}"
_SQLNOW = f"TIMESTAMP '{NOW}'"


def _now():
    return F.timestamp_seconds(F.lit(1709251200))


def _filter(name: str, where: str, condition) -> None:
    query(name, f"SELECT point_id FROM {_M} WHERE {where}")(lambda spark, d: memories(spark, d).filter(condition()).select("point_id"))


# Scans and sinks
@query("S1_scroll_scan", f"SELECT point_id, file_path, freshness_status FROM {_M} WHERE collection = 'code-patterns'")
def scroll(spark, d):
    return memories(spark, d).filter("collection = 'code-patterns'").select("point_id", "file_path", "freshness_status")


@query("S2_most_recent", f"SELECT point_id, 1.0::DOUBLE AS score FROM {_M} WHERE collection = 'discussions' AND group_id = 'g3' ORDER BY stored_at DESC, point_id LIMIT 10")
def recent(spark, d):
    return memories(spark, d).filter("collection = 'discussions' AND group_id = 'g3'").orderBy(F.col("stored_at").desc(), "point_id").limit(10).select("point_id", F.lit(1.0).alias("score"))


@query("S3_point_lookup", f"SELECT point_id, content, collection FROM {_M} WHERE point_id = 'p000042'")
def lookup(spark, d):
    return memories(spark, d).filter("point_id = 'p000042'").select("point_id", "content", "collection")


@query("S5_substring_scan", f"SELECT point_id FROM (SELECT * FROM {_M} ORDER BY point_id LIMIT 100) WHERE contains(lower(content), 'label 3') ORDER BY point_id LIMIT 10")
def substring(spark, d):
    return memories(spark, d).orderBy("point_id").limit(100).filter(F.contains(F.lower("content"), F.lit("label 3"))).orderBy("point_id").limit(10).select("point_id")


@query("S6_upsert", f"SELECT point_id, content, CASE WHEN vec_id % 10 = 0 THEN 1 ELSE 0 END AS updated FROM (SELECT point_id, vec_id, CASE WHEN vec_id % 10 = 0 THEN 'new ' || content ELSE content END AS content FROM {_M})")
def upsert(spark, d):
    m = memories(spark, d).select("point_id", "vec_id", "content", F.lit(0).alias("updated"))
    incoming = m.filter("vec_id % 10 = 0").withColumn("content", F.concat(F.lit("new "), F.col("content"))).withColumn("updated", F.lit(1))
    return versions.replaced(m, incoming, ["point_id"]).select("point_id", "content", "updated")


@query("S7_batch_store", f"SELECT min(point_id) AS point_id, group_id, sha256(content) AS content_hash FROM {_M} GROUP BY group_id, sha256(content)")
def batch(spark, d):
    m = memories(spark, d).withColumn("content_hash", text.content_hash(F.col("content")))
    return dedup.first_of_each(m, ["group_id", "content_hash"], ["point_id"]).select("point_id", "group_id", "content_hash")


@query("S8_payload_update", f"SELECT point_id, CASE WHEN label = 3 THEN 'stale' ELSE freshness_status END AS freshness_status FROM {_M}")
def payload(spark, d):
    m = memories(spark, d).select("point_id", "label", "freshness_status")
    updates = m.filter("label = 3").select("point_id", F.lit("stale").alias("freshness_status"))
    return versions.updated(m, updates, "point_id", ["freshness_status"]).select("point_id", "freshness_status")


@query("S9_delete_by_id", f"SELECT point_id FROM {_M} WHERE NOT (collection = 'jira-data' AND vec_id % 3 = 0)")
def delete(spark, d):
    m = memories(spark, d)
    return m.join(m.filter("collection = 'jira-data' AND vec_id % 3 = 0").select("point_id"), "point_id", "left_anti").select("point_id")


@query("S10_purge_older", f"SELECT collection, count(*) AS purgeable, min(stored_at) AS oldest FROM {_M} WHERE stored_at < {_SQLNOW} - INTERVAL 30 DAY GROUP BY 1")
def purge(spark, d):
    days = text.duration_days(F.lit("30d"))
    cutoff = F.timestamp_micros(F.unix_micros(_now()) - days.cast("long") * 86_400_000_000)
    return memories(spark, d).filter(F.col("stored_at") < cutoff).groupBy("collection").agg(F.count(F.lit(1)).alias("purgeable"), F.min("stored_at").cast("timestamp_ntz").alias("oldest"))


@query("S10_purge_applied", f"SELECT point_id, collection FROM {_M} WHERE NOT (collection IN ('discussions', 'github') AND group_id = 'g3' AND stored_at < {_SQLNOW} - INTERVAL 14 DAY)")
def purge_applied(spark, d):
    days = text.duration_days(F.lit("2w"))
    cutoff = F.timestamp_micros(F.unix_micros(_now()) - days.cast("long") * 86_400_000_000)
    return backfill.purged(memories(spark, d), ["discussions", "github"], "g3", cutoff).select("point_id", "collection")


@query("S22_seed_new_hashes", "SELECT doc_id FROM {prompts} WHERE prompt NOT IN (SELECT prompt FROM {prompts} WHERE doc_id < 10)")
def seed(spark, d):
    p = prompts(spark, d).withColumn("h", text.content_hash(F.col("prompt")))
    return p.join(p.filter("doc_id < 10").select("h").distinct(), "h", "left_anti").select("doc_id")


@query("S26_keep_last", "SELECT event_id FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 500")
def keep_last(spark, d):
    return table(spark, d, "events").select("event_id", "ts").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(500).select("event_id")


@query("S27_paired_log_lines", "SELECT conv_id, turn, nxt AS full_content FROM (SELECT *, lead(role) OVER w AS r, lead(length(text)) OVER w AS nxt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r = 'assistant'")
def paired(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    s = table(spark, d, "conversations").withColumn("r", F.lead("role").over(w)).withColumn("full_content", F.lead(F.length("text")).over(w))
    return s.filter("role = 'user' AND r = 'assistant'").select("conv_id", "turn", "full_content")


# Predicates
_filter("F1_equality", "group_id = 'g1' AND agent_id = 'a2'", lambda: search.Filters(group_id="g1", agent_id="a2").condition())
_filter("F2_type_in", "type IN ('rule', 'guideline')", lambda: search.Filters(types=("rule", "guideline")).condition())
_filter("F3_type_not_in", "coalesce(type NOT IN ('rule', 'session'), true)", lambda: search.Filters(not_types=("rule", "session")).condition())
_filter("F4_not_expired", "collection = 'code-patterns' AND coalesce(freshness_status <> 'expired', true)", lambda: search.Filters("code-patterns").condition())
_filter("F5_current_source", "source = 'github' AND is_current", lambda: search.Filters(source="github").condition())
_filter("F6_author_or_reporter", "agent_id = 'a1' OR session_id = 's4'", lambda: (F.col("agent_id") == "a1") | (F.col("session_id") == "s4"))
_filter("F7_ranges", f"access_count >= 2 AND access_count < 4 AND stored_at < {_SQLNOW} - INTERVAL 20 DAY", lambda: (F.col("access_count") >= 2) & (F.col("access_count") < 4) & (F.col("stored_at") < _now() - F.expr("INTERVAL 20 DAY")))
_filter("F8_match_except", "freshness_status IS NOT NULL AND freshness_status NOT IN ('fresh', 'aging')", lambda: F.col("freshness_status").isNotNull() & ~F.col("freshness_status").isin("fresh", "aging"))
_filter("F24_confidence", "label / 10.0 >= 0.5", lambda: F.col("label") / 10.0 >= 0.5)
_filter("F25_issue_filters", "collection = 'jira-data' AND type = 'jira_issue' AND agent_id = 'a0'", lambda: (F.col("collection") == "jira-data") & (F.col("type") == "jira_issue") & (F.col("agent_id") == "a0"))
_filter("F26_forge_filters", "collection = 'github' AND type = 'github_pr' AND freshness_status = 'aging'", lambda: (F.col("collection") == "github") & (F.col("type") == "github_pr") & (F.col("freshness_status") == "aging"))
_filter("F11_project_cleanup", "group_id NOT IN ('g0', 'g6')", lambda: ~F.col("group_id").isin("g0", "g6"))


@query("F9_score_threshold", f"SELECT query_id, point_id FROM {_M} m, {{queries}} q WHERE list_cosine_similarity(m.embedding::DOUBLE[], q.query::DOUBLE[]) >= 0.2")
def threshold(spark, d):
    return search.scored(memories(spark, d), queries_table(spark, d), 0.2).select("query_id", "point_id")


@query("F10_session_log_filters", "SELECT event_id FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-10' AND value >= 20")
def logs(spark, d):
    return table(spark, d, "events").filter((F.col("event_type") == "view") & (F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")) & (F.col("value") >= 20)).select("event_id")


_TEXTS = ["Never use eval(x) on input", "Use eval( to run it quickly here", "a <script>alert</script> tag", "render {{ name }} here", "short", "Prefer small functions with names", "Some words that stand far from it, avoid this. And then much later comes eval(y)", "  Javascript:void is bad  "]
_DOMAINS, _TKINDS, _TIMPORT = ["Python ", "g", "docker", None], ["rule", None, "port", "essay"], ["high", None, "urgent", "low", "medium"]
_TAGS, _LINKS = ["A,a ,b", "x<y,z", None, "one", ",".join(f"t{i}" for i in range(11)), "L" * 51], ["https://a.example/x", None, "ftp://b.example", " http://c.example "]


def _templates(spark, d):
    """Templates of every fault, and whole texts as templates."""
    k = F.col("doc_id")
    body = F.when(k % 9 == 8, F.col("text")).otherwise(tables.pick(_TEXTS, k))
    return table(spark, d, "documents").select("doc_id", body.alias("content"), tables.pick(_DOMAINS, F.floor(k / 2)).alias("domain"), tables.pick(_TKINDS, F.floor(k / 3)).alias("type"), tables.pick(_TIMPORT, F.floor(k / 4)).alias("importance"), F.split(tables.pick(_TAGS, F.floor(k / 5)), ",").alias("tags"), tables.pick(_LINKS, F.floor(k / 7)).alias("source"))


_TPL = "(SELECT doc_id, CASE WHEN doc_id % 9 = 8 THEN text ELSE " + tables.pick_sql(_TEXTS, "doc_id") + " END AS content, " + ", ".join(f"{tables.pick_sql(v, f'doc_id // {n}')} AS {c}" for c, v, n in (("domain", _DOMAINS, 2), ("type", _TKINDS, 3), ("importance", _TIMPORT, 4), ("rawtags", _TAGS, 5), ("source", _LINKS, 7))) + " FROM documents)"
_PLAIN = "coalesce(list_transform(string_split(rawtags, ','), lambda t: trim(lower(t))), [])"
_SAFE = "(" + " OR ".join("contains(near, '" + w.replace("'", "''") + "')" for w in validation.WARNED) + ")"
_FAULTS = [("coalesce(length(content), 0) < 10", "content:short"), ("length(content) > 2000", "content:long"), *((f"contains(lower(content), '{p}')", f"content:{p}") for p in validation.DANGEROUS), (f"pos > 0 AND NOT {_SAFE}", "content:eval("), ("coalesce(length(domain), 0) < 2", "domain:short"), ("length(domain) > 50", "domain:long"),
           ("type NOT IN ('rule', 'guideline', 'port', 'naming', 'structure')", "type:unknown"), ("importance NOT IN ('high', 'medium', 'low')", "importance:unknown"), ("len(string_split(rawtags, ',')) > 10", "tags:many"), ("len(list_filter(plain, lambda t: length(t) > 50)) > 0", "tags:long"), ("len(list_filter(plain, lambda t: regexp_matches(t, '[<>{};]'))) > 0", "tags:signs"),
           ("length(source) > 500", "source:long"), ("NOT regexp_matches(trim(source), '^https?://')", "source:address")]


@query("F15_template_validation", f"SELECT doc_id, concat_ws(',', {', '.join(f'CASE WHEN {c} THEN {chr(39)}{m}{chr(39)} END' for c, m in _FAULTS)}) AS errors, lower(trim(domain)) AS domain, coalesce(type, 'guideline') AS type, array_to_string(list_transform(list_sort(list_distinct(list_transform(plain, lambda t: {{'p': list_position(plain, t), 't': t}}))), lambda s: s.t), ',') AS tags FROM (SELECT *, substr(lower(content), greatest(pos - 30, 1), pos - greatest(pos - 30, 1) + 10) AS near FROM (SELECT *, strpos(lower(content), 'eval(') AS pos, {_PLAIN} AS plain FROM {_TPL}))")
def template_validation(spark, d):
    r = validation.template_report(*(F.col(c) for c in ("content", "domain", "type", "importance", "tags", "source")))
    return _templates(spark, d).select("doc_id", r.alias("r")).select("doc_id", F.array_join("r.errors", ",").alias("errors"), "r.domain", "r.type", F.array_join("r.tags", ",").alias("tags"))


@query("F22_trace_filter", "SELECT event_id FROM events WHERE event_type IN ('click', 'error') AND (user_id % 3 = 0 OR user_id % 5 = 0)")
def trace(spark, d):
    tags = F.array_compact(F.array(F.when(F.col("user_id") % 3 == 0, F.lit("t3")), F.when(F.col("user_id") % 5 == 0, F.lit("t5"))))
    return table(spark, d, "events").filter(F.col("event_type").isin("click", "error") & F.arrays_overlap(tags, F.array(F.lit("t3"), F.lit("t5")))).select("event_id")


@query("F23_deterministic_sample", "SELECT event_id FROM events WHERE ('0x' || substr(md5(event_id::VARCHAR), 1, 6))::BIGINT % 100 < 10")
def sampled(spark, d):
    h = F.conv(F.substring(F.md5(F.encode(F.col("event_id").cast("string"), "UTF-8")), 1, 6), 16, 10).cast("long")
    return table(spark, d, "events").filter(h % 100 < 10).select("event_id")


# Joins
@query("J1_ground_truth", f"WITH g AS (SELECT file_path, min(doc_id) AS blob FROM (SELECT doc_id, 'src/m' || (doc_id % 9) || '.py' AS file_path FROM documents) GROUP BY 1) SELECT point_id, blob IS NOT NULL AS known FROM {_M} LEFT JOIN g USING (file_path) WHERE collection = 'code-patterns'")
def ground_truth(spark, d):
    g = table(spark, d, "documents").select(F.concat(F.lit("src/m"), (F.col("doc_id") % 9).cast("string"), F.lit(".py")).alias("file_path"), "doc_id").groupBy("file_path").agg(F.min("doc_id").alias("blob"))
    return memories(spark, d).filter("collection = 'code-patterns'").join(g, "file_path", "left").select("point_id", F.col("blob").isNotNull().alias("known"))


_COUNTS = f"SELECT m.point_id, any_value(m.collection) AS collection, any_value(vec_id) AS vec_id, count(c.f) AS n FROM {_M} m LEFT JOIN (SELECT DISTINCT commit_id, committed_at, unnest(files_changed) AS f FROM {{commits}} WHERE is_current) c ON c.f = m.file_path AND c.committed_at > m.stored_at GROUP BY 1"


@query("J2_commits_since", f"SELECT point_id, n AS commit_count FROM ({_COUNTS})")
def commits_since(spark, d):
    return freshness.changes_since(memories(spark, d), commits(spark, d)).select("point_id", "commit_count")


_BLOBS = "SELECT doc_id % 55 AS k, md5(arg_max(text, doc_id)) AS newest, md5(arg_min(text, doc_id)) AS oldest FROM documents WHERE doc_id % 55 < 50 GROUP BY 1"
_TRUTH = f"SELECT c.*, newest IS NOT NULL AS known, CASE WHEN vec_id % 4 = 0 THEN oldest ELSE newest END = newest AS same FROM ({_COUNTS}) c LEFT JOIN ({_BLOBS}) b ON b.k = c.vec_id % 55"
_TIER = "CASE WHEN NOT known THEN 'unknown' WHEN NOT same THEN 'expired' WHEN n >= 25 THEN 'expired' WHEN n >= 10 THEN 'stale' WHEN n >= 3 THEN 'aging' ELSE 'fresh' END"


def _tiers(spark, d):
    """Files are documents: of each file the newest one is its blob now; every fourth memory was stored with the oldest. Some files are
    gone."""
    k = F.col("doc_id")
    path = F.concat(F.lit("src/m"), (k % 11).cast("string"), tables.pick(tables.EXTENSIONS, k))
    files = table(spark, d, "documents").filter(k % 55 < 50).groupBy(path.alias("file_path")).agg(*(F.md5(F.encode(f("text", "doc_id"), "UTF-8")).alias(n) for n, f in (("newest", F.max_by), ("oldest", F.min_by))))
    m = memories(spark, d).join(files, "file_path", "left").withColumn("blob_hash", F.when(F.col("vec_id") % 4 == 0, F.col("oldest")).otherwise(F.col("newest"))).drop("oldest", "newest")
    return freshness.scanned(m, files.select("file_path", F.col("newest").alias("blob_hash")), commits(spark, d))


@query("N1_freshness_scan", f"SELECT point_id, {_TIER} AS tier FROM ({_TRUTH})")
def scan(spark, d):
    return _tiers(spark, d).select("point_id", "tier")


@query("N2_tier_reason", f"SELECT point_id, CASE WHEN NOT known THEN 'no ground truth' WHEN NOT same THEN 'content changed' WHEN n >= 3 THEN n || ' changes since stored' ELSE n || ' changes, below the limit' END AS reason FROM ({_TRUTH})")
def reasons(spark, d):
    return _tiers(spark, d).select("point_id", "reason")


@query("N3_status_write_back", f"SELECT tier AS freshness_status, count(*) AS points FROM (SELECT {_TIER} AS tier FROM ({_TRUTH})) GROUP BY 1")
def write_back(spark, d):
    m = memories(spark, d).select("point_id", "freshness_status")
    return versions.updated(m, _tiers(spark, d).select("point_id", F.col("tier").alias("freshness_status")), "point_id", ["freshness_status"]).groupBy("freshness_status").agg(F.count(F.lit(1)).alias("points"))


@query("A6_tier_counts", f"SELECT collection, count(*) FILTER (WHERE t = 'fresh') AS fresh, count(*) FILTER (WHERE t = 'aging') AS aging, count(*) FILTER (WHERE t = 'stale') AS stale, count(*) FILTER (WHERE t = 'expired') AS expired, count(*) FILTER (WHERE t = 'unknown') AS unknown FROM (SELECT collection, {_TIER} AS t FROM ({_TRUTH})) GROUP BY 1")
def tier_counts(spark, d):
    return _tiers(spark, d).groupBy("collection").agg(*(F.count_if(F.col("tier") == t).alias(t) for t in ("fresh", "aging", "stale", "expired", "unknown")))


@query("N4_freshness_report", f"SELECT '| ' || collection || ' | ' || count(*) || ' | ' || count(*) FILTER (WHERE t = 'expired') || ' |' AS line FROM (SELECT collection, {_TIER} AS t FROM ({_TRUTH})) GROUP BY collection")
def report(spark, d):
    t = _tiers(spark, d).groupBy("collection").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("tier") == "expired").alias("e"))
    return t.select(F.concat(F.lit("| "), "collection", F.lit(" | "), F.col("n").cast("string"), F.lit(" | "), F.col("e").cast("string"), F.lit(" |")).alias("line"))


_STORED = "SELECT doc_id AS id, md5(text) AS h FROM documents WHERE doc_id % 5 <> 0"
_TREE = "SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN md5('x' || text) ELSE md5(text) END AS h FROM documents WHERE doc_id % 7 <> 0"


def _snapshots(spark, d):
    t = table(spark, d, "documents")
    md = lambda c: F.md5(F.encode(c, "UTF-8"))
    return t.filter("doc_id % 5 <> 0").select(F.col("doc_id").alias("id"), md(F.col("text")).alias("h")), t.filter("doc_id % 7 <> 0").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, md(F.concat(F.lit("x"), "text"))).otherwise(md(F.col("text"))).alias("h"))


@query("J3_tree_difference", f"SELECT coalesce(s.id, t.id) AS id, CASE WHEN s.id IS NULL THEN 'new' WHEN t.id IS NULL THEN 'deleted' WHEN s.h = t.h THEN 'unchanged' ELSE 'changed' END AS state FROM ({_STORED}) s FULL JOIN ({_TREE}) t ON s.id = t.id")
def tree(spark, d):
    return versions.difference(*_snapshots(spark, d), "id", "h")


@query("J4_deleted_files", f"SELECT id FROM ({_STORED}) WHERE id NOT IN (SELECT id FROM ({_TREE}))")
def deleted(spark, d):
    s, t = _snapshots(spark, d)
    return s.join(t, "id", "left_anti").select("id")




@query("J6_new_templates", "SELECT DISTINCT sha256(prompt) AS hash FROM {prompts} WHERE sha256(prompt) NOT IN (SELECT sha256(prompt) FROM {prompts} WHERE doc_id % 27 < 9)")
def new_templates(spark, d):
    p = prompts(spark, d).select("doc_id", text.content_hash(F.col("prompt")).alias("hash"))
    return p.select("hash").distinct().join(p.filter("doc_id % 27 < 9").select("hash").distinct(), "hash", "left_anti")


_VERSION_SQL = """WITH cur AS (SELECT o_orderkey AS item, md5(o_orderstatus || o_orderpriority) AS content_hash, (o_orderkey % 3 + 1)::INT AS version, o_orderkey % 4 <> 1 AS is_current, 100::BIGINT AS synced_at FROM orders WHERE o_orderkey % 5 <> 0),
inc AS (SELECT o_orderkey AS item, CASE WHEN o_orderkey % 7 = 0 THEN md5('c' || o_orderstatus) ELSE md5(o_orderstatus || o_orderpriority) END AS content_hash, 200::BIGINT AS synced_at FROM orders WHERE o_orderkey % 6 <> 0)
SELECT cur.item, cur.content_hash, cur.version, cur.is_current AND NOT coalesce(cur.is_current AND cur.content_hash <> inc.content_hash, false) AS is_current, CASE WHEN cur.is_current AND cur.content_hash = inc.content_hash THEN inc.synced_at ELSE cur.synced_at END AS synced_at, NULL::DOUBLE AS supersedes FROM cur LEFT JOIN inc USING (item)
UNION ALL SELECT inc.item, inc.content_hash, coalesce(c.version, 0) + 1, true, inc.synced_at, c.version::DOUBLE FROM inc LEFT JOIN (SELECT * FROM cur WHERE is_current) c USING (item) WHERE c.item IS NULL OR c.content_hash <> inc.content_hash"""


@query("G2_versioned_upsert", _VERSION_SQL)
def versioned(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderkey", "item")
    md = lambda *c: F.md5(F.encode(F.concat(*c), "UTF-8"))
    same = md("o_orderstatus", "o_orderpriority")
    cur = o.filter("item % 5 <> 0").select("item", same.alias("content_hash"), (F.col("item") % 3 + 1).cast("int").alias("version"), (F.col("item") % 4 != 1).alias("is_current"), F.lit(100).cast("long").alias("synced_at"), F.lit(None).cast("int").alias("supersedes"))
    inc = o.filter("item % 6 <> 0").select("item", F.when(F.col("item") % 7 == 0, md(F.lit("c"), "o_orderstatus")).otherwise(same).alias("content_hash"), F.lit(200).cast("long").alias("synced_at"))
    return versions.versioned_upsert(cur, inc, ["item"]).withColumn("supersedes", F.col("supersedes").cast("double"))


@query("J7_natural_key", "SELECT i.o_orderkey AS item, c.o_orderkey IS NOT NULL AS known FROM (SELECT * FROM orders WHERE o_orderkey % 6 <> 0) i LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 5 <> 0) c ON i.o_orderkey = c.o_orderkey AND i.o_custkey = c.o_custkey")
def natural(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = o.filter("o_orderkey % 5 <> 0").withColumn("_k", F.lit(True))
    return o.filter("o_orderkey % 6 <> 0").join(c, ["o_orderkey", "o_custkey"], "left").select(F.col("o_orderkey").alias("item"), F.col("_k").isNotNull().alias("known"))


@query("J8_merged_files", f"SELECT point_id FROM {_M} WHERE collection = 'code-patterns' AND file_path IN (SELECT unnest(files_changed) FROM {{commits}} WHERE commit_id % 97 = 0)")
def merged_files(spark, d):
    f = commits(spark, d).filter("commit_id % 97 = 0").select(F.explode("files_changed").alias("file_path")).distinct()
    return memories(spark, d).filter("collection = 'code-patterns'").join(f, "file_path", "left_semi").select("point_id")


@query("J10_issue_comments", "SELECT a.conv_id, count(b.turn) AS comments, max(b.turn) AS last_turn FROM (SELECT conv_id FROM conversations WHERE turn = 0) a JOIN (SELECT * FROM conversations WHERE turn > 0) b USING (conv_id) GROUP BY 1")
def issue_comments(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn")
    return c.filter("turn = 0").select("conv_id").join(c.filter("turn > 0"), "conv_id").groupBy("conv_id").agg(F.count("turn").alias("comments"), F.max("turn").alias("last_turn"))



@query("D4_cross_collection_check", f"SELECT a.point_id, a.collection, count(DISTINCT b.collection) AS others FROM {_M} a JOIN {_M} b ON a.content = b.content AND a.collection <> b.collection GROUP BY 1, 2")
def cross(spark, d):
    m = memories(spark, d).select("point_id", "collection", text.content_hash(F.col("content")).alias("h"))
    per = m.groupBy("h").agg(F.countDistinct("collection").alias("n"))
    return m.join(per.filter("n > 1"), "h").select("point_id", "collection", (F.col("n") - 1).alias("others"))


_ALL = classify.DECISION_PHRASES + classify.SESSION_PHRASES + classify.PRACTICE_PHRASES
_VALUES = ", ".join("({}, '{}')".format(i, p.replace("'", "''")) for i, p in enumerate(_ALL))


@query("J14_phrase_collisions", f"WITH p AS (SELECT * FROM (VALUES {_VALUES}) v(i, p)) SELECT a.p AS shorter, b.p AS longer FROM p a JOIN p b ON a.i <> b.i AND contains(b.p, a.p)")
def collisions(spark, d):
    p = spark.createDataFrame(list(enumerate(_ALL)), "i int, p string")
    a, b = p.select(F.col("i").alias("ai"), F.col("p").alias("shorter")), p.select(F.col("i").alias("bi"), F.col("p").alias("longer"))
    return a.join(F.broadcast(b), (F.col("ai") != F.col("bi")) & F.contains("longer", F.col("shorter"))).select("shorter", "longer")


# Aggregates
@query("A1_collection_stats", f"SELECT collection, group_id, count(*) AS points, max(stored_at) AS last_update FROM {_M} GROUP BY 1, 2")
def collection_stats(spark, d):
    return stats.collection_stats(memories(spark, d)).withColumn("last_update", F.col("last_update").cast("timestamp_ntz"))


@query("A2_distinct_values", f"SELECT DISTINCT type FROM {_M}")
def distinct(spark, d):
    return memories(spark, d).select("type").distinct().orderBy("type")


@query("A3_last_updated", f"SELECT max(stored_at) AS last FROM {_M} WHERE collection = 'github'")
def last(spark, d):
    return memories(spark, d).filter("collection = 'github'").agg(F.max("stored_at").cast("timestamp_ntz").alias("last"))


@query("A4_threshold_warnings", f"""WITH s AS (SELECT collection, group_id, count(*) AS points FROM {_M} GROUP BY 1, 2), t AS (SELECT collection, sum(points) AS points FROM s GROUP BY 1)
SELECT CASE WHEN points >= 300 THEN 'CRITICAL' ELSE 'WARNING' END || ': ' || collection || ' has ' || points || ' memories (threshold: ' || CASE WHEN points >= 300 THEN 300 ELSE 12 END || ')' AS warning FROM t WHERE points >= 12 UNION ALL SELECT 'WARNING: Project ''' || group_id || ''' has ' || points || ' memories' FROM s WHERE points >= 12""")
def threshold_warnings(spark, d):
    return stats.warnings(stats.collection_stats(memories(spark, d)), 12, 300)


@query("A5_zero_filled_counts", f"SELECT t.type, count(m.point_id) AS n FROM (SELECT unnest(['implementation', 'rule', 'port', 'naming', 'decision']) AS type) t LEFT JOIN {_M} m ON t.type = m.type AND m.collection = 'conventions' GROUP BY 1")
def zero_filled(spark, d):
    t = spark.createDataFrame([(x,) for x in ("implementation", "rule", "port", "naming", "decision")], "type string")
    n = memories(spark, d).filter("collection = 'conventions'").groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return t.join(n, "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("n"))


@query("A7_queue_stats", f"SELECT failure_reason, count(*) AS total, count(*) FILTER (WHERE retry_count < max_retries AND next_retry_at <= {_SQLNOW}) AS ready, count(*) FILTER (WHERE retry_count < max_retries AND next_retry_at > {_SQLNOW}) AS awaiting, count(*) FILTER (WHERE retry_count >= max_retries) AS exhausted FROM {{queue}} GROUP BY 1")
def queue_stats(spark, d):
    return stats.queue_stats(queue(spark, d), _now())


@query("A8_decay_distribution", f"SELECT least(floor(pow(0.5, floor((epoch_us({_SQLNOW}) - epoch_us(stored_at)) / 86400e6) / 21) / 0.2), 4)::BIGINT AS bucket, count(*) AS n FROM {_M} GROUP BY 1")
def decay_distribution(spark, d):
    days = F.floor(vector.age_days(F.col("stored_at"), _now())).cast("double")
    return memories(spark, d).groupBy(F.least(F.floor(vector.temporal(days, F.lit(21.0)) / 0.2), F.lit(4)).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


_SIMS = f"SELECT query_id, point_id, content, collection, type, freshness_status, sim AS score, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, point_id) AS rank FROM (SELECT q.query_id, m.*, list_cosine_similarity(m.embedding::DOUBLE[], q.query::DOUBLE[]) AS sim FROM {_M} m, {{queries}} q) QUALIFY rank <= 20"


def _found(spark, d):
    return search.dense(memories(spark, d), queries_table(spark, d), 20, threshold=None)


_BUDGET = "least(greatest(500 + floor(1000 * (0.5 * least(greatest(best, 0), 1) + 0.3 * density + 0.1))::INT, 500), 1500)"


@query("A9_adaptive_budget", f"SELECT query_id, {_BUDGET} AS budget FROM (SELECT query_id, max(score) AS best, avg((score >= 0.3)::INT) AS density FROM ({_SIMS}) GROUP BY 1)")
def adaptive_budget(spark, d):
    s = _found(spark, d).groupBy("query_id").agg(F.max("score").alias("best"), F.avg((F.col("score") >= 0.3).cast("int")).alias("density"))
    return s.select("query_id", packing.budget(F.col("best"), F.col("density"), F.lit(0.5)).alias("budget"))


@query("A12_best_below_one", f"SELECT query_id, round(max(score) FILTER (WHERE score < 0.999999), 6) AS best FROM ({_SIMS}) GROUP BY 1")
def best_below(spark, d):
    return _found(spark, d).groupBy("query_id").agg(F.round(F.max(F.when(F.col("score") < 0.999999, F.col("score"))), 6).alias("best"))


@query("A10_evaluator_summary", "SELECT event_type, count(*) AS fetched, count(*) FILTER (WHERE user_id % 2 = 0) AS sampled, count(*) FILTER (WHERE user_id % 2 = 0 AND value > 10) AS scored FROM events GROUP BY 1")
def evaluator_summary(spark, d):
    even = F.col("user_id") % 2 == 0
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("fetched"), F.count_if(even).alias("sampled"), F.count_if(even & (F.col("value") > 10)).alias("scored"))


@query("A11_sync_rollup", f"SELECT state, count(*) AS n FROM (SELECT CASE WHEN s.id IS NULL THEN 'new' WHEN t.id IS NULL THEN 'deleted' WHEN s.h = t.h THEN 'unchanged' ELSE 'changed' END AS state FROM ({_STORED}) s FULL JOIN ({_TREE}) t ON s.id = t.id) GROUP BY 1")
def rollup(spark, d):
    return tree(spark, d).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("A13_by_model", f"SELECT CASE WHEN collection = 'code-patterns' THEN 'code' ELSE 'prose' END AS model, count(*) AS n, sum(length(content))::BIGINT AS chars FROM {_M} GROUP BY 1")
def by_model(spark, d):
    return memories(spark, d).groupBy(F.when(F.col("collection") == "code-patterns", "code").otherwise("prose").alias("model")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"))


@query("A14_labelled_sums", "SELECT event_type, round(sum(value), 4) AS total, round(sum(value) / (SELECT sum(value) FROM events), 6) AS share, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def labelled_sums(spark, d):
    e = table(spark, d, "events")
    t = e.groupBy("event_type").agg(F.sum("value").alias("t"), F.countDistinct("user_id").alias("users"))
    return t.join(F.broadcast(t.agg(F.sum("t").alias("all")))).select("event_type", F.round("t", 4).alias("total"), F.round(F.col("t") / F.col("all"), 6).alias("share"), "users")


_EDGES = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0]
_HIST = "SELECT event_type, le::DOUBLE AS le, count(*) FILTER (WHERE value <= le) AS n FROM events, (SELECT unnest([1, 5, 10, 25, 50, 100, 'inf'::DOUBLE]) AS le) GROUP BY 1, 2"


@query("A19_histogram", f"SELECT event_type, le, n FROM ({_HIST}) WHERE le < 'inf'::DOUBLE")
def histogram(spark, d):
    return stats.histogram(table(spark, d, "events"), ["event_type"], F.col("value"), _EDGES).filter(F.col("le") < float("inf"))


@query("A15_histogram_quantile", f"SELECT event_type, round(min(CASE WHEN le = 'inf'::DOUBLE THEN lo ELSE lo + (le - lo) * (t - ln) / (n - ln) END), 6) AS quantile FROM (SELECT *, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(n) OVER w, 0) AS ln, 0.9 * max(n) OVER (PARTITION BY event_type) AS t FROM ({_HIST}) WINDOW w AS (PARTITION BY event_type ORDER BY le)) WHERE n >= t AND ln < t GROUP BY 1")
def histogram_quantile(spark, d):
    h = stats.histogram(table(spark, d, "events"), ["event_type"], F.col("value"), _EDGES)
    return stats.quantile(h, ["event_type"], 0.9).select("event_type", F.round("quantile", 6).alias("quantile"))


@query("A16_slo_compliance", "SELECT event_type, round(avg((value <= 25)::INT) * 100, 6) AS compliance FROM events GROUP BY 1")
def slo(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg((F.col("value") <= 25).cast("int")) * 100, 6).alias("compliance"))


@query("A17_counter_increase", "SELECT user_id, round(sum(CASE WHEN s >= 0 THEN s WHEN s < 0 THEN v ELSE 0 END), 4) AS increase, count(*) FILTER (WHERE s < 0) AS resets FROM (SELECT user_id, value AS v, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM events) GROUP BY 1")
def counter(spark, d):
    return stats.increase(table(spark, d, "events"), ["user_id"], "event_id", "value").select("user_id", F.round("increase", 4).alias("increase"), "resets")


_SERIES = '(SELECT user_id, (epoch_us(ts) // 1000000)::BIGINT AS "at", max(value) AS v FROM events GROUP BY 1, 2)'


@query("A17_over_range", f"""WITH s AS (SELECT *, CASE WHEN v >= b THEN v - b WHEN v < b THEN v ELSE 0 END AS g, coalesce((v <> b)::BIGINT, 0) AS c FROM (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY "at") AS b FROM {_SERIES})),
r AS (SELECT *, sum(g) OVER w AS up, sum(c) OVER w AS ch FROM s WINDOW w AS (PARTITION BY user_id ORDER BY "at" ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, count(*) OVER w AS n, up - first_value(up) OVER w AS raw, ch - first_value(ch) OVER w AS changes, first_value("at") OVER w AS t0, first_value(v) OVER w AS v0 FROM r WINDOW w AS (PARTITION BY user_id ORDER BY "at" RANGE BETWEEN 172799 PRECEDING AND CURRENT ROW)),
e AS (SELECT *, ("at" - t0)::DOUBLE AS span, CASE WHEN t0 - ("at" - 172800) < ("at" - t0)::DOUBLE / (n - 1) * 1.1 THEN (t0 - ("at" - 172800))::DOUBLE ELSE ("at" - t0)::DOUBLE / (n - 1) / 2 END AS reach FROM f WHERE n > 1),
g AS (SELECT *, raw * (span + least(reach, CASE WHEN raw > 0 AND v0 >= 0 THEN span * v0 / raw ELSE reach END)) / span AS increase FROM e)
SELECT user_id, f."at", round(increase + 1e-7, 3) AS increase, round(increase / 172800 + 1e-12, 8) AS rate, f.changes::BIGINT AS changes FROM f LEFT JOIN g USING (user_id, "at")""")
def over_range(spark, d):
    """Growth, rate and changes of each user's values over two days before each sample; what lies half-way is moved before rounding."""
    s = table(spark, d, "events").groupBy("user_id", F.col("ts").cast("timestamp").cast("long").alias("at")).agg(F.max("value").alias("value"))
    return stats.over_range(s, ["user_id"], "at", "value", 172_800).select("user_id", "at", F.round(F.col("increase") + 1e-7, 3).alias("increase"), F.round(F.col("rate") + 1e-12, 8).alias("rate"), "changes")


@query("A18_top_k", "SELECT user_id, round(sum(value), 4) AS total FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top_k(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("total")).orderBy(F.col("total").desc(), "user_id").limit(5)


@query("A20_token_cost", "SELECT event_type AS provider, round(sum(value * 1000) * CASE event_type WHEN 'click' THEN 0.25 WHEN 'view' THEN 0.15 ELSE 0 END / 1e6, 6) AS cost FROM events GROUP BY event_type")
def token_cost(spark, d):
    price = F.when(F.col("event_type") == "click", 0.25).when(F.col("event_type") == "view", 0.15).otherwise(0.0)
    return table(spark, d, "events").groupBy(F.col("event_type").alias("provider"), price.alias("p")).agg(F.sum(F.col("value") * 1000).alias("t")).select("provider", F.round(F.col("t") * F.col("p") / 1e6, 6).alias("cost"))


# Windows, order, sets
@query("W1_leg_ranks", f"SELECT query_id, point_id, rank FROM ({_SIMS})")
def leg_ranks(spark, d):
    return _found(spark, d).select("query_id", "point_id", F.col("rank").cast("long").alias("rank"))


@query("W4_evict_until_fits", "SELECT event_id FROM (SELECT event_id, sum(length(props)) OVER (PARTITION BY user_id ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) AS s FROM events) WHERE s <= 400")
def evict(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.length("props").alias("bytes"))
    return stats.newest_until(e, ["user_id"], "event_id", "bytes", 400).select("event_id")


@query("W5_first_edit", "SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def first_edit(spark, d):
    return dedup.first_of_each(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id")


@query("W6_versions", "SELECT event_id, row_number() OVER w AS version, (lag(event_id) OVER w)::DOUBLE AS supersedes FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)")
def event_versions(spark, d):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.row_number().over(w).cast("long").alias("version"), F.lag("event_id").over(w).cast("double").alias("supersedes"))


@query("W7_chunk_index", "SELECT doc_id, i - 1 AS chunk_index, n AS total_chunks, p[i] AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS p, len(string_split(text, chr(10))) AS n, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)")
def chunk_index(spark, d):
    p = F.split("text", "\n")
    return table(spark, d, "documents").select("doc_id", F.size(p).cast("long").alias("total_chunks"), F.posexplode(p).alias("chunk_index", "content")).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query("O3_fifo_batch", "SELECT id FROM {queue} ORDER BY queued_at, id LIMIT 10")
def fifo(spark, d):
    return queue(spark, d).orderBy("queued_at", "id").limit(10).select("id")


@query("O4_ready_for_retry", f"SELECT id FROM {{queue}} WHERE next_retry_at <= {_SQLNOW} AND retry_count < max_retries ORDER BY next_retry_at, id LIMIT 50")
def ready(spark, d):
    return stats.ready(queue(spark, d), _now()).orderBy("next_retry_at", "id").limit(50).select("id")


@query("T6_backoff", "SELECT id, CASE WHEN retry_count <= 0 THEN 1 WHEN retry_count = 1 THEN 5 ELSE 15 END AS wait FROM {queue}")
def backoff(spark, d):
    return queue(spark, d).select("id", stats.backoff_minutes(F.col("retry_count")).alias("wait"))


@query("U1_union", f"SELECT point_id, 'a' AS leg FROM {_M} WHERE label < 3 UNION ALL SELECT point_id, 'b' FROM {_M} WHERE label > 6")
def union(spark, d):
    m = memories(spark, d)
    return m.filter("label < 3").select("point_id", F.lit("a").alias("leg")).unionByName(m.filter("label > 6").select("point_id", F.lit("b").alias("leg")))


_LAYERS = [("decision", 2), ("session", 3), ("rule", 2)]


@query("U2_layered_union", " UNION ALL ".join(f"(SELECT {i} AS layer, point_id FROM {_M} WHERE type = '{t}' ORDER BY stored_at DESC, point_id LIMIT {n})" for i, (t, n) in enumerate(_LAYERS)))
def layers(spark, d):
    m, out = memories(spark, d), None
    for i, (kind, n) in enumerate(_LAYERS):
        part = m.filter(F.col("type") == kind).orderBy(F.col("stored_at").desc(), "point_id").limit(n).select(F.lit(i).alias("layer"), "point_id")
        out = part if out is None else out.unionByName(part)
    return out


_Q0 = "(SELECT embedding::DOUBLE[] AS query FROM embeddings WHERE vec_id = 0)"
_NEAR0 = "round(list_cosine_similarity(m.embedding::DOUBLE[], q.query), 9) DESC, point_id"


@query("P6_bootstrap_retrieval", f"""WITH l AS (SELECT group_id, max(stored_at) AS since FROM {_M} WHERE type = 'session' AND agent_id = 'a1' GROUP BY 1),
x AS (SELECT group_id, 1 AS layer, row_number() OVER (PARTITION BY group_id ORDER BY stored_at DESC, point_id) AS place, point_id FROM {_M} WHERE type = 'session' AND agent_id = 'a1'
UNION ALL SELECT group_id, 2, row_number() OVER (PARTITION BY group_id ORDER BY stored_at DESC, point_id), point_id FROM {_M} WHERE type = 'decision'
UNION ALL SELECT group_id, 3, row_number() OVER (PARTITION BY group_id ORDER BY {_NEAR0}), point_id FROM {_M} m, {_Q0} q WHERE type = 'error_pattern' AND agent_id = 'a1'
UNION ALL SELECT group_id, 4, row_number() OVER (PARTITION BY group_id ORDER BY {_NEAR0}), point_id FROM {_M} m LEFT JOIN l USING (group_id), {_Q0} q WHERE collection = 'github' AND (since IS NULL OR stored_at > since))
SELECT group_id, layer, place::INT AS place, point_id FROM x WHERE place <= [1, 5, 3, 3][layer]""")
def bootstrap(spark, d):
    return search.bootstrap(memories(spark, d), queries_table(spark, d).filter("query_id = 0"), "a1", ("session", "decision", "error_pattern"), "github")


@query("U3_set_difference", f"SELECT DISTINCT file_path FROM {_M} WHERE collection = 'code-patterns' EXCEPT SELECT file_path FROM {_M} WHERE collection = 'github'")
def difference(spark, d):
    m = memories(spark, d)
    return m.filter("collection = 'code-patterns'").select("file_path").subtract(m.filter("collection = 'github'").select("file_path"))


@query("U5_tag_overlap", f"SELECT a.point_id FROM {_M} a WHERE a.type IN ('rule', 'decision') OR a.source IN ('manual')")
def overlap(spark, d):
    tags = F.array_compact(F.array("type", "source"))
    return memories(spark, d).filter(F.arrays_overlap(tags, F.array(F.lit("rule"), F.lit("decision"), F.lit("manual")))).select("point_id")


# Packing


_PEN = "CASE coalesce(freshness_status, 'unverified') WHEN 'fresh' THEN 1.0 WHEN 'aging' THEN 0.9 WHEN 'stale' THEN 0 WHEN 'expired' THEN 0 WHEN 'unverified' THEN 1.0 ELSE 0.8 END"


@query("P4_freshness_penalty", f"SELECT query_id, point_id, round(CASE WHEN collection = 'code-patterns' THEN score * {_PEN} ELSE score END, 6) AS score FROM ({_SIMS})")
def freshness_penalty(spark, d):
    return freshness.penalised(_found(spark, d)).select("query_id", "point_id", F.round("score", 6).alias("score"))


@query("P5_penalty_lookup", f"SELECT point_id, ({_PEN})::DOUBLE AS penalty FROM {_M}")
def penalty(spark, d):
    return memories(spark, d).select("point_id", freshness.penalty(F.col("freshness_status")).alias("penalty"))


@query("P1_greedy_fill")
def greedy(spark, d):
    found = _found(spark, d)
    budgets = found.select("query_id").distinct().withColumn("budget", F.lit(20))
    return packing.greedy(found, budgets, 0.5).select("query_id", F.array_join("selected", ",").alias("selected"), "tokens")


@query("C34_tiered_text", f"SELECT query_id, string_agg('- [' || type || '] ' || CASE WHEN score >= 0.9 OR length(content) <= 15 THEN content ELSE substr(content, 1, 15) || '...' END, chr(10) ORDER BY rank) AS text FROM ({_SIMS}) WHERE score >= 0.2 GROUP BY 1")
def tiered(spark, d):
    return packing.rendered(_found(spark, d), 0.9, 0.2, 15)


@query("C35_injection_output", f"SELECT query_id, '<retrieved_context>' || chr(10) || string_agg(content, chr(10) ORDER BY rank) || chr(10) || '</retrieved_context>' AS text FROM ({_SIMS}) WHERE rank <= 3 GROUP BY 1")
def injection(spark, d):
    parts = F.array_sort(F.collect_list(F.struct("rank", "content")))
    body = F.array_join(F.transform(parts, lambda x: x["content"]), "\n")
    return _found(spark, d).filter("rank <= 3").groupBy("query_id").agg(F.concat(F.lit("<retrieved_context>\n"), body, F.lit("\n</retrieved_context>")).alias("text"))


# Backfills and evaluation
@query("B3_field_backfill", f"SELECT point_id, coalesce(source, 'src-' || agent_id) AS source, coalesce(freshness_status, 'unverified') AS freshness_status FROM {_M}")
def field_backfill(spark, d):
    return memories(spark, d).select("point_id", F.coalesce("source", F.concat(F.lit("src-"), "agent_id")).alias("source"), F.coalesce("freshness_status", F.lit("unverified")).alias("freshness_status"))


@query("B4_decay_fields", f"SELECT point_id, 1.0::DOUBLE AS decay_score, (CASE WHEN source = 'manual' THEN 1.0 WHEN source = 'github' THEN 0.6 ELSE 0.4 END)::DOUBLE AS source_authority, 1 AS version FROM {_M}")
def decay_fields(spark, d):
    return memories(spark, d).select("point_id", F.lit(1.0).alias("decay_score"), F.when(F.col("source") == "manual", 1.0).when(F.col("source") == "github", 0.6).otherwise(0.4).alias("source_authority"), F.lit(1).alias("version"))


@query("B5_collection_migration", f"SELECT point_id, CASE WHEN type LIKE 'github%' THEN 'github' ELSE collection END AS collection FROM {_M} WHERE NOT (type = 'error_pattern' AND label = 0)")
def migration(spark, d):
    return memories(spark, d).filter("NOT (type = 'error_pattern' AND label = 0)").select("point_id", F.when(F.startswith("type", F.lit("github")), "github").otherwise(F.col("collection")).alias("collection"))


@query("B6_term_frequencies", f"SELECT point_id, term, count(*) AS tf FROM (SELECT point_id, unnest(regexp_split_to_array(lower(content), '\\W+')) AS term FROM {_M}) GROUP BY 1, 2")
def term_frequencies(spark, d):
    return memories(spark, d).select("point_id", F.explode(search.tokens(F.col("content"))).alias("term")).groupBy("point_id", "term").agg(F.count(F.lit(1)).alias("tf"))


_SAYS = ["", "see DEC-12 for it", "blk-7 stands", "I would prefer tabs", "as you like it", "dec-x and blk- alone"]


@query("B7_type_migration", f"SELECT doc_id, CASE WHEN regexp_matches(c, '(?i)\\bDEC-\\d+\\b') THEN 'decision' WHEN regexp_matches(c, '(?i)\\bBLK-\\d+\\b') THEN 'blocker' WHEN kind = 'session_summary' THEN 'session' WHEN regexp_matches(c, '(?i)\\b(?:prefer|preference|like|dislike)\\b') THEN 'preference' ELSE 'context' END AS type FROM (SELECT doc_id, text || ' ' || {tables.pick_sql(_SAYS, 'doc_id')} AS c, {tables.pick_sql(['note', 'session_summary', 'chat'], 'doc_id // 2')} AS kind FROM documents)")
def type_migration(spark, d):
    k = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", classify.migrated_type(F.concat_ws(" ", "text", tables.pick(_SAYS, k)), tables.pick(["note", "session_summary", "chat"], F.floor(k / 2))).alias("type"))


@query("B9_retry_outcome", "SELECT id, CASE WHEN retry_count >= max_retries - 1 THEN 'dead_letter' ELSE 'retry' END AS outcome FROM {queue}")
def retry_outcome(spark, d):
    return queue(spark, d).select("id", F.when(F.col("retry_count") >= F.col("max_retries") - 1, "dead_letter").otherwise("retry").alias("outcome"))


@query("E1_observation_scores", "SELECT event_id, md5(event_id || ':' || user_id || ':relevance:2024-01-01') AS score_id, CASE WHEN value > 50 THEN 'good' WHEN value > 10 THEN 'fair' ELSE 'poor' END AS category FROM events WHERE event_type = 'view' AND ('0x' || substr(md5(event_id::VARCHAR), 1, 6))::BIGINT % 100 < 20")
def observations(spark, d):
    h = F.conv(F.substring(F.md5(F.encode(F.col("event_id").cast("string"), "UTF-8")), 1, 6), 16, 10).cast("long")
    e = table(spark, d, "events").filter((F.col("event_type") == "view") & (h % 100 < 20))
    return e.select("event_id", text.score_id(F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.lit("relevance"), F.lit("2024-01-01")).alias("score_id"), F.when(F.col("value") > 50, "good").when(F.col("value") > 10, "fair").otherwise("poor").alias("category"))


@query("T11_look_back_window", "SELECT event_type, count(*) AS n FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-20' AND TIMESTAMP '2024-01-25' GROUP BY 1")
def look_back(spark, d):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return table(spark, d, "events").filter(F.col("ts").between(at("2024-01-20"), at("2024-01-25"))).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


# Error retrieval
@query("H4_error_group", "SELECT doc_id, substr(sha256('pytest:' || lang || ':' || source), 1, 16) AS error_group_id FROM documents")
def error_group(spark, d):
    return table(spark, d, "documents").select("doc_id", text.short_hash(F.concat_ws(":", F.lit("pytest"), "lang", "source"), 16).alias("error_group_id"))


@query("H5_command_prefix", r"SELECT doc_id, coalesce(nullif(regexp_extract(prompt, '^\s*(\S+)', 1), ''), 'unknown') AS prefix FROM {prompts}")
def prefix(spark, d):
    return prompts(spark, d).select("doc_id", F.coalesce(F.nullif(F.regexp_extract("prompt", "^\\s*(\\S+)", 1), F.lit("")), F.lit("unknown")).alias("prefix"))


_OUTPUTS = ["src/error-handling.md\nsrc/a.py\n", "build ok", "npm ERR! missing script", "bash: foo: command not found", "a/TypeError.md\nb/FAILED.txt", "exited with 0", "exited with 3", "Error: no route", "no Error: here", "make: FAILED", "", "panic: nil"]
_OUT = "(SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN text || chr(10) ELSE '' END || " + tables.pick_sql(_OUTPUTS, "doc_id") + " AS output, CASE WHEN doc_id % 7 = 0 THEN 1 WHEN doc_id % 7 = 1 THEN NULL ELSE 0 END AS code FROM documents)"


@query("H1_error_detection", "SELECT doc_id, coalesce(code <> 0, false) OR (NOT (len(l) > 0 AND len(list_filter(l, lambda x: NOT regexp_matches(x, " + "'" + errors.LISTED + "'" + "))) = 0) AND regexp_matches(output, '" + errors.SIGNS + "')) AS is_error FROM (SELECT *, list_filter(string_split(output, chr(10)), lambda x: trim(x) <> '') AS l FROM " + _OUT + ")")
def error_detection(spark, d):
    k = F.col("doc_id")
    output = F.concat(F.when(k % 5 == 4, F.concat("text", F.lit("\n"))).otherwise(""), tables.pick(_OUTPUTS, k))
    code = F.when(k % 7 == 0, 1).when(k % 7 != 1, 0)
    return table(spark, d, "documents").select("doc_id", errors.is_error(code, output).alias("is_error"))


_ASKED = ["npm test", "pytest tests/test_auth.py --maxfail 2", "docker build -t myapp:latest .", "ls -la", "cargo build --release", "make all", "go test ./internal/store", "npm run build:web --verbose"]
_FAM = "coalesce(" + ", ".join(f"CASE WHEN {' OR '.join(f'contains(cmd, {chr(39)}{p}{chr(39)})' for p in ps)} THEN '{k}' END" for k, ps in classify.COMMANDS.items()) + ")"


@query("H8_query_construction", f"SELECT doc_id, CASE WHEN fam IS NOT NULL THEN concat_ws(' ', fam, 'errors failures', nullif(array_to_string(list_transform(list_sort(list_distinct(list_transform(w, lambda x: {{'p': list_position(w, x), 'x': x}})))[1:3], lambda s: s.x), ' '), ''), 'common issues') END AS q FROM (SELECT *, list_filter(regexp_split_to_array(array_to_string(list_filter(regexp_split_to_array(lower(cmd), '\\s+'), lambda w: NOT starts_with(w, '-')), ' '), '[^a-z]+'), lambda w: length(w) >= 3 AND w NOT IN {tuple(errors.EMPTY_WORDS)} AND w <> fam) AS w FROM (SELECT *, {_FAM} AS fam FROM (SELECT doc_id, {tables.pick_sql(_ASKED, 'doc_id')} || ' ' || source AS cmd FROM documents)))")
def construction(spark, d):
    command = F.concat_ws(" ", tables.pick(_ASKED, F.col("doc_id")), "source")
    return table(spark, d, "documents").select("doc_id", errors.question(classify.command_family(command), command).alias("q"))


@query("H9_solution_hint", "SELECT doc_id, substr(array_to_string(l[p:p + 2], ' '), 1, 200) AS hint FROM (SELECT doc_id, l, list_position(list_transform(l, lambda x: contains(x, 'the ')), true) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE p > 0")
def hint(spark, d):
    lines = F.split("text", "\n")
    at = F.array_position(F.transform(lines, lambda x: F.contains(x, F.lit("the "))), True)
    return table(spark, d, "documents").withColumn("p", at.cast("int")).filter("p > 0").select("doc_id", F.substring(F.array_join(F.slice(lines, F.col("p"), F.lit(3)), " "), 1, 200).alias("hint"))
