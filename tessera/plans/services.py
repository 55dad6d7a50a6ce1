"""Queries of validation, duplicates, error retrieval, providers, sync cycles, backfills and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import chunking, classify, code, text, validation
from tessera.operators import backfill, dedup, packing, providers, search, stats
from tessera.plans import tables
from tessera.plans.registry import query
from tessera.plans.search import _PAIRS
from tessera.plans.stateful import _shared
from tessera.plans.tables import memories, prompts, queries_table, sessions, table
from tessera.plans.text import _CONF, _RULE, _SIG
from tessera.sources import files, sync
from tessera.streaming import state

_M = "{memories}"


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# Validation
_HOOKS = ["PostToolUse", "Stop", "bogus_hook", "manual", None, ""]
_KINDS = ["implementation", "rule", "bogus", None, "decision", "error_pattern", "session", ""]
_GROUPS = ["g-main", "", None, "ab", "g-other"]
_BODIES = ["", "short", "see src/app/main.py:10-20 for how retries are done in this module of ours", "TODO [placeholder]", "plain words, ten or more", "text with `code` and ```\na\nb\nc\nd\ne\nf\ng\nh\ni\nj\nk\n``` after it"]


def _payloads(spark, d):
    """Payloads as they come: fields missing, too short, too long or unknown; bodies are whole texts or short ones."""
    k = F.col("doc_id")
    body = F.when(k % 7 == 6, F.col("text")).when(k % 50 == 12, F.repeat(F.lit("long text "), 11_000)).otherwise(tables.pick(_BODIES, k))
    return table(spark, d, "documents").select(
        "doc_id", body.alias("content"), tables.pick(_GROUPS, F.floor(k / 2)).alias("group_id"), tables.pick(_KINDS, F.floor(k / 3)).alias("type"), tables.pick(_HOOKS, F.floor(k / 5)).alias("source_hook"),
        tables.pick(["dev", "ghost", None, "pm"], F.floor(k / 2)).alias("agent"), tables.pick(["api", None, "x"], F.floor(k / 4)).alias("component"), tables.pick(["1.2", None], k).alias("story_id"), tables.pick(["high", "huge", None], F.floor(k / 6)).alias("importance"),
        tables.pick(["impl-0001", "x1", None, "error-77", "other-id"], F.floor(k / 3)).alias("unique_id"), tables.pick(["2026-01-05T10:00", "yesterday", None], k).alias("created_at"),
    )


_PAYLOADS = (
    "(SELECT doc_id, CASE WHEN doc_id % 7 = 6 THEN text WHEN doc_id % 50 = 12 THEN repeat('long text ', 11000) ELSE " + tables.pick_sql(_BODIES, "doc_id") + " END AS content, " + tables.pick_sql(_GROUPS, "doc_id // 2") + " AS group_id, "
    + tables.pick_sql(_KINDS, "doc_id // 3") + " AS type, " + tables.pick_sql(_HOOKS, "doc_id // 5") + " AS source_hook, " + tables.pick_sql(["dev", "ghost", None, "pm"], "doc_id // 2") + " AS agent, " + tables.pick_sql(["api", None, "x"], "doc_id // 4") + " AS component, "
    + tables.pick_sql(["1.2", None], "doc_id") + " AS story_id, " + tables.pick_sql(["high", "huge", None], "doc_id // 6") + " AS importance, " + tables.pick_sql(["impl-0001", "x1", None, "error-77", "other-id"], "doc_id // 3") + " AS unique_id, " + tables.pick_sql(["2026-01-05T10:00", "yesterday", None], "doc_id") + " AS created_at FROM documents)"
)
_EMPTY = "coalesce({}, '') = ''"
_F12 = [(f"{_EMPTY.format(c)}", f"'Missing required field: {c}'") for c in ("content", "group_id", "type", "source_hook")] + [
    ("length(content) > 100000", "'Content exceeds maximum length (100,000 chars)'"), ("length(content) < 10", "'Content too short (minimum 10 chars)'"),
    (f"coalesce(type, '') <> '' AND type NOT IN {tuple(validation.PAYLOAD_TYPES)}", _quote(f"Invalid type. Must be one of: {validation.PAYLOAD_TYPES}")),
    (f"coalesce(source_hook, '') <> '' AND source_hook NOT IN {tuple(validation.PAYLOAD_HOOKS)}", _quote(f"Invalid source_hook. Must be one of: {validation.PAYLOAD_HOOKS}")),
]


def _said(cases: list[tuple[str, str]]) -> str:
    return "concat_ws('; ', " + ", ".join(f"CASE WHEN {c} THEN {m} END" for c, m in cases) + ")"


@query("F12_payload_validation", f"SELECT doc_id, {_said(_F12)} AS errors FROM {_PAYLOADS}")
def payload_validation(spark, d):
    return _payloads(spark, d).select("doc_id", F.array_join(validation.payload_errors(F.col("content"), F.col("group_id"), F.col("type"), F.col("source_hook")), "; ").alias("errors"))


_MISS = lambda names: "list_filter([" + ", ".join(f"CASE WHEN {n} IS NULL THEN '{n}' END" for n in names) + "], lambda x: x IS NOT NULL)"
_SHOW = lambda names: "'[' || array_to_string(list_transform(" + _MISS(names) + ", lambda x: '''' || x || ''''), ', ') || ']'"
_REQ, _REC = ["type", "group_id", "source_hook"], ["agent", "component", "story_id", "importance"]
_BLOCK_LINES = "list_transform(regexp_extract_all(content, '(```[\\s\\S]*?```|`[^`]+`)', 1), lambda b: len(list_filter(string_split(b, chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(ltrim(x), '```'))))"
_F13_ERRORS = [
    (f"len({_MISS(_REQ)}) > 0", f"'Missing required fields: ' || {_SHOW(_REQ)}"),
    (f"coalesce(type, '') <> '' AND type NOT IN {tuple(validation.STORED_TYPES)}", "'Invalid type ''' || type || " + _quote(f"'. Must be one of: {validation.STORED_TYPES}")),
    (f"coalesce(importance, '') <> '' AND importance NOT IN {tuple(validation.IMPORTANCE)}", "'Invalid importance ''' || importance || " + _quote(f"'. Must be: {validation.IMPORTANCE}")),
    (_EMPTY.format("group_id"), "'no-tenant: group_id is empty'"),
    (f"type IN {tuple(validation.WITH_REFERENCES)} AND NOT regexp_matches(content, {_quote(validation.REFERENCE)})", "'no-reference: ' || type || ' names no file with a line'"),
    ("length(content) // 4 > 1200", "'too-many-tokens: ' || (length(content) // 4) || ' of 1200'"),
]
_F13_WARNINGS = [
    (f"len({_MISS(_REC)}) > 0", f"'advised-fields: ' || {_SHOW(_REC)}"),
    (f"len(list_filter({_BLOCK_LINES}, lambda n: n > 10)) > 0", f"array_to_string(list_transform(list_filter({_BLOCK_LINES}, lambda n: n > 10), lambda n: 'long-snippet: ' || n || ' lines of 10'), '; ')"),
    ("length(content) < 50", "'short-content: ' || length(content) || ' of 50'"),
    ("length(content) > 50000", "'long-content: ' || length(content) || ' of 50000'"),
] + [(f"contains(upper(content), '{p}')", _quote(f"placeholder: {p}")) for p in validation.PLACEHOLDERS]


@query("F13_storage_validation", f"SELECT doc_id, {_said(_F13_ERRORS)} AS errors, {_said(_F13_WARNINGS)} AS warnings, (length(content) // 4)::INT AS tokens FROM {_PAYLOADS}")
def storage_validation(spark, d):
    p = _payloads(spark, d)
    r = validation.storage_report(F.col("content"), {c: F.col(c) for c in (*_REQ, *_REC)})
    return p.select("doc_id", r.alias("r")).select("doc_id", F.array_join("r.errors", "; ").alias("errors"), F.array_join("r.warnings", "; ").alias("warnings"), "r.tokens")


_F14_ERRORS = [
    (f"len({_MISS(_REQ)}) > 0", f"'Missing required fields: ' || array_to_string({_MISS(_REQ)}, ', ')"), (_EMPTY.format("type"), "'no-type: type is empty'"),
    (f"coalesce(type, '') <> '' AND type NOT IN {tuple(validation.STORED_TYPES)}", "'Invalid type ''' || type || " + _quote(f"'. Must be one of: {', '.join(validation.STORED_TYPES)}")),
    (f"coalesce(importance, '') <> '' AND importance NOT IN {tuple(validation.IMPORTANCE)}", "'Invalid importance ''' || importance || " + _quote(f"'. Must be: {', '.join(validation.IMPORTANCE)}")),
    (_EMPTY.format("source_hook"), "'no-hook: source_hook is empty'"), (_EMPTY.format("group_id"), "'no-tenant: group_id is empty'"),
    ("length(group_id) BETWEEN 1 AND 2", "'short-value: group_id ''' || group_id || ''''"), ("length(unique_id) BETWEEN 1 AND 4", "'short-value: unique_id ''' || unique_id || ''''"),
    ("NOT regexp_matches(created_at, '^[0-9]{4}-[0-9]{2}-[0-9]{2}')", "'odd-date: created_at ''' || created_at || ''''"), ("length(component) = 1", "'short-value: component ''' || component || ''''"),
]
_F14_WARNINGS = [(f"coalesce(agent, '') <> '' AND agent NOT IN {tuple(validation.AGENTS)}", "'unknown-agent: ''' || agent || ''''")] + [
    (f"type = '{t}' AND unique_id IS NOT NULL AND NOT starts_with(unique_id, '{p}')", f"'odd-prefix: unique_id ''' || unique_id || ''' of a {t}'") for t, p in (("implementation", "impl-"), ("error_pattern", "error-"))]


@query("F14_metadata_validation", f"SELECT doc_id, {_said(_F14_ERRORS)} AS errors, {_said(_F14_WARNINGS)} AS warnings FROM {_PAYLOADS}")
def metadata_validation(spark, d):
    names = ("type", "importance", "agent", "source_hook", "group_id", "unique_id", "created_at", "component")
    r = validation.metadata_report({c: F.col(c) for c in names}, F.to_json(F.struct(*names)))
    return _payloads(spark, d).select("doc_id", r.alias("r")).select("doc_id", F.array_join("r.errors", "; ").alias("errors"), F.array_join("r.warnings", "; ").alias("warnings"))


# Duplicates: incoming rows are the odd ones, and copies of stored ones that are equal or near
_I = f"""(SELECT vec_id, point_id, group_id, label, collection, content, embedding FROM {_M} WHERE vec_id % 2 = 1
 UNION ALL SELECT vec_id, 'c' || point_id, group_id, label, collection, content, embedding FROM {_M} WHERE vec_id % 20 = 0
 UNION ALL SELECT vec_id, 'n' || point_id, group_id, label, collection, content || ' once more', embedding FROM {_M} WHERE vec_id % 20 = 4)"""
_S = f"(SELECT * FROM {_M} WHERE vec_id % 2 = 0)"


def _incoming(spark, d):
    m = memories(spark, d).select("vec_id", "point_id", "group_id", "label", "collection", "content", "embedding")
    named = lambda a: F.concat(F.lit(a), "point_id")
    equal, near = m.filter("vec_id % 20 = 0").withColumn("point_id", named("c")), m.filter("vec_id % 20 = 4").withColumn("point_id", named("n")).withColumn("content", F.concat("content", F.lit(" once more")))
    return m.filter("vec_id % 2 = 1").unionByName(equal).unionByName(near)


def _stored(spark, d):
    return memories(spark, d).filter("vec_id % 2 = 0")


_HALVES = f"WITH s AS (SELECT group_id, sha256(content) AS h, min(point_id) AS existing_id FROM {_S} GROUP BY 1, 2), i AS (SELECT point_id, group_id, sha256(content) AS h FROM {_I})"


@query("J5_hash_duplicates", f"{_HALVES} SELECT point_id, existing_id FROM i JOIN s USING (group_id, h)")
def hash_duplicates(spark, d):
    return dedup.hash_matches(_incoming(spark, d), _stored(spark, d))


@query("D3_hash_duplicates_any_tenant", f"WITH s AS (SELECT sha256(content) AS h, min(point_id) AS existing_id FROM {_S} GROUP BY 1) SELECT point_id, existing_id FROM {_I} m JOIN s ON sha256(m.content) = s.h")
def any_tenant(spark, d):
    return dedup.hash_matches(_incoming(spark, d), _stored(spark, d), tenant=False)


@query("D2_store_once", f"{_HALVES} SELECT min(point_id) AS point_id FROM i ANTI JOIN s USING (group_id, h) GROUP BY group_id, h")
def store_once(spark, d):
    new = _incoming(spark, d)
    rest = new.join(dedup.hash_matches(new, _stored(spark, d)).select("point_id"), "point_id", "left_anti")
    return dedup.first_of_each(rest, ["group_id", text.content_hash(F.col("content"))], ["point_id"]).select("point_id")


@query("J11_vector_near_duplicates", f"SELECT point_id, round(max(sim), 6) AS similarity FROM (SELECT a.point_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM {_I} a JOIN {_S} b ON a.group_id = b.group_id AND a.point_id <> b.point_id) WHERE sim >= 0.85 GROUP BY 1")
def near(spark, d):
    return dedup.nearest(_incoming(spark, d), _stored(spark, d), ["group_id"], 0.85).select("point_id", F.round("similarity", 6).alias("similarity"))


@query("D1_two_stage_dedup", f"""WITH i AS (SELECT *, sha256(content) AS h FROM (SELECT point_id, group_id, embedding, CASE WHEN vec_id % 20 = 1 THEN '' WHEN vec_id % 20 = 3 THEN 'short' ELSE content END AS content FROM {_I})),
s AS (SELECT *, sha256(content) AS h FROM {_S}),
hashed AS (SELECT DISTINCT i.point_id FROM i JOIN s ON i.group_id = s.group_id AND i.h = s.h),
near AS (SELECT i.point_id, max(list_cosine_similarity(i.embedding::DOUBLE[], s.embedding::DOUBLE[])) AS sim FROM i JOIN s ON i.group_id = s.group_id GROUP BY 1)
SELECT i.point_id, CASE WHEN content IN ('', 'short') THEN false ELSE hashed.point_id IS NOT NULL OR coalesce(sim >= 0.95, false) END AS is_duplicate,
 CASE WHEN content = '' THEN 'empty_content' WHEN content = 'short' THEN 'content_too_short' WHEN hashed.point_id IS NOT NULL THEN 'hash_match' WHEN sim >= 0.95 THEN 'semantic_similarity' ELSE 'unique' END AS reason FROM i LEFT JOIN hashed USING (point_id) LEFT JOIN near USING (point_id)""")
def two_stage(spark, d):
    i = _incoming(spark, d).withColumn("content", F.when(F.col("vec_id") % 20 == 1, "").when(F.col("vec_id") % 20 == 3, "short").otherwise(F.col("content")))
    return dedup.checked(i, _stored(spark, d), ["group_id"]).select("point_id", "is_duplicate", "reason")


_TALK = "SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'ok, go on' ELSE text END AS text, ts FROM {sessions}"
_REPEAT = f"SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY conv_id, text ORDER BY ts, turn) <= 300000000, false) AS is_repeat FROM ({_TALK})"


@query("J12_repeated_messages", f"SELECT conv_id, turn, is_repeat FROM ({_REPEAT})")
def repeated(spark, d):
    s = sessions(spark, d).withColumn("text", F.when(F.col("turn") % 3 == 2, "ok, go on").otherwise(F.col("text")))
    return dedup.within_minutes(s, ["conv_id", "text"], "ts").select("conv_id", "turn", "is_repeat")


@query("D5_conversation_duplicates", f"SELECT conv_id, count(*) FILTER (WHERE is_repeat) AS repeats FROM ({_REPEAT}) GROUP BY 1")
def conversation_duplicates(spark, d):
    return repeated(spark, d).groupBy("conv_id").agg(F.count_if("is_repeat").alias("repeats"))


@query("D6_result_dedup", f"SELECT query_id, min(point_id) AS point_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, point_id) AS r FROM ({_PAIRS})) WHERE r <= 50 GROUP BY query_id, left(sha256(content), 16)")
def result_dedup(spark, d):
    r = search.dense(memories(spark, d), queries_table(spark, d), 50, threshold=None)
    return dedup.first_of_each(r, ["query_id", text.short_hash(F.col("content"), 16)], ["point_id"]).select("query_id", "point_id")


_NEAR = f"(SELECT vec_id, point_id, collection, content, embedding FROM {_M} UNION ALL SELECT vec_id, 'n' || point_id, collection, content || ' once more', embedding FROM {_M} WHERE vec_id % 20 = 0)"


@query("V17_semantic_duplicates", f"SELECT query_id, collection, point_id, round(similarity, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY round(similarity, 9) DESC, point_id) AS r FROM (SELECT query_id, m.*, list_cosine_similarity(m.embedding::DOUBLE[], q.query::DOUBLE[]) AS similarity FROM {_NEAR} m, {{queries}} q) WHERE similarity >= 0.85) WHERE r <= 5")
def semantic_duplicates(spark, d):
    m = memories(spark, d).select("vec_id", "point_id", "collection", "content", "embedding")
    copies = m.filter("vec_id % 20 = 0").withColumn("point_id", F.concat(F.lit("n"), "point_id")).withColumn("content", F.concat("content", F.lit(" once more")))
    w = Window.partitionBy("query_id", "collection").orderBy(F.round("similarity", 9).desc(), "point_id")
    return search.scored(m.unionByName(copies), queries_table(spark, d), 0.85).withColumn("r", F.row_number().over(w)).filter("r <= 5").select("query_id", "collection", "point_id", F.round("similarity", 6).alias("score"))


_SIMS = f"SELECT query_id, collection, max(similarity) AS best FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, point_id) AS r FROM ({_PAIRS})) WHERE r <= 20 GROUP BY 1, 2"
_BEST = "best * (0.4 + 0.05 * (query_id // 100 % 13))"


@query("P3_gating", f"SELECT query_id, collection, CASE WHEN best < 0.45 THEN 'hard_skip' WHEN best >= g THEN 'full' WHEN best >= g - 0.05 THEN 'soft_gate' ELSE 'soft_skip' END AS gate FROM (SELECT query_id, collection, round({_BEST}, 6) AS best, CASE collection WHEN 'conventions' THEN 0.65 WHEN 'code-patterns' THEN 0.55 ELSE 0.6 END AS g FROM ({_SIMS}))")
def gating(spark, d):
    found = search.dense(memories(spark, d), queries_table(spark, d), 20, threshold=None)
    best = F.col("best") * (0.4 + 0.05 * (F.floor(F.col("query_id") / 100) % 13))
    return found.groupBy("query_id", "collection").agg(F.max("score").alias("best")).select("query_id", "collection", packing.gate(F.round(best, 6), F.col("collection")).alias("gate"))


@query("U4_ordered_distinct", "SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS words FROM (SELECT doc_id, w, min(p) AS p FROM (SELECT doc_id, l[i] AS w, i AS p FROM (SELECT doc_id, string_split(text, ' ') AS l, unnest(range(1, len(string_split(text, ' ')) + 1)) AS i FROM documents)) GROUP BY 1, 2) GROUP BY 1")
def ordered_distinct(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_distinct(F.split("text", " ")), " ").alias("words"))


# Errors and commands
_ERRORS = f"(SELECT *, CASE WHEN vec_id % 3 = 0 THEN 'error' WHEN vec_id % 3 = 1 THEN 'fix' END AS subtype, substr(sha256('g' || (vec_id % 41)), 1, 16) AS error_group_id, (vec_id % 10) / 10.0::DOUBLE AS resolution_confidence FROM {_M})"


@query("H6_error_fixes", f"""WITH e AS (SELECT query_id, point_id, error_group_id, score FROM (SELECT q.query_id, m.point_id, m.error_group_id, list_cosine_similarity(m.embedding::DOUBLE[], q.query::DOUBLE[]) AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY list_cosine_similarity(m.embedding::DOUBLE[], q.query::DOUBLE[]) DESC, point_id) AS r FROM {_ERRORS} m, {{queries}} q WHERE subtype = 'error' AND list_cosine_similarity(m.embedding::DOUBLE[], q.query::DOUBLE[]) >= 0.1) WHERE r <= 5),
f AS (SELECT point_id AS fix_id, error_group_id, resolution_confidence FROM {_ERRORS} WHERE subtype = 'fix' AND coalesce(freshness_status NOT IN ('stale', 'expired'), true))
SELECT query_id, point_id, fix_id, round(score, 6) AS score, resolution_confidence, row_number() OVER (PARTITION BY query_id ORDER BY resolution_confidence DESC NULLS LAST, score DESC, point_id, fix_id) AS place FROM e LEFT JOIN f USING (error_group_id)""")
def error_fixes(spark, d):
    v = F.col("vec_id")
    m = memories(spark, d).withColumn("subtype", F.when(v % 3 == 0, "error").when(v % 3 == 1, "fix")).withColumn("error_group_id", text.short_hash(F.concat(F.lit("g"), (v % 41).cast("string")), 16)).withColumn("resolution_confidence", v % 10 / 10.0)
    return search.error_fixes(m, queries_table(spark, d), 5, 0.1).select("query_id", "point_id", "fix_id", F.round("score", 6).alias("score"), "resolution_confidence", F.col("place").cast("long").alias("place"))


_COMMANDS = ["npm test --all", "yarn build", "pnpm install", "pytest -q tests", "python3 -m pytest x", "python setup.py install", "pip install x", "make test", "make", "cmake ..", "ctest", "./gradlew build", "gradle test", "mvn install", "go test ./...", "cargo build --release", "docker compose up -d", "npm run jest", "jest --watch", "mocha", "npm run vitest", "eslint src", "npm run lint", "pylint a.py", "black .", "mypy src", "ls -la", "git status", "npm publish", "cd x && pytest", "gofmt -l .", "makeup", ""]
_FAMILY = "coalesce(" + ", ".join(f"CASE WHEN {' OR '.join(f'contains(cmd, {_quote(p)})' for p in ps)} THEN '{k}' END" for k, ps in classify.COMMANDS.items()) + ")"


@query("H7_command_family", f"SELECT doc_id, {_FAMILY} AS family FROM (SELECT doc_id, {tables.pick_sql(_COMMANDS, 'doc_id')} AS cmd FROM documents)")
def family(spark, d):
    return table(spark, d, "documents").select("doc_id", classify.command_family(tables.pick(_COMMANDS, F.col("doc_id"))).alias("family"))


# Search by whole query sets
@query("V15_issue_search", f"SELECT query_id, point_id, 'https://' || group_id || '.example.net/browse/PROJ-' || vec_id AS url, CASE WHEN length(content) <= 300 THEN content ELSE substr(content, 1, 300) || '...' END AS snippet FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, point_id) AS r FROM ({_PAIRS}) WHERE collection = 'jira-data') WHERE r <= 10")
def issue_search(spark, d):
    found = search.dense(memories(spark, d), queries_table(spark, d), 10, search.Filters("jira-data"), None)
    return found.select("query_id", "point_id", text.issue_url(F.concat("group_id", F.lit(".example.net")), F.concat(F.lit("PROJ-"), F.col("vec_id").cast("string")), F.lit(None).cast("string")).alias("url"), text.snippet(F.col("content")).alias("snippet"))


@query("V16_issue_lookup", "SELECT conv_id, max(text) FILTER (WHERE turn = 0) AS issue, string_agg(turn || ':' || role, ',' ORDER BY ts, turn) FILTER (WHERE turn > 0) AS comments, count(*) AS total_count FROM {sessions} GROUP BY 1")
def issue_lookup(spark, d):
    """The issue of each key and its comments by time: a conversation's first turn is the issue, the others are its comments."""
    s = sessions(spark, d).select(F.col("conv_id").alias("key"), F.when(F.col("turn") == 0, "jira_issue").otherwise("jira_comment").alias("type"), F.col("text").alias("content"), F.concat(F.col("turn").cast("string"), F.lit(":"), "role").alias("label"), F.struct("ts", "turn").alias("updated"))
    found = search.issue(s, "key")
    return found.select(F.col("key").alias("conv_id"), F.col("issue"), F.nullif(F.array_join("comments.label", ","), F.lit("")).alias("comments"), "total_count")


_ASK = f"SELECT d.doc_id AS query_id, d.prompt, e.embedding AS query FROM {{prompts}} d JOIN embeddings e ON e.vec_id = d.doc_id WHERE d.doc_id % 100 = 0"
_LOW = "lower(prompt)"
_INTENT = "CASE WHEN {why} THEN 'why' WHEN {what} THEN 'what' WHEN {how} THEN 'how' ELSE 'unknown' END".format(**{k: "(" + " OR ".join(f"contains({_LOW}, {_quote(w)})" for w in ws) + ")" for k, ws in (("why", classify.WHY), ("what", classify.WHAT), ("how", classify.HOW))})


@query("V18_subagent_answer", f"""WITH q AS (SELECT *, CASE intent WHEN 'how' THEN 'code-patterns' WHEN 'what' THEN 'conventions' ELSE 'discussions' END AS target FROM (SELECT *, {_INTENT} AS intent FROM ({_ASK}))),
f AS (SELECT q.query_id, m.content, list_cosine_similarity(m.embedding::DOUBLE[], q.query::DOUBLE[]) AS s, row_number() OVER (PARTITION BY q.query_id ORDER BY list_cosine_similarity(m.embedding::DOUBLE[], q.query::DOUBLE[]) DESC, m.point_id) AS r FROM q JOIN {_M} m ON m.collection = q.target WHERE list_cosine_similarity(m.embedding::DOUBLE[], q.query::DOUBLE[]) >= 0 AND (m.collection <> 'code-patterns' OR coalesce(freshness_status <> 'expired', true)))
SELECT q.query_id, any_value(intent) AS intent, any_value(target) AS collection, coalesce(string_agg(content, chr(10) ORDER BY r), 'No relevant memories found.') AS answer, count(content) AS sources, round(CASE WHEN count(content) = 0 THEN 0 ELSE 0.7 * avg(s) + 0.3 * least(count(content) / 3.0, 1) END, 6) AS confidence FROM q LEFT JOIN (SELECT * FROM f WHERE r <= 5) f USING (query_id) GROUP BY 1""")
def subagent(spark, d):
    q = prompts(spark, d).filter("doc_id % 100 = 0").join(table(spark, d, "embeddings"), F.col("vec_id") == F.col("doc_id")).select(F.col("doc_id").alias("query_id"), "prompt", F.col("embedding").alias("query"))
    a = search.answered(memories(spark, d), q.withColumn("intent", classify.intent(F.col("prompt"))), classify.INTENT_COLLECTION, 5)
    return a.select("query_id", "intent", "collection", "answer", "sources", F.round("confidence", 6).alias("confidence"))


def _client():
    """An embedding service that needs no network: hashed words. It times out on every batch once."""
    import hashlib

    seen = set()

    def embed(texts: list[str]) -> list[list[float]]:
        name = hashlib.md5("\n".join(texts).encode()).hexdigest()
        if name not in seen:
            seen.add(name)
            raise providers.Timeout
        out = []
        for t in texts:
            v = [0.0] * 16
            for w in t.lower().split():
                v[hashlib.md5(w.encode()).digest()[0] % 16] += 1.0
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / n for x in v])
        return out

    return embed


def _embed(rows):
    return providers.embedded(rows, _client, sleep=lambda s: None)


@query("V23_embedding_client")
def embedding_client(spark, d):
    return _embed(table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))).select("doc_id", "embedding")


@query("J13_baseline_comparison", """WITH b AS (SELECT event_id AS query_id, event_id % 3 <> 0 AS recalled FROM events WHERE event_type = 'view'), n AS (SELECT event_id AS query_id, event_id % 4 <> 0 AS recalled FROM events WHERE event_type = 'view' AND event_id % 10 <> 7)
SELECT (SELECT count(*) FROM b) AS total_queries, count(*) FILTER (WHERE n.recalled AND NOT b.recalled) AS recall_improved, count(*) FILTER (WHERE b.recalled AND NOT n.recalled) AS recall_regressed, min(n.recalled::INT)::DOUBLE AS min_recall_at_5,
 round(count(*) FILTER (WHERE n.recalled AND NOT b.recalled) / (SELECT count(*) FROM b), 6) AS improvement_pct, round(count(*) FILTER (WHERE b.recalled AND NOT n.recalled) / (SELECT count(*) FROM b), 6) AS regression_pct FROM b JOIN n USING (query_id)""")
def baseline(spark, d):
    e = table(spark, d, "events").filter("event_type = 'view'").select(F.col("event_id").alias("query_id"))
    r = stats.compared(e.withColumn("recalled", F.col("query_id") % 3 != 0), e.filter("query_id % 10 <> 7").withColumn("recalled", F.col("query_id") % 4 != 0))
    return r.withColumn("improvement_pct", F.round("improvement_pct", 6)).withColumn("regression_pct", F.round("regression_pct", 6))


# Providers
def _providers():
    """One that fails on errors, and one that is unsure of what is long."""
    def first(content: str, kind: str) -> tuple[str, float]:
        if content.startswith("error"):
            raise RuntimeError
        return "rule", 0.9

    def second(content: str, kind: str) -> tuple[str, float]:
        return "decision", 0.8 if len(content) % 2 else 0.5

    return {"first": first, "second": second}


@query("K15_provider_chain")
def provider_chain(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 20).alias("caller"), F.col("ts").cast("timestamp").alias("at"), F.concat_ws(" ", "event_type", F.col("value").cast("int").cast("string")).alias("content"), F.lit("user_message").alias("type"))
    return providers.classified(e, "caller", "at", "event_id", _providers, lambda: providers.Guard(failures=2, seconds=7200.0, rate=5e-6, burst=2.0))


# Sync cycles: records of a forge made from the tables
def _landed(spark, d):
    o, c, t = table(spark, d, "orders"), F.col, F.to_json
    k, day = c("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    s = lambda x: x.cast("string")
    review = lambda n, state, body: F.struct((k * 10 + n).alias("id"), state.alias("state"), body.alias("body"), F.lit("rev").alias("user"), day.alias("submitted_at"))
    reviews = F.array(review(1, F.when(k % 2 == 0, "COMMENTED").otherwise("APPROVED"), F.when(k % 3 == 0, "looks fine").otherwise("")), review(2, F.lit("CHANGES_REQUESTED"), F.lit("")))
    pulls = o.filter("o_orderkey % 4 = 0").select(t(F.struct(k.alias("number"), F.concat(F.lit("Change "), "o_orderpriority").alias("title"), F.lit("").alias("body"), F.lit("open").alias("state"), F.when(k % 8 == 0, day).alias("merged_at"), day.alias("updated_at"), F.lit("dev").alias("user"), F.lit("main").alias("base"), F.lit("topic").alias("head"), reviews.alias("reviews"))).alias("raw"))
    issues = o.filter("o_orderkey % 4 = 1").select(t(F.struct(k.alias("number"), F.concat(F.lit("Bug "), s(k)).alias("title"), F.lit("it fails").alias("body"), F.lit("open").alias("state"), F.array(F.lit("bug")).alias("labels"), day.alias("updated_at"), F.when(k % 12 == 1, "yes").alias("pull_request"))).alias("raw"))
    commits = o.filter("o_orderkey % 4 = 2").select(t(F.struct(F.md5(F.encode(s(k), "UTF-8")).alias("sha"), F.concat(F.lit("Fix "), s(k)).alias("message"), F.lit("dev").alias("author"), day.alias("date"), F.array(F.struct(F.lit("src/a.py").alias("filename"), (k % 7).alias("additions"), (k % 3).alias("deletions"))).alias("files"))).alias("raw"))
    runs = o.filter("o_orderkey % 4 = 3").select(t(F.struct(k.alias("id"), F.lit("tests").alias("name"), F.when(k % 5 == 3, "failure").otherwise("success").alias("conclusion"), F.when(k % 7 == 0, "in_progress").otherwise("completed").alias("status"), F.lit("main").alias("head_branch"), F.md5(F.encode(s(k), "UTF-8")).alias("head_sha"), day.alias("created_at"), day.alias("updated_at"))).alias("raw"))
    return {"pull_requests": pulls, "issues": issues, "commits": commits, "ci_results": runs}


_DAY = "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')"
_REVIEWS = f"SELECT o_orderkey || '/' || (o_orderkey * 10 + n) AS item, CASE WHEN n = 2 THEN 'CHANGES_REQUESTED' WHEN o_orderkey % 2 = 0 THEN 'COMMENTED' ELSE 'APPROVED' END AS state, CASE WHEN n = 1 AND o_orderkey % 3 = 0 THEN 'looks fine' ELSE '' END AS body, {_DAY} AS at FROM orders, (SELECT unnest([1, 2]) AS n) WHERE o_orderkey % 4 = 0"


@query("G4_pull_request_sync", f"SELECT 'github_pr_review' AS kind, item, lower(state) AS state FROM ({_REVIEWS}) WHERE NOT (body = '' AND state = 'COMMENTED') UNION ALL SELECT 'github_pr', o_orderkey::VARCHAR, CASE WHEN o_orderkey % 8 = 0 THEN 'merged' ELSE 'open' END FROM orders WHERE o_orderkey % 4 = 0")
def pull_request_sync(spark, d):
    return sync.pull_requests(_landed(spark, d)["pull_requests"]).select("kind", "item", "state")


@query("G5_commit_sync", f"SELECT md5(o_orderkey::VARCHAR) AS item, 'Commit ' || substr(md5(o_orderkey::VARCHAR), 1, 8) || ': Fix ' || o_orderkey || chr(10) || chr(10) || 'Stats: ' || (o_orderkey % 7 + o_orderkey % 3) || ' changes (+' || (o_orderkey % 7) || ' -' || (o_orderkey % 3) || ')' || chr(10) || 'Files: src/a.py' || chr(10) || 'Author: dev' AS content, {_DAY} AS at FROM orders WHERE o_orderkey % 4 = 2")
def commit_sync(spark, d):
    return sync.commits(_landed(spark, d)["commits"]).select("item", "content", "at")


@query("G6_ci_sync", f"SELECT o_orderkey::VARCHAR AS item, CASE WHEN o_orderkey % 5 = 3 THEN 'failure' ELSE 'success' END AS state, 'CI tests: ' || CASE WHEN o_orderkey % 5 = 3 THEN 'failure' ELSE 'success' END || chr(10) || 'Branch: main | Commit: ' || substr(md5(o_orderkey::VARCHAR), 1, 8) || CASE WHEN o_orderkey % 5 = 3 THEN chr(10) || 'Status: FAILED -- check workflow logs for details' ELSE '' END AS content FROM orders WHERE o_orderkey % 4 = 3 AND o_orderkey % 7 <> 0")
def ci_sync(spark, d):
    return sync.ci_results(_landed(spark, d)["ci_results"]).select("item", "state", "content")


_CUT = "1995-01-01T00:00:00Z"


@query("G1_sync_cycle", f"""WITH r AS (SELECT 'pull_requests' AS name, "at" FROM ({_REVIEWS}) WHERE NOT (body = '' AND state = 'COMMENTED') UNION ALL SELECT 'pull_requests', {_DAY} FROM orders WHERE o_orderkey % 4 = 0
 UNION ALL SELECT 'issues', {_DAY} FROM orders WHERE o_orderkey % 4 = 1 AND o_orderkey % 12 <> 1 UNION ALL SELECT 'commits', {_DAY} FROM orders WHERE o_orderkey % 4 = 2 UNION ALL SELECT 'ci_results', {_DAY} FROM orders WHERE o_orderkey % 4 = 3 AND o_orderkey % 7 <> 0)
SELECT name, count(*) FILTER (WHERE "at" > '{_CUT}' OR name = 'commits') AS synced, count(*) FILTER (WHERE name = 'commits') AS skipped_again, max("at") AS cursor FROM r GROUP BY 1""")
def sync_cycle(spark, d):
    """Two cycles: the first takes what is later than the cursors (commits have none); the second, full for commits, finds them stored."""
    landed = _landed(spark, d)
    none = spark.createDataFrame([], "kind string, item string, content_hash string, version int, is_current boolean, synced_at long, supersedes int")
    cursors = spark.createDataFrame([(n, _CUT) for n in ("pull_requests", "issues", "ci_results")], "name string, last_synced string")
    store, moved, first = sync.cycle(none, cursors, landed, 100)
    _, _, second = sync.cycle(store, moved.filter("name <> 'commits'"), {"commits": landed["commits"]}, 200)
    return first.join(second.select("name", F.col("skipped").alias("again")), "name", "left").join(moved, "name").select("name", "synced", F.coalesce("again", F.lit(0)).alias("skipped_again"), F.col("last_synced").alias("cursor"))


# Backfills
_B2 = "(SELECT doc_id, prompt, CASE WHEN doc_id % 2 = 0 THEN 'user_message' ELSE 'agent_response' END AS current FROM {prompts} WHERE doc_id % 5 <> 4)"


@query("B2_reclassification", f"""SELECT doc_id, kind AS type, current AS old_type FROM (SELECT doc_id, current, CASE WHEN s NOT IN ('skip', 'low') AND kind IS NOT NULL THEN kind ELSE current END AS kind FROM (SELECT *, {_SIG} AS s, {_RULE} AS kind FROM {_B2})) WHERE kind <> current""")
def reclassification(spark, d):
    """Two runs: the second takes up where the first stopped."""
    rows = prompts(spark, d).select("doc_id", F.col("prompt").alias("content"), F.when(F.col("doc_id") % 5 == 4, "session").when(F.col("doc_id") % 2 == 0, "user_message").otherwise("agent_response").alias("type"))
    first, checkpoint = backfill.reclassified(rows, None, classify.classified, most=100, key="doc_id")
    second, _ = backfill.reclassified(rows, checkpoint, classify.classified, key="doc_id")
    return first.unionByName(second)


@query("B8_reembedding", f"SELECT count(*) AS total, count(*) FILTER (WHERE vec_id % 15 <> 0 AND vec_id % 25 <> 5) AS processed, count(*) FILTER (WHERE vec_id % 15 = 0) AS skipped, count(*) FILTER (WHERE vec_id % 15 <> 0 AND vec_id % 25 = 5) AS already FROM {_M} WHERE collection = 'code-patterns'")
def reembedding(spark, d):
    m = memories(spark, d).filter("collection = 'code-patterns'").select("vec_id", "point_id", F.when(F.col("vec_id") % 15 == 0, " ").otherwise(F.col("content")).alias("content"))
    return backfill.reembedded(m, _embed, m.filter("vec_id % 25 = 5 AND vec_id % 15 <> 0"))[1]


_LINES = ['{"content": "a %s", "group_id": "g", "memory_type": "rule"}', '{"content": "b %s", "group_id": "g", "memory_type": "rule"', '{"content": "c %s"}', '{"content": "d', "  ", "plain %s", '{"content": "e %s"']
_STATES = ["valid", "recovered", "incomplete", "broken", None, "broken", "broken"]


@query("B10_queue_repair", f"SELECT coalesce(state, 'blank') AS state, count(*) AS n FROM (SELECT {tables.pick_sql(_STATES, 'doc_id')} AS state FROM documents) WHERE state IS NOT NULL GROUP BY 1")
def repair(spark, d):
    out = _shared(spark, "queue-lines")
    table(spark, d, "documents").select(F.replace(tables.pick(_LINES, F.col("doc_id")), F.lit("%s"), F.col("doc_id").cast("string")).alias("value")).write.text(out)
    return backfill.repaired(spark.read.text(out)).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


# Evaluation
_E_SAMPLED = "('0x' || substr(md5(event_id::VARCHAR), 1, 6))::BIGINT % 100 < 40"
_E_JUDGED = "WITH t AS (SELECT *, event_type IN ('view', 'click') AS fits FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15'), s AS (SELECT * FROM t WHERE fits AND " + _E_SAMPLED + " AND event_id % 9 <> 0)"


@query("E2_trace_evaluator", _E_JUDGED + " SELECT (SELECT count(*) FROM t) AS fetched, count(*) AS sampled, count(*) FILTER (WHERE event_id % 11 <> 0) AS scored, round(avg(least(value, 100) / 100) FILTER (WHERE event_id % 11 <> 0), 6) AS mean FROM s")
def trace_evaluator(spark, d):
    return _judged(spark, d).agg(F.count(F.lit(1)).alias("fetched"), F.count_if("sampled").alias("sampled"), F.count("score").alias("scored"), F.round(F.avg("score"), 6).alias("mean"))


def _judged(spark, d):
    e = table(spark, d, "events").withColumn("output", F.when(F.col("event_id") % 9 != 0, F.col("props")))
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    judge = F.when(F.col("event_id") % 11 != 0, F.least(F.col("value"), F.lit(100.0)) / 100)  # an answer that cannot be read scores nothing
    return stats.evaluated(e, "event_id", "ts", at("2024-01-08"), at("2024-01-15"), F.col("event_type").isin("view", "click"), 0.4, judge)


# Evaluators and the score below which each alerts.
THRESHOLDS = {"retrieval_relevance": 0.7, "injection_value": 0.6, "capture_completeness": 0.9, "classification_accuracy": 0.8, "bootstrap_quality": 0.7, "session_coherence": 0.7}


@query("E3_alert_thresholds", f"WITH s AS (SELECT {tables.pick_sql(list(THRESHOLDS), 'event_id')} AS evaluator, least(value, 100) / 100 + 0.15 * (event_id % 4) AS score FROM events) SELECT evaluator, round(avg(score), 6) AS score, avg(score) < CASE evaluator " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in THRESHOLDS.items()) + " END AS alert FROM s GROUP BY 1")
def alerts(spark, d):
    e = table(spark, d, "events").select(tables.pick(list(THRESHOLDS), F.col("event_id")).alias("evaluator"), (F.least(F.col("value"), F.lit(100.0)) / 100 + 0.15 * (F.col("event_id") % 4)).alias("score"))
    return stats.alerts(e, THRESHOLDS).withColumn("score", F.round("score", 6))


@query("E4_routing_dataset", "SELECT prompt, expected FROM (VALUES " + ", ".join(f"({_quote(p + ' the cache layer')}, {_quote(e)})" for p, e in classify.routing_cases()) + ") v(prompt, expected)")
def routing_dataset(spark, d):
    """Every trigger phrase is a case: what it is routed to is compared with what its list stands for."""
    p = spark.createDataFrame([(c + " the cache layer",) for c, _ in classify.routing_cases()], "prompt string")
    return p.select("prompt", F.array_join(classify.routes(F.col("prompt")), ",").alias("expected"))


@query("E4_chunking_dataset", "SELECT * FROM (VALUES ('short prose', 1), ('long prose', 3), ('python', 2), ('script', 2), ('go', 2), ('rust', 2), ('large function', 2), ('plain code', 1)) v(case_name, chunks)")
def chunking_dataset(spark, d):
    paragraph = "A sentence of some words stands here. " * 40
    body = "\n".join(f"    value_{k} = compute(value_{k - 1}, {k})" for k in range(1, 31))
    cases = [("short prose", "a.md", "One line."), ("long prose", "a.md", "\n\n".join([paragraph] * 3)), ("python", "a.py", "import os\n\ndef f():\n    return 1\n\nclass A:\n    x = 1\n"), ("script", "a.ts", "import a from 'a'\nexport function f(x) {\n  return x\n}\nconst g = (y) => {\n  return y\n}\n"), ("go", "a.go", 'package a\n\nimport "fmt"\n\nfunc F() {\n\tfmt.Println("}")\n}\n\ntype T struct {\n\tx int\n}\n'), ("rust", "a.rs", "use std::fmt;\n\n#[derive(Debug)]\nstruct S {\n    x: i32,\n}\n\nimpl S {\n    fn f(&self) -> i32 { 1 }\n}\n"), ("large function", "a.py", f"def f(value_0):\n{body}\n    return value_30\n"), ("plain code", "a.py", "x = 1\ny = 2\n")]
    rows = spark.createDataFrame(cases, "case_name string, path string, content string")
    n = F.size(chunking.column(lambda t, p: code.chunks(t, p) if code.language(p) else chunking.prose_chunks(t), "array<string>", F.col("content"), F.col("path")))
    return rows.select("case_name", n.alias("chunks"))


# Structure of code
@query("C6_sentence_accumulation")
def sentence_accumulation(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(chunking.column(lambda t: chunking.by_sentences(t, 400, 80), "array<string>", F.col("text"))).alias("i", "piece"))


@query("C7_word_split")
def word_split(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(chunking.column(lambda t: chunking.by_words(t, 60), "array<string>", F.col("text"))).alias("i", "piece"))


@query("C8_overlap")
def overlap(spark, d):
    plain = lambda t: [p.strip() for p in t.split("\n") if p.strip()]
    return table(spark, d, "documents").select("doc_id", F.posexplode(chunking.column(lambda t: chunking.with_overlap(plain(t), 600), "array<string>", F.col("text"))).alias("i", "piece"))


def _large(spark, d):
    """Functions with a statement for each line of a text."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit('    note("'), F.regexp_replace(x, '["\\\\]', ""), F.lit('")')))
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("import os\n\ndef f():\n"), F.array_join(lines, "\n"), F.lit("\n\n\ndef g():\n    return 1\n")).alias("content"))


@query("C10_split_large_nodes")
def split_large(spark, d):
    return _large(spark, d).select("doc_id", F.posexplode(chunking.column(lambda t: code.chunks(t, "a.py"), "array<string>", F.col("content"))).alias("i", "chunk"))


@query("C13_sub_chunks")
def sub_chunks(spark, d):
    return _large(spark, d).select("doc_id", F.posexplode(chunking.column(lambda t: chunking.sub_chunks(t, 1024), "array<string>", F.col("content"))).alias("i", "chunk"))


_NAMES = lambda q: F.array_join(chunking.column(q, "array<string>", F.col("content")), ",")
_PY = "(SELECT doc_id, 'import os.path, ' || lang || chr(10) || 'from ' || source || ' import b' || chr(10) || chr(10) || 'class K' || doc_id || ':' || chr(10) || '    def m' || (doc_id % 7) || '(self):' || chr(10) || '        import late' || chr(10) || '        return 1' || chr(10) AS content, lang, source FROM documents)"


def _python(spark, d):
    k = F.col("doc_id").cast("string")
    body = F.concat(F.lit("import os.path, "), "lang", F.lit("\nfrom "), "source", F.lit(" import b\n\nclass K"), k, F.lit(":\n    def m"), (F.col("doc_id") % 7).cast("string"), F.lit("(self):\n        import late\n        return 1\n"))
    return table(spark, d, "documents").select("doc_id", body.alias("content"))


@query("K24_python_structure", f"SELECT doc_id, 'K' || doc_id || ',m' || (doc_id % 7) AS symbols, array_to_string(list_distinct_ordered, ',') AS imports FROM (SELECT doc_id, CASE WHEN lang = source THEN ['os', lang, 'late'] ELSE ['os', lang, source, 'late'] END AS list_distinct_ordered FROM {_PY})")
def structure(spark, d):
    return _python(spark, d).select("doc_id", _NAMES(chunking.python_symbols).alias("symbols"), _NAMES(chunking.python_imports).alias("imports"))


@query("K25_imports", f"SELECT doc_id, (CASE WHEN lang = source THEN 3 ELSE 4 END)::INT AS n FROM {_PY}")
def imports(spark, d):
    return _python(spark, d).select("doc_id", F.size(chunking.column(chunking.python_imports, "array<string>", F.col("content"))).alias("n"))


@query("C29_document_tree", "SELECT doc_id, source || chr(10) || '- ' || lang || chr(10) || '- ' || text || chr(10) || '  1. deep' AS text FROM documents")
def document_tree(spark, d):
    """Rich-text trees that carry whole texts."""
    t = lambda c: F.struct(F.lit("text").alias("type"), c.alias("text"))
    para = lambda c: F.struct(F.lit("paragraph").alias("type"), F.array(t(c)).alias("content"))
    leaf = lambda c: F.to_json(F.struct(F.lit("listItem").alias("type"), F.array(para(c)).alias("content")))
    deep = F.concat(F.lit('{"type":"listItem","content":['), F.to_json(para(F.col("text"))), F.lit(',{"type":"orderedList","content":[{"type":"listItem","content":[{"type":"paragraph","content":[{"type":"text","text":"deep"}]}]}]}]}'))
    head = F.to_json(F.struct(F.lit("heading").alias("type"), F.array(t(F.col("source"))).alias("content")))
    raw = F.concat(F.lit('{"type":"doc","content":['), head, F.lit(',{"type":"bulletList","content":['), leaf(F.col("lang")), F.lit(","), deep, F.lit("]}]}"))
    return table(spark, d, "documents").select("doc_id", chunking.column(chunking.document_tree, "string", raw).alias("text"))


@query("C36_tags", "SELECT doc_id, array_to_string(list_transform(list_sort(list_distinct([{'p': list_position(t, x), 'x': x} for x in t])), lambda s: s.x), ',') AS tags FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN [lang, lower(source), 'a'] WHEN 1 THEN [lower(source)] ELSE [lang, lower(source)] END AS t FROM documents)")
def front_tags(spark, d):
    k = F.col("doc_id") % 3
    line = F.when(k == 0, F.concat(F.lit("["), F.upper("lang"), F.lit(", '"), "source", F.lit("', \"a\"]"))).when(k == 1, F.upper("source")).otherwise("")
    below = F.when(k == 2, F.concat(F.lit("title: x\ntags:\n  - "), F.upper("lang"), F.lit("\n  - "), "source", F.lit("\n"))).otherwise("")
    return table(spark, d, "documents").select("doc_id", F.array_join(files.tags(line, below), ",").alias("tags"))


@query("K32_payload_normalisation", "SELECT doc_id AS id, text AS content FROM documents")
def normalised(spark, d):
    body = F.struct(F.col("text").alias("content"))
    raw = F.when(F.col("doc_id") % 3 == 0, F.to_json(body)).when(F.col("doc_id") % 3 == 1, F.to_json(F.struct(body.alias("payload")))).otherwise(F.to_json(F.struct(body.alias("tool_input"))))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce(*(F.get_json_object(raw, p) for p in ("$.content", "$.payload.content", "$.tool_input.content"))).alias("content"))


# Files
def _lines(spark, rows: list[tuple[str, str]], out: str) -> str:
    """Writes small files through Spark; each is a folder of one part."""
    for name, body in rows:
        spark.createDataFrame([(body,)], "value string").coalesce(1).write.text(f"{out}/{name}")
    return out


@query("P8_constraints", "SELECT 'be brief' || chr(10) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'phase: test' || chr(10) || chr(10) || chr(10) || '---' || chr(10) || 'Constraints loaded: 1 global + 1 phase-specific' AS text UNION ALL SELECT 'be brief' || chr(10) || chr(10) || chr(10) || '---' || chr(10) || 'Constraints loaded: 1 global + 0 phase-specific'")
def constraints(spark, d):
    out = _lines(spark, [("global/CONSTRAINTS.md", "be brief"), ("execution/constraints.md", "phase: test"), ("planning/constraints.md", "other")], _shared(spark, "constraints"))
    return files.constraints(spark, out, "exec/../ution").unionByName(files.constraints(spark, out, "none"))


@query("S20_handoff_files", "SELECT * FROM (VALUES ('2026-01-05', 12::DOUBLE), ('2026-02-03', NULL)) v(date, number)")
def handoff_files(spark, d):
    out = _lines(spark, [("SESSION_HANDOFF_2026-01-05_b.md", "# Handoff\n**Session**: PM #12\n" + "x" * 600 + "\n**Session**: PM #99"), ("SESSION_HANDOFF_2026-02-03.md", "y" * 600 + "\n**Session**: PM #7")], _shared(spark, "handoffs"))
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").text(out, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("path"), F.col("value").alias("body"))
    return files.handoff_rows(raw).select(F.col("date").cast("string").alias("date"), F.col("number").cast("double").alias("number"))


@query("S21_template_files", "SELECT * FROM (VALUES ('python', 'a,b'), ('go', '')) v(domain, tags)")
def template_files(spark, d):
    out = _lines(spark, [("t.json", '[{"content": "use short functions", "domain": "Python", "tags": ["A", "a ", "b"]}, {"content": "wrap errors with context", "domain": "go"}, {"content": "x", "domain": "d"}, {"content": "long enough but for no domain"}]')], _shared(spark, "templates"))
    return files.templates(spark, f"{out}/t.json").select("domain", F.array_join("tags", ",").alias("tags"))


@query("S23_project_configs", "SELECT * FROM (VALUES ('alpha', 'org/alpha', 'main'), ('beta', 'org/beta', 'dev')) v(project_id, github_repo, github_branch)")
def project_configs(spark, d):
    rows = [("a.yaml", "project_id: alpha\ngithub:\n  repo: org/alpha\n"), ("a.yml", "project_id: shadow\n"), ("b.yml", "project_id: 'beta'\ngithub:\n  repo: org/beta\n  branch: dev\n"), ("c.yaml", "github:\n  repo: org/none\n")]
    raw = spark.createDataFrame([(f"/projects.d/{n}", b) for n, b in rows], "path string, text string")
    return files.project_rows(raw).select("project_id", "github_repo", "github_branch")


# Capture
@query("T8_batch_flusher", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def batch_flusher(spark, d):
    out, source = _shared(spark, "flushed"), _shared(spark, "captured")
    table(spark, d, "events").select("event_id", "event_type").repartition(4).write.parquet(source)
    stream = spark.readStream.schema("event_id long, event_type string").option("maxFilesPerTrigger", 1).parquet(source)
    state.flushed(stream, out, _shared(spark, "flushed-at")).awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("T12_concurrent_capture", "SELECT role, count(*) AS n FROM conversations GROUP BY 1")
def concurrent_capture(spark, d):
    c, out = table(spark, d, "conversations").select("role", "turn"), _shared(spark, "captures")
    state.captured({r: c.filter(F.col("role") == r) for r in ("user", "assistant", "system")}, out, 600.0)
    return spark.read.schema("turn long, role string").parquet(out).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query("T9_evict_traces", "SELECT event_id FROM (SELECT event_id, sum(length(props)) OVER (ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS s FROM events WHERE event_type = 'error') WHERE s <= 2000")
def evict_traces(spark, d):
    e = table(spark, d, "events").filter("event_type = 'error'").select("ts", "event_id", F.length("props").alias("bytes"))
    return stats.newest_within(e, "ts", "event_id", "bytes", 2000).select("event_id")
