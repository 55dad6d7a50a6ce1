"""Queries of text functions: hashing, truncation, classification, routing, scanning."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import chunking, classify, scan, text, validation
from tessera.plans import tables
from tessera.plans.registry import query
from tessera.plans.tables import code, exposed, memories, prompts, table


def _sql_any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


def _sql_map(column: str, values: dict, other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {other} END"


def _re(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def simple(name: str, source, key: str, sql: str | None, **columns: Callable[[], Column]) -> None:
    """A query of one projection. Its columns are built when it is asked for, as they need a session."""
    query(name, sql)(lambda spark, d: source(spark, d).select(key, *(c().alias(n) for n, c in columns.items())))


def _docs(spark, d):
    return table(spark, d, "documents")


_P = lambda: F.col("prompt")
_T = lambda: F.col("text")
_C = lambda: F.col("content")
_F = lambda: F.col("file_path")
_TRIM = r"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"

simple("C3_token_estimate", _docs, "doc_id", "SELECT doc_id, (length(text) // 4)::INT AS tokens FROM documents", tokens=lambda: text.estimated_tokens(_T()))
_LAST = "length(p) - strpos(reverse(p), '{s}')"
simple("C20_smart_truncate", _docs, "doc_id", f"""SELECT doc_id, CASE WHEN length(text) <= 200 THEN text WHEN contains(p, '.') AND {_LAST.format(s='.')} > 0 THEN substr(text, 1, {_LAST.format(s='.')} + 1) || '...'
  WHEN contains(p, '!') AND {_LAST.format(s='!')} > 0 THEN substr(text, 1, {_LAST.format(s='!')} + 1) || '...' WHEN contains(p, '?') AND {_LAST.format(s='?')} > 0 THEN substr(text, 1, {_LAST.format(s='?')} + 1) || '...'
  WHEN contains(p, ' ') AND {_LAST.format(s=' ')} > 0 THEN rtrim(substr(p, 1, {_LAST.format(s=' ')})) || '...' ELSE rtrim(p) || '...' END AS cut FROM (SELECT *, substr(text, 1, 197) AS p FROM documents)""", cut=lambda: text.truncated_at_sentence(_T(), 200))
simple("C21_hard_cap", _docs, "doc_id", "SELECT doc_id, CASE WHEN length(text) <= 500 THEN text ELSE substr(text, 1, 488) || ' [TRUNCATED]' END AS cut FROM documents", cut=lambda: text.capped(_T(), 500))
simple("C22_content_hash", _docs, "doc_id", "SELECT doc_id, sha256(text) AS hash FROM documents", hash=lambda: text.content_hash(_T()))
simple("C23_prefixed_hash", _docs, "doc_id", "SELECT doc_id, 'sha256:' || sha256(text) AS hash FROM documents", hash=lambda: text.content_hash(_T(), "sha256:"))
simple("C24_project_hash", code, "doc_id", "SELECT doc_id, substr(sha256('/home/' || file_path), 1, 12) AS hash FROM {code}", hash=lambda: text.short_hash(F.concat(F.lit("/home/"), _F()), 12))
simple("C25_score_id", memories, "point_id", "SELECT point_id, md5(point_id || ':' || session_id || ':relevance:2024') AS score_id FROM {memories}", score_id=lambda: text.score_id(F.col("point_id"), F.col("session_id"), F.lit("relevance"), F.lit("2024")))
simple("C26_project_name", prompts, "doc_id", r"SELECT doc_id, CASE WHEN z = '' THEN 'unnamed-project' ELSE z END AS project FROM (SELECT doc_id, regexp_replace(substr(regexp_replace(regexp_replace(regexp_replace(lower(prompt), '[^a-z0-9-]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'), 1, 50), '-$', '') AS z FROM {prompts})", project=lambda: text.project_name(_P()))
_URLS = ["https://git.example.org/Org/Repo.git", "git@git.example.org:Team/tool.git", "https://git.example.org/a/b", "not a url", " git@h:x/y ", ""]
simple("C27_repository_slug", _docs, "doc_id", f"SELECT doc_id, lower(coalesce(nullif(regexp_extract(u, '^git@[^:]+:([^/]+/[^/]+?)(?:\\.git)?$', 1), ''), nullif(regexp_extract(u, '^https?://[^/]+/([^/]+/[^/]+?)(?:\\.git)?$', 1), ''))) AS slug FROM (SELECT doc_id, trim({tables.pick_sql(_URLS, 'doc_id')}) AS u FROM documents)", slug=lambda: text.repository_slug(tables.pick(_URLS, F.col("doc_id"))))
_FOLDERS, _NAMED, _REMOTES = ["/", "/home/ann", "/tmp", "/tmp/build-7", "/var/tmp/mine", "/home/ann/My App/", "/srv/Some_Thing", None], ["", None, "  ", "Env Project!"], [None, "git@git.example.org:Team/tool.git", "no address"]
_PLACE = "CASE WHEN regexp_full_match(folder, '/+') THEN '/' ELSE regexp_replace(folder, '/+$', '') END"
_NAME = r"coalesce(nullif(regexp_replace(substr(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9-]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'), 1, 50), '-$', ''), ''), 'unnamed-project')"
simple("C28_project_detection", memories, "point_id", f"""SELECT point_id, CASE WHEN trim(coalesce(named, '')) <> '' THEN {_NAME.format(x='named')} WHEN folder IS NULL THEN 'unknown-project' WHEN place = '/' THEN 'root-project' WHEN place = '/home/ann' THEN 'home-project'
  WHEN place IN ('/tmp', '/var/tmp') OR (regexp_replace(place, '/[^/]*$', '') IN ('/tmp', '/var/tmp') AND regexp_matches(lower(split_part(place, '/', -1)), 'build|tmp|cache|temp')) THEN 'temp-project'
  ELSE coalesce(lower(nullif(regexp_extract(remote, '^git@[^:]+:([^/]+/[^/]+?)(?:\\.git)?$', 1), '')), {_NAME.format(x="split_part(place, '/', -1)")}) END AS project
  FROM (SELECT *, {_PLACE} AS place FROM (SELECT point_id, {tables.pick_sql(_FOLDERS, 'vec_id')} AS folder, {tables.pick_sql(_NAMED, 'vec_id // 3')} AS named, {tables.pick_sql(_REMOTES, 'vec_id // 8')} AS remote FROM {{memories}}))""",
       project=lambda: text.project(tables.pick(_NAMED, F.floor(F.col("vec_id") / 3)), tables.pick(_FOLDERS, F.col("vec_id")), F.lit("/home/ann"), tables.pick(_REMOTES, F.floor(F.col("vec_id") / 8))))
simple("C33_issue_display", memories, "point_id", "SELECT point_id, 'https://' || group_id || '.example.net/browse/PROJ-' || vec_id || CASE WHEN vec_id % 3 = 0 THEN '?focusedCommentId=' || label ELSE '' END AS url, concat_ws(' ', '[Type: ' || type || ']', '[Status: ' || freshness_status || ']', '[Author: ' || source || ']') AS badges, CASE WHEN length(content) <= 20 THEN content ELSE substr(content, 1, 20) || '...' END AS snippet FROM {memories}",
       url=lambda: text.issue_url(F.concat(F.col("group_id"), F.lit(".example.net")), F.concat(F.lit("PROJ-"), F.col("vec_id").cast("string")), F.when(F.col("vec_id") % 3 == 0, F.col("label").cast("string"))), badges=lambda: text.badges(("Type", F.col("type")), ("Status", F.col("freshness_status")), ("Author", F.col("source"))), snippet=lambda: text.snippet(_C(), 20))
_DURATIONS = ["30d", "2w", "3m", "1y", "x", "10", "d", "7 d"]
simple("C37_duration", _docs, "doc_id", f"SELECT doc_id, CASE WHEN regexp_full_match(u, '[0-9]+[dwmy]') THEN regexp_extract(u, '^[0-9]+')::INT * CASE right(u, 1) WHEN 'd' THEN 1 WHEN 'w' THEN 7 WHEN 'm' THEN 30 ELSE 365 END END::DOUBLE AS days FROM (SELECT doc_id, {tables.pick_sql(_DURATIONS, 'doc_id')} AS u FROM documents)", days=lambda: text.duration_days(tables.pick(_DURATIONS, F.col("doc_id"))).cast("double"))
simple("C18_first_last", _docs, "doc_id", "SELECT doc_id, CASE WHEN len(w) <= 20 THEN array_to_string(w, ' ') ELSE array_to_string(w[1:14], ' ') || chr(10) || chr(10) || '[... truncated middle ...]' || chr(10) || chr(10) || array_to_string(w[-6:], ' ') END AS cut FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)", cut=lambda: text.first_and_last(F.split(_T(), " "), 20))
simple("C2_content_type", code, "doc_id", "SELECT doc_id, CASE WHEN lower(file_path) LIKE '%.py' OR lower(file_path) LIKE '%.ts' OR lower(file_path) LIKE '%.js' THEN 'code' WHEN lower(file_path) LIKE '%.md' THEN 'prose' ELSE 'unknown' END AS kind FROM {code}",
       kind=lambda: F.when(text.extension(_F()).isin(".py", ".ts", ".js"), "code").when(text.extension(_F()) == ".md", "prose").otherwise("unknown"))
simple("C14_context_header", memories, "point_id", "SELECT point_id, '# File: ' || file_path || CASE WHEN vec_id % 3 = 2 THEN ' | Class: ' || type || ' | Method: ' || group_id WHEN vec_id % 3 = 1 THEN ' | Symbol: ' || type ELSE '' END || CASE WHEN vec_id % 2 = 1 THEN ' | Imports: os, sys' ELSE '' END || ' | Language: ' || collection AS header FROM {memories}",
       header=lambda: text.context_header(_F(), F.slice(F.array("type", "group_id"), F.lit(1), (F.col("vec_id") % 3).cast("int")), F.slice(F.array(F.lit("os"), F.lit("sys")), F.lit(1), (F.col("vec_id") % 2 * 2).cast("int")), F.col("collection")))

_LOW = "lower(prompt)"
_INTENT = f"CASE WHEN {_sql_any(_LOW, classify.WHY)} THEN 'why' WHEN {_sql_any(_LOW, classify.WHAT)} THEN 'what' WHEN {_sql_any(_LOW, classify.HOW)} THEN 'how' ELSE 'unknown' END"
simple("K1_intent", prompts, "doc_id", f"SELECT doc_id, {_INTENT} AS intent FROM {{prompts}}", intent=lambda: classify.intent(_P()))
simple("K2_intent_target", prompts, "doc_id", f"SELECT doc_id, CASE intent WHEN 'how' THEN 'code-patterns' WHEN 'what' THEN 'conventions' ELSE 'discussions' END AS collection, CASE intent WHEN 'how' THEN 'implementation,error_pattern,refactor,file_pattern' WHEN 'what' THEN 'rule,guideline,port,naming,structure' WHEN 'why' THEN 'decision,session,blocker,preference,context' ELSE '' END AS types FROM (SELECT doc_id, {_INTENT} AS intent FROM {{prompts}})",
       collection=lambda: classify.mapped(classify.INTENT_COLLECTION, classify.intent(_P())), types=lambda: classify.mapped({k: ",".join(v) for k, v in classify.INTENT_TYPES.items()}, classify.intent(_P())))


def _first(phrases: list[str]) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN contains({_LOW}, {_re(p)}) THEN {_re(p)} END" for p in phrases) + ")"


def _topic(phrases: list[str], other: str) -> str:
    after = _TRIM.format(x=f"substr(prompt, strpos({_LOW}, p) + length(p))")
    topic = _TRIM.format(x=f"regexp_replace({after}, '\\?+$', '')")
    return f"SELECT doc_id, CASE WHEN p IS NULL THEN NULL WHEN {topic} <> '' THEN {topic} ELSE {other} END AS topic FROM (SELECT *, {_first(phrases)} AS p FROM {{prompts}})"


simple("K4_decision_topic", prompts, "doc_id", _topic(classify.DECISION_PHRASES, _TRIM.format(x=r"regexp_replace(prompt, '\?+$', '')")), topic=lambda: classify.decision_topic(_P()))
simple("K5_session_topic", prompts, "doc_id", _topic(classify.SESSION_PHRASES, "p"), topic=lambda: classify.session_topic(_P()))
_fill = _TRIM.format(x=f"regexp_replace(substr(prompt, strpos({_LOW}, p) + length(p)), '^[esES]+', '')")
for _w in classify.FILLERS:
    _fill = f"regexp_replace({_fill}, '^(?i:{_w}) ', '')"
_fill = _TRIM.format(x=f"regexp_replace({_fill}, '\\?+$', '')")
_before = f"list_filter(regexp_split_to_array(substr(prompt, 1, strpos({_LOW}, p) - 1), '\\s+'), lambda x: x <> '')"
simple("K6_practice_topic", prompts, "doc_id", f"SELECT doc_id, CASE WHEN p IS NULL THEN NULL WHEN t <> '' THEN t ELSE nullif(array_to_string(b[greatest(len(b) - 2, 1):], ' '), '') END AS topic FROM (SELECT doc_id, p, {_fill} AS t, {_before} AS b FROM (SELECT *, {_first(classify.PRACTICE_PHRASES)} AS p FROM {{prompts}}))", topic=lambda: classify.practice_topic(_P()))
_PATH = r"(?i)(?:[a-z_][\w/\\.-]*\.(?:py|ts|tsx|js|jsx|go|rs|java|cpp|c|h|rb|php|css|html|yaml|yml|json|toml|md|sh|sql)|/(?:src|lib|tests?|scripts?|docker|hooks?)/)"
simple("K3_routes", prompts, "doc_id", f"""SELECT doc_id, CASE WHEN d OR s OR b THEN concat_ws(',', CASE WHEN d OR s THEN 'discussions' END, CASE WHEN b THEN 'conventions!' END) WHEN regexp_matches(prompt, {_re(_PATH)}) THEN 'code-patterns'
  WHEN i = 'unknown' THEN 'discussions,code-patterns,conventions!' WHEN i = 'what' THEN 'conventions!' WHEN i = 'how' THEN 'code-patterns' ELSE 'discussions' END AS routes
  FROM (SELECT *, {_first(classify.DECISION_PHRASES)} IS NOT NULL AS d, {_first(classify.SESSION_PHRASES)} IS NOT NULL AS s, {_first(classify.PRACTICE_PHRASES)} IS NOT NULL AS b, {_INTENT} AS i FROM {{prompts}})""", routes=lambda: F.array_join(classify.routes(_P()), ","))
_EXC = r"(?s)\b(\w+(?:Error|Exception)):\s*([^\n]+)"
_marked = "coalesce(" + ", ".join(f"CASE WHEN contains(prompt, '{m}') THEN substr({_TRIM.format(x=f'split_part(substr(prompt, strpos(prompt, {_re(m)})), chr(10), 1)')}, 1, 150) END" for m in classify.ERROR_MARKS) + ")"
simple("K7_error_signature", prompts, "doc_id", f"""SELECT doc_id, CASE WHEN {_TRIM.format(x='prompt')} = '' THEN NULL WHEN regexp_matches(prompt, {_re(_EXC)}) THEN regexp_extract(prompt, {_re(_EXC)}, 1) || ': ' || substr({_TRIM.format(x=f'regexp_extract(prompt, {_re(_EXC)}, 2)')}, 1, 100)
  WHEN contains(prompt, 'Traceback') THEN 'Traceback detected' ELSE {_marked} END AS signature FROM {{prompts}}""", signature=lambda: classify.error_signature(_P()))
_told = f"list_filter(l, lambda x: {_sql_any('lower(x)', classify.ERROR_WORDS)})"
_lines = f"list_transform(string_split({_TRIM.format(x='prompt')}, chr(10)), lambda x: {_TRIM.format(x='x')})"
simple("K8_output_signature", prompts, "doc_id", f"SELECT doc_id, substr(coalesce({_told}[1], list_filter(l, lambda x: x <> '')[-1], 'Error detected in command output'), 1, 200) AS signature FROM (SELECT doc_id, {_lines} AS l FROM {{prompts}})", signature=lambda: classify.output_signature(_P()))
_SIG = f"""CASE WHEN length({_TRIM.format(x='prompt')}) < 20 THEN 'skip' WHEN regexp_matches({_TRIM.format(x='prompt')}, '(?i)^(ok|okay|yes|no|sure|thanks|thank you|got it|done|yep|nope)\\.?$') THEN 'skip' WHEN regexp_matches({_TRIM.format(x='prompt')}, {_re(classify.LOW_PATTERN)}) THEN 'low'
  WHEN """ + " OR ".join(f"regexp_matches(prompt, {_re(p)})" for p in classify.HIGH_PATTERNS) + " THEN 'high' ELSE 'medium' END"
simple("K10_significance", prompts, "doc_id", f"SELECT doc_id, {_SIG} AS significance FROM {{prompts}}", significance=lambda: classify.significance(_P()))
simple("K11_significance_behaviour", prompts, "doc_id", f"SELECT doc_id, s <> 'skip' AS store, s IN ('high', 'medium') AS embed, CASE s WHEN 'medium' THEN 90 WHEN 'low' THEN 30 END::DOUBLE AS ttl_days FROM (SELECT doc_id, {_SIG} AS s FROM {{prompts}})",
       store=lambda: classify.mapped({k: v[0] for k, v in classify.SIGNIFICANCE.items()}, classify.significance(_P())), embed=lambda: classify.mapped({k: v[1] for k, v in classify.SIGNIFICANCE.items()}, classify.significance(_P())), ttl_days=lambda: F.element_at(F.create_map(*(F.lit(x).cast("double") if i % 2 else F.lit(x) for k, v in classify.SIGNIFICANCE.items() for i, x in enumerate((k, v[2])))), classify.significance(_P())))
_RULE = "CASE " + " ".join(f"WHEN {' OR '.join(f'regexp_matches(prompt, {_re(p)})' for p in ps)} THEN '{k}'" for k, c, ps in classify.RULES) + " END"
_CONF = "CASE kind " + " ".join(f"WHEN '{k}' THEN {c}" for k, c, _ in classify.RULES) + " END"
simple("K12_rule_classification", prompts, "doc_id", f"SELECT doc_id, kind, ({_CONF})::DOUBLE AS confidence FROM (SELECT doc_id, {_RULE} AS kind FROM {{prompts}})", kind=lambda: classify.rule(_P())["type"], confidence=lambda: classify.rule(_P())["confidence"])
_K14 = lambda: tables.pick(["user_message", "session", "decision"], F.col("doc_id"))
simple("K14_classify", prompts, "doc_id", f"""SELECT doc_id, CASE provider WHEN 'rule-based' THEN kind ELSE current END AS kind, CASE provider WHEN 'rule-based' THEN {_CONF} WHEN 'model' THEN NULL ELSE 1.0 END::DOUBLE AS confidence, provider FROM (
  SELECT *, CASE WHEN s IN ('skip', 'low') THEN 'significance-filter' WHEN current = 'session' THEN 'protected-type' WHEN kind IS NOT NULL THEN 'rule-based' ELSE 'model' END AS provider
  FROM (SELECT doc_id, {_SIG} AS s, {_RULE} AS kind, {tables.pick_sql(['user_message', 'session', 'decision'], 'doc_id')} AS current FROM {{prompts}}))""", kind=lambda: classify.classified(_P(), _K14())["type"], confidence=lambda: classify.classified(_P(), _K14())["confidence"], provider=lambda: classify.classified(_P(), _K14())["provider"])
simple("K16_valid_type", memories, "point_id", "SELECT point_id, CASE WHEN (collection = 'code-patterns' AND type IN ('implementation', 'error_pattern', 'refactor', 'file_pattern')) OR (collection = 'conventions' AND type IN ('rule', 'guideline', 'port', 'naming', 'structure')) OR (collection = 'discussions' AND type IN ('decision', 'discussion', 'session', 'blocker', 'preference', 'user_message', 'agent_response')) THEN type ELSE 'other' END AS kind FROM {memories}", kind=lambda: classify.valid_type(F.col("type"), F.col("collection"), F.lit("other")))
_EXT = r"lower(regexp_extract(file_path, '[^/.](\.[^./]+)$', 1))"
simple("K20_language", code, "doc_id", f"SELECT doc_id, {_sql_map(_EXT, classify.LANGUAGES, _re('unknown'))} AS language FROM {{code}}", language=lambda: classify.language(_F()))
simple("K27_sync_language", code, "doc_id", f"SELECT doc_id, CASE WHEN lower(split_part(file_path, '/', -1)) = 'dockerfile' THEN 'dockerfile' ELSE {_sql_map(_EXT, classify.SYNC_LANGUAGES, _re('unknown'))} END AS language FROM {{code}}", language=lambda: classify.language(_F(), sync=True))
_LANG = f"(SELECT *, {_sql_map(_EXT, classify.LANGUAGES, _re('unknown'))} AS language FROM {{code}})"
_FW = "CASE WHEN language = 'python' AND regexp_matches(content, '(?:from\\s+)?fastapi|import.*FastAPI') THEN 'fastapi' WHEN language = 'python' AND regexp_matches(content, '(?:from\\s+)?flask|import.*Flask') THEN 'flask' WHEN language = 'python' AND contains(content, 'from django') THEN 'django' WHEN language = 'python' AND regexp_matches(content, 'import pytest|from pytest') THEN 'pytest' WHEN language IN ('javascript', 'typescript') AND regexp_matches(content, 'from [''\"]react[''\"]|import.*[''\"]react[''\"]') THEN 'react' WHEN language IN ('javascript', 'typescript') AND contains(content, 'express(') THEN 'express' ELSE 'general' END"
simple("K21_framework", code, "doc_id", f"SELECT doc_id, {_FW} AS framework FROM {_LANG}", framework=lambda: classify.framework(_C(), classify.language(_F())))
_IMP = f"CASE WHEN {_sql_any('content', classify.IMPORTANT_MARKS)} OR {_sql_any('lower(file_path)', classify.IMPORTANT_PATHS)} THEN 'high' WHEN length(content) < 50 OR len(string_split(content, chr(10))) < 3 OR {_sql_any('lower(file_path)', classify.UNIMPORTANT_PATHS)} THEN 'low' ELSE 'normal' END"
simple("K22_importance", code, "doc_id", f"SELECT doc_id, {_IMP} AS importance FROM {{code}}", importance=lambda: classify.importance(_C(), _F()))
_TAGS = f"concat_ws(',', language, CASE WHEN fw <> 'general' THEN fw END, CASE WHEN contains(content, 'async') OR contains(content, 'await') THEN 'async' END, CASE WHEN contains(lower(content), 'test') OR contains(content, 'describe(') THEN 'testing' END, CASE WHEN contains(lower(content), 'api') OR contains(lower(content), 'endpoint') THEN 'api' END, CASE WHEN contains(lower(content), 'config') OR contains(lower(content), 'settings') THEN 'config' END, CASE WHEN contains(content, 'try:') OR contains(content, 'catch') OR contains(content, 'except') THEN 'error-handling' END)"
simple("K23_tags", code, "doc_id", f"SELECT doc_id, {_TAGS} AS tags FROM (SELECT *, {_FW} AS fw FROM {_LANG})", tags=lambda: F.array_join(classify.tags(_C(), classify.language(_F()), classify.framework(_C(), classify.language(_F()))), ","))
_lang_c = lambda: classify.language(_F())
_fw_c = lambda: classify.framework(_C(), classify.language(_F()))
simple("K19_pattern_extraction", code, "doc_id", f"SELECT doc_id, CASE WHEN length(content) >= 10 THEN '[' || language || CASE WHEN fw <> 'general' THEN '/' || fw ELSE '' END || '] ' || file_path || chr(10) || chr(10) || content END AS enriched, CASE WHEN length(content) >= 10 THEN {_IMP} END AS importance FROM (SELECT *, {_FW} AS fw FROM {_LANG})",
       enriched=lambda: F.when(F.length(_C()) >= 10, F.concat(F.lit("["), _lang_c(), F.when(_fw_c() != "general", F.concat(F.lit("/"), _fw_c())).otherwise(""), F.lit("] "), _F(), F.lit("\n\n"), _C())), importance=lambda: F.when(F.length(_C()) >= 10, classify.importance(_C(), _F())))
_AG = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(content, '(?i)\\b{a}\\s+agent\\b|Agent:\\s*{a}\\b|@{a}\\b|\\[{a}\\]') THEN '{a}' END" for a in classify.AGENTS) + ")"
_AGENT_TEXT = ["the dev agent ran", "Agent: pm said", "see @tea here", "[architect] note", "nothing", "src/auth/x.py Story 4.2", "Epic 12 on db/ files", "ticket AUTH-77 api/ call", "docker build"]


def _notes(spark, d):
    return _docs(spark, d).select("doc_id", F.concat_ws(" ", tables.pick(_AGENT_TEXT, F.col("doc_id")), F.when(F.col("doc_id") % 2 == 1, F.col("text"))).alias("content"))


_NOTES = f"(SELECT doc_id, {tables.pick_sql(_AGENT_TEXT, 'doc_id')} || CASE WHEN doc_id % 2 = 1 THEN ' ' || text ELSE '' END AS content FROM documents)"
simple("K28_infer_agent", _notes, "doc_id", f"SELECT doc_id, {_AG} AS agent FROM {_NOTES}", agent=lambda: classify.agent(_C()))
simple("K29_infer_component", _notes, "doc_id", "SELECT doc_id, coalesce(" + ", ".join(f"CASE WHEN regexp_matches(content, '(?i){p}') THEN '{c}' END" for c, p in classify.COMPONENTS.items()) + f") AS component FROM {_NOTES}", component=lambda: classify.component(_C()))
simple("K30_infer_story", _notes, "doc_id", rf"SELECT doc_id, coalesce(nullif(regexp_extract(content, '(?i)Story\s+(\d+\.\d+)', 1), ''), nullif(regexp_extract(content, '(?i)Epic\s+(\d+)', 1), ''), nullif(regexp_extract(content, '(?i)\b([A-Z]+-\d+)\b', 1), '')) AS story FROM {_NOTES}", story=lambda: classify.story(_C()))
simple("K31_type_collection", memories, "point_id", "SELECT point_id, CASE WHEN type IN ('guideline', 'rule', 'naming', 'port', 'structure', 'best_practice') THEN 'conventions' WHEN type IN ('decision', 'session', 'blocker', 'preference', 'context', 'session_summary', 'chat_memory', 'agent_decision', 'user_message', 'agent_response') THEN 'discussions' ELSE 'code-patterns' END AS target FROM {memories}", target=lambda: classify.collection_of(F.col("type")))
simple("K33_authority", memories, "point_id", "SELECT point_id, (CASE WHEN source = 'manual' THEN 1.0 WHEN source = 'github' THEN 0.6 ELSE 0.4 END)::DOUBLE AS authority FROM {memories}", authority=lambda: F.when(F.col("source") == "manual", 1.0).when(F.col("source") == "github", 0.6).otherwise(0.4))
simple("K34_agent_budget", memories, "point_id", "SELECT point_id, CASE agent_id WHEN 'a0' THEN 1500 WHEN 'a1' THEN 800 ELSE 1000 END AS budget FROM {memories}", budget=lambda: classify.mapped({"a0": 1500, "a1": 800}, F.col("agent_id"), F.lit(classify.AGENT_BUDGETS_OTHER)))
_JSON = [("", ""), ("Here: ```json\n", "\n``` done"), ("so ", " it is"), ("```", "\n```"), ("no json ", ""), ("", ", ")]
_ANSWER_SQL = "(SELECT doc_id, " + tables.pick_sql([a for a, _ in _JSON], "doc_id") + " || CASE WHEN doc_id % 6 = 4 THEN '' ELSE '{\"type\": \"' || source || '\", \"confidence\": ' || (doc_id % 97) || ', \"reason\": \"' || lang || '\"}' END || " + tables.pick_sql([b for _, b in _JSON], "doc_id") + " AS raw FROM documents)"
_fence = lambda: F.regexp_extract(F.col("raw"), "(?s)```(?:json)?\\s*(\\{.*?\\})\\s*```", 1)
_brace = lambda: F.regexp_extract(F.col("raw"), "(?s)(\\{.*\\})", 1)


def _answers(spark, d):
    """Answers of a model, in all the shapes that they come in."""
    k = F.col("doc_id")
    body = F.when(k % 6 == 4, "").otherwise(F.concat(F.lit('{"type": "'), "source", F.lit('", "confidence": '), (k % 97).cast("string"), F.lit(', "reason": "'), "lang", F.lit('"}')))
    return _docs(spark, d).select(k, F.concat(tables.pick([a for a, _ in _JSON], k), body, tables.pick([b for _, b in _JSON], k)).alias("raw"))


_told = lambda path: F.coalesce(F.get_json_object("raw", path), F.get_json_object(F.nullif(_fence(), F.lit("")), path), F.get_json_object(F.nullif(_brace(), F.lit("")), path))
_TOLD_SQL = "coalesce(CASE WHEN json_valid(raw) THEN raw END, CASE WHEN json_valid(nullif(regexp_extract(raw, '(?s)```(?:json)?\\s*(\\{.*?\\})\\s*```', 1), '')) THEN regexp_extract(raw, '(?s)```(?:json)?\\s*(\\{.*?\\})\\s*```', 1) END, CASE WHEN json_valid(nullif(regexp_extract(raw, '(?s)(\\{.*\\})', 1), '')) THEN regexp_extract(raw, '(?s)(\\{.*\\})', 1) END)"
simple("K17_parse_model_answer", _answers, "doc_id", f"SELECT doc_id, json_extract_string({_TOLD_SQL}, '$.type') AS kind FROM {_ANSWER_SQL}", kind=lambda: _told("$.type"))
simple("K35_parse_judgement", _answers, "doc_id", f"SELECT doc_id, json_extract_string({_TOLD_SQL}, '$.confidence')::DOUBLE AS score FROM {_ANSWER_SQL}", score=lambda: _told("$.confidence").cast("double"))
simple("K18_prompt_build", _docs, "doc_id", "SELECT doc_id, 'Classify into one of: rule, port, decision.' || chr(10) || left(text, 4000) AS prompt FROM documents", prompt=lambda: F.concat(F.lit("Classify into one of: rule, port, decision.\n"), F.substring("text", 1, 4000)))
_first50 = lambda: F.filter(F.transform(F.slice(F.split(_C(), "\n"), 1, 50), text.strip), lambda x: (F.startswith(x, F.lit("import ")) | F.startswith(x, F.lit("from "))) & (F.size(F.split(x, "\\s+")) >= 2))
simple("K26_import_modules", code, "doc_id", r"SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(string_split(content, chr(10))[1:50], lambda x: trim(x)), lambda x: (starts_with(x, 'import ') OR starts_with(x, 'from ')) AND contains(trim(x), ' '))[1:5], lambda x: split_part(trim(trim(split_part(x, ' ', 2), ';'), '''\"'), '.', 1)), ',') AS modules FROM {code}".replace('\\"', '"'),
       modules=lambda: F.array_join(F.transform(F.slice(_first50(), 1, 5), lambda x: F.substring_index(F.regexp_replace(F.regexp_replace(F.split(x, "\\s+")[1], "^;+|;+$", ""), "^['\"]+|['\"]+$", ""), ".", 1)), ","))

_SIGCODE = r"regexp_matches(content, '\bdef\s+\w+\s*\(|\bfunction\s+\w+\s*\(|\bfunc\s+\w+\s*\(|\bfn\s+\w+\s*\(') OR regexp_matches(content, '(?m)^\s*\w+\s*:\s*function\s*\(') OR regexp_matches(content, '\b(?:class|interface|struct|trait|enum)\s+\w+') OR regexp_matches(content, '(?m)^\s*@\w+') OR regexp_matches(content, '(?m)(?:^\s*(?:import|from) [^\n]*\n){2}^\s*(?:import|from) ')"
simple("F17_significant_code", code, "doc_id", f"SELECT doc_id, {_SIGCODE} AS significant FROM {{code}}", significant=lambda: classify.is_significant_code(_C()))
simple("F16_should_store", code, "doc_id", f"SELECT doc_id, {_EXT} NOT IN ({', '.join(map(_re, classify.SKIPPED_EXTENSIONS))}) AND NOT {_sql_any('file_path', classify.SKIPPED_PATHS)} AND ({_SIGCODE}) AS store FROM {{code}}", store=lambda: classify.should_store(_F(), _C()))
simple("W3_import_run", code, "doc_id", r"SELECT doc_id, coalesce(max(n), 0)::INT AS run FROM (SELECT doc_id, count(*) FILTER (WHERE m) AS n FROM (SELECT doc_id, i, m, i - sum(m::INT) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM (SELECT doc_id, i, regexp_matches(l[i], '^\s*(import|from) ') AS m FROM (SELECT doc_id, string_split(content, chr(10)) AS l, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM {code}))) GROUP BY doc_id, island) GROUP BY 1", run=lambda: classify.import_run(_C()))
simple("F18_sync_eligibility", code, "doc_id", f"SELECT doc_id, {_EXT} NOT IN ({', '.join(map(_re, classify.BINARY_EXTENSIONS))}) AND size <= 4000 AND (lower(split_part(file_path, '/', -1)) = 'dockerfile' OR {_EXT} IN ({', '.join(map(_re, classify.SYNC_LANGUAGES))})) AND NOT ends_with(file_path, '3.js') AND NOT list_contains(string_split(file_path, '/'), 'node_modules') AS eligible FROM {{code}}", eligible=lambda: classify.should_sync(_F(), F.col("size"), 4000, ["*3.js", "node_modules"]))
_MENU = ["──── menu", "[MH] main", "plain line", "│ box ...", "text [CR] tag", "ends ..."]


def _menus(spark, d):
    k = F.col("doc_id")
    return _docs(spark, d).select(k, F.concat_ws("\n", tables.pick(_MENU, k), tables.pick(_MENU, F.floor(k / 2)), tables.pick(_MENU, F.floor(k / 5))).alias("content"))


simple("F19_low_value_lines", _menus, "doc_id", f"SELECT doc_id, array_to_string(list_filter([{tables.pick_sql(_MENU, 'doc_id')}, {tables.pick_sql(_MENU, 'doc_id // 2')}, {tables.pick_sql(_MENU, 'doc_id // 5')}], lambda x: x IN ('plain line', 'ends ...')), chr(10)) AS kept FROM documents", kept=lambda: classify.without_low_value_lines(_C()))
_SUMMARY = ["Tools Used: None\nFiles Modified (0)\nUser Interactions: 0 prompts\nKey Activities:\n  ", "Tools Used: None\nFiles Modified (0)\nUser Interactions: 0 prompts\nKey Activities: x", "Tools Used: None\nFiles Modified (0)\nUser Interactions: 0 prompts", "Tools Used: Bash\nFiles Modified (2)\nUser Interactions: 0 prompts\nKey Activities:"]
_summaries = lambda: F.concat(F.col("text"), F.lit("\n"), tables.pick(_SUMMARY, F.col("doc_id")), F.when(F.col("doc_id") % 11 == 0, F.col("text")).otherwise(""))
_SUM_SQL = f"text || chr(10) || {tables.pick_sql(_SUMMARY, 'doc_id')} || CASE WHEN doc_id % 11 = 0 THEN text ELSE '' END"
simple("F20_empty_sessions", _docs, "doc_id", f"SELECT doc_id, contains(c, 'Tools Used: None') AND contains(c, 'Files Modified (0)') AND contains(c, 'User Interactions: 0 prompts') AND contains(c, 'Key Activities:') AND regexp_full_match(string_split(c, 'Key Activities:')[-1], '\\s*') AS empty FROM (SELECT doc_id, {_SUM_SQL} AS c FROM documents)", empty=lambda: validation.is_empty_session(_summaries()))
simple("F21_false_errors", prompts, "doc_id", r"SELECT doc_id, regexp_matches(prompt, '(?i)error|failed') AND NOT regexp_matches(prompt, '\w+Error:|Traceback') AS false_positive FROM {prompts}", false_positive=lambda: F.rlike(_P(), F.lit("(?i)error|failed")) & ~F.rlike(_P(), F.lit("\\w+Error:|Traceback")))

_count = lambda kind: F.size(F.filter(scan.findings(_C()), lambda x: x["kind"] == kind))
_hits = lambda kind: "len(regexp_extract_all(content, {}))".format(_re(next(p for k, p, _, _ in scan.PERSONAL if k == kind)))
_SECRET = "regexp_matches(content, {})".format(_re("|".join(p for _, p, _, _ in scan.SECRETS)))
simple("X1_regex_scan", exposed, "doc_id", f"SELECT doc_id, {_hits('pii_email')}::INT AS emails, {_hits('pii_ssn')}::INT AS ssns, {_hits('pii_internal_url')}::INT AS urls FROM {{exposed}}", emails=lambda: _count("pii_email"), ssns=lambda: _count("pii_ssn"), urls=lambda: _count("pii_internal_url"))
simple("X1_numbers_and_handles", exposed, "doc_id", None, phones=lambda: _count("pii_phone"), ips=lambda: _count("pii_ip"), cards=lambda: _count("pii_cc"), handles=lambda: _count("pii_handle"))
simple("X3_secret_scan", exposed, "doc_id", f"SELECT doc_id, {_SECRET} AS secret FROM {{exposed}}", secret=lambda: scan.has_secret(_C()))
_card = lambda: F.concat(F.lit("4111-"), F.lpad((F.col("doc_id") * 7919 % 100_000_000).cast("string"), 8, "0"), F.lit(" "), F.lpad((F.col("doc_id") % 10_000).cast("string"), 4, "0"))
_digits = "list_reverse(string_split('4111' || lpad((doc_id * 7919 % 100000000)::VARCHAR, 8, '0') || lpad((doc_id % 10000)::VARCHAR, 4, '0'), ''))"
simple("X4_luhn", _docs, "doc_id", f"SELECT doc_id, list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN d[i]::INT WHEN d[i]::INT > 4 THEN d[i]::INT * 2 - 9 ELSE d[i]::INT * 2 END)) % 10 = 0 AS ok FROM (SELECT doc_id, {_digits} AS d FROM documents)", ok=lambda: scan.is_luhn(_card()))
query("X5_entropy_places")(lambda spark, d: exposed(spark, d).select("doc_id", F.explode(scan.entropy_findings(F.concat_ws(" ", _C(), F.when(F.col("doc_id") % 4 == 1, F.base64(F.unhex(F.sha2(F.col("doc_id").cast("string"), 256))))))).alias("f")).select("doc_id", "f.start", "f.end", "f.text"))
simple("X9_strict_scan", exposed, "doc_id", None, action=lambda: scan.scanned(F.concat_ws(" ", _C(), F.when(F.col("doc_id") % 4 == 1, F.base64(F.unhex(F.sha2(F.col("doc_id").cast("string"), 256))))), F.when(F.col("source_type") == "jira", "off").when(F.col("doc_id") % 2 == 1, "strict").otherwise("relaxed"), strict=True)["action"])
simple("X5_entropy", _docs, "doc_id", "SELECT doc_id, round(coalesce(-sum(n / t * log2(n / t)), 0), 6) AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS t FROM (SELECT doc_id, c, count(*)::DOUBLE AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents) GROUP BY ALL)) GROUP BY 1", entropy=lambda: F.round(scan.entropy(_T()), 6))
_PERSON = r"\b(?:Mr|Mrs|Ms|Dr)\. ((?:[A-Z][a-z]+)(?: [A-Z][a-z]+)?)"


def name_tagger(segments: list[str]) -> list[list[tuple[int, int]]]:
    """A stand-in for a model of names: what follows a title."""
    return [[m.span(1) for m in re.finditer(_PERSON, s)] for s in segments]


def _named(spark, d):
    who = tables.pick(["Dr. Ada Byron called", "no one here", "ask Mr. Smith and Mrs. Jane Roe"], F.col("doc_id"))
    return _docs(spark, d).select("doc_id", F.concat_ws(" ", "text", who).alias("content"))


simple("X6_person_entities", _named, "doc_id", f"SELECT doc_id, array_to_string(regexp_extract_all(text || ' ' || {tables.pick_sql(['Dr. Ada Byron called', 'no one here', 'ask Mr. Smith and Mrs. Jane Roe'], 'doc_id')}, {_re(_PERSON)}, 1), ',') AS names FROM documents",
       names=lambda: F.array_join(chunking.column(lambda t: [f[3] for f in scan.persons(t, name_tagger)], "array<string>", _C()), ","))
simple("X8_masked", exposed, "doc_id", None, masked=lambda: scan.masked(_C()))
_mode = lambda: F.when(F.col("source_type") == "jira", "off").otherwise("relaxed")
simple("X9_scan_by_mode", exposed, "doc_id", None, action=lambda: scan.scanned(_C(), _mode())["action"], cleaned=lambda: scan.scanned(_C(), _mode())["content"])
query("X10_batch_scan")(
    lambda spark, d: exposed(spark, d).select("source_type", scan.scanned(_C(), F.lit("relaxed"))["action"].alias("r")).groupBy("source_type").agg(F.count_if(F.col("r") == "blocked").alias("blocked"), F.count_if(F.col("r") == "masked").alias("masked"), F.count(F.lit(1)).alias("n")))
simple("X11_log_mask", memories, "point_id", "SELECT point_id, CASE WHEN length(content) > 10 THEN left(content, 4) || '...' || right(content, 4) ELSE '<redacted>' END AS logged FROM {memories}", logged=lambda: scan.for_log(_C()))
