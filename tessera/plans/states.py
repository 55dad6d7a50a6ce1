"""Queries of keyed state, versions of code chunks, and embeddings that are filled in."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import chunking
from tessera.operators import backfill, blobs, providers
from tessera.plans import tables
from tessera.plans.registry import query
from tessera.plans.stateful import _drained, _stream
from tessera.plans.tables import memories, table
from tessera.sources.shared import cut
from tessera.streaming import keyed

_DAY_MS = 86_400_000


# Keyed state
@query("T2_forgetful_edits", f"""WITH e AS (SELECT user_id::VARCHAR AS session_id, event_type AS file_path, (epoch_us(ts) // 1000) AS "at" FROM events), g AS (SELECT *, ("at" - lag("at") OVER (PARTITION BY session_id ORDER BY "at") > {_DAY_MS})::INT AS fresh FROM e),
l AS (SELECT *, sum(coalesce(fresh, 0)) OVER (PARTITION BY session_id ORDER BY "at" RANGE UNBOUNDED PRECEDING) AS life FROM g) SELECT session_id, file_path, min("at")::BIGINT AS "at" FROM l GROUP BY session_id, life, file_path""")
def forgetful_edits(spark, d):
    """First edits of files in sessions that are forgotten after a day of silence."""
    e = _stream(spark, d, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("file_path"), F.col("ts").cast("timestamp").alias("event_time"))
    with keyed.state_store(spark):
        return _drained(keyed.first_edits(e), "forgetful-edits")


@query("T1_keyed_state", f"""WITH e AS (SELECT user_id::VARCHAR AS session_id, (epoch_us(ts) // 1000) AS "at", event_id, event_type, event_type || (event_id % 3) AS point_id, [value, 10.0::DOUBLE] AS q FROM events),
g AS (SELECT *, coalesce(("at" - lag("at") OVER w > {_DAY_MS})::INT, 0) AS fresh, (event_type = 'error')::INT AS cut FROM e WINDOW w AS (PARTITION BY session_id ORDER BY "at", event_id)),
l AS (SELECT *, sum(fresh) OVER w AS life, sum(cut) OVER w AS part FROM g WINDOW w AS (PARTITION BY session_id ORDER BY "at", event_id ROWS UNBOUNDED PRECEDING)),
n AS (SELECT session_id, max(life) AS life FROM l GROUP BY 1), c AS (SELECT l.* FROM l JOIN n USING (session_id, life)), p AS (SELECT session_id, max(part) AS part FROM c GROUP BY 1),
i AS (SELECT session_id, part, count(DISTINCT point_id) AS n FROM c WHERE event_type NOT IN ('error', 'view') GROUP BY 1, 2),
q AS (SELECT session_id, list(q ORDER BY "at", event_id) AS qs FROM c WHERE event_type = 'view' GROUP BY 1)
SELECT p.session_id, coalesce((SELECT n FROM i WHERE i.session_id = p.session_id AND i.part = p.part), 0)::INT AS injected, coalesce((SELECT sum(n) * 10 FROM i WHERE i.session_id = p.session_id), 0)::BIGINT AS tokens, coalesce(len(qs), 0)::INT AS turns,
 (SELECT count(*) FROM c WHERE c.session_id = p.session_id AND event_type = 'error')::INT AS compactions, round(CASE WHEN coalesce(len(qs), 0) < 2 THEN 0.5 ELSE least(greatest(1 - list_cosine_similarity(qs[-1], qs[-2]), 0), 1) END, 6) AS drift FROM p LEFT JOIN q USING (session_id)""")
def keyed_state(spark, d):
    """What each session holds in the end: errors are compactions, views are questions, all else is given to it."""
    t = F.col("event_type")
    e = _stream(spark, d, "events").select(
        F.col("user_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp").alias("event_time"), F.col("event_id").alias("order"), F.when(t == "error", "compact").when(t == "view", "query").otherwise("inject").alias("kind"),
        F.concat(t, (F.col("event_id") % 3).cast("string")).alias("point_id"), F.lit(10).cast("long").alias("tokens"), F.array("value", F.lit(10.0)).alias("query"),
    )
    with keyed.state_store(spark):
        out = _drained(keyed.sessions(e), "keyed-sessions", "update")
    # later batches have the later state of a session
    return out.groupBy("session_id").agg(F.max_by(F.struct("injected", "tokens", "turns", "compactions", "drift"), F.coalesce(F.col("batch"), F.lit(0))).alias("s")).select("session_id", "s.injected", "s.tokens", "s.turns", "s.compactions", F.round("s.drift", 6).alias("drift"))


# Versions of code chunks
def _tree(spark, d, cycle: int):
    """Files of a cycle: some are new in the second one, some have changed, some are gone."""
    k = F.col("doc_id")
    body = F.col("text") if cycle == 1 else F.when(k % 3 == 0, F.concat(F.lit("changed\n"), "text")).otherwise(F.col("text"))
    rows = table(spark, d, "documents").filter(k % 5 != 0 if cycle == 1 else k % 7 != 0)
    return rows.select(F.concat(F.lit("src/f"), k.cast("string"), F.lit(".py")).alias("file_path"), F.md5(F.encode(body, "UTF-8")).alias("blob_hash"), body.alias("content"))


@query("G7_chunk_versions", """WITH a AS (SELECT doc_id, 'src/f' || doc_id || '.py' AS file_path, text AS c FROM documents WHERE doc_id % 5 <> 0), b AS (SELECT doc_id, 'src/f' || doc_id || '.py' AS file_path, CASE WHEN doc_id % 3 = 0 THEN 'changed' || chr(10) || text ELSE text END AS c FROM documents WHERE doc_id % 7 <> 0),
v AS (SELECT a.file_path, a.c, 1 AS version, b.c IS NOT NULL AND b.c = a.c AS is_current, CASE WHEN b.c = a.c THEN 200 ELSE 100 END AS synced_at FROM a LEFT JOIN b USING (file_path) UNION ALL SELECT b.file_path, b.c, CASE WHEN a.c IS NULL THEN 1 ELSE 2 END, true, 200 FROM b LEFT JOIN a USING (file_path) WHERE a.c IS NULL OR a.c <> b.c)
SELECT file_path, md5(c) AS blob_hash, version::INT AS version, (i - 1)::INT AS chunk_index, n::INT AS total_chunks, l[i] AS content, is_current, synced_at::BIGINT AS synced_at FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM (SELECT *, string_split(c, chr(10)) AS l, len(string_split(c, chr(10))) AS n FROM v))""")
def chunk_versions(spark, d):
    """The store after two cycles; a chunk is a line."""
    none, lines = spark.createDataFrame([], blobs.STATE), F.split("content", "\n")
    at = lambda n: F.lit(n).cast("long")
    first = cut(blobs.merged(none, _tree(spark, d, 1), lines, at(100)), "code-chunks")
    return blobs.merged(first, _tree(spark, d, 2), lines, at(200))


@query("G7_sync_summary", """WITH a AS (SELECT doc_id, text AS c FROM documents WHERE doc_id % 5 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'changed' || chr(10) || text ELSE text END AS c FROM documents WHERE doc_id % 7 <> 0)
SELECT CASE WHEN a.c IS NULL THEN 'insert' WHEN b.c IS NULL THEN 'close' WHEN a.c = b.c THEN 'touch' ELSE 'supersede' END AS action, count(*) AS files FROM a FULL JOIN b USING (doc_id) GROUP BY 1""")
def sync_summary(spark, d):
    state = blobs.merged(spark.createDataFrame([], blobs.STATE), _tree(spark, d, 1), F.array("content"), F.lit(100).cast("long"))
    return blobs.summary(state, _tree(spark, d, 2))


# Embeddings
def _client():
    """An embedding service that needs no network: the shares of four characters, at unit length."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [float(t.count(c)) for c in "eatn"]
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / n for x in v])
        return out

    return embed


def _embed(rows):
    return providers.embedded(rows, _client)


_COUNTED = "[length(c) - length(replace(c, 'e', '')), length(c) - length(replace(c, 'a', '')), length(c) - length(replace(c, 't', '')), length(c) - length(replace(c, 'n', ''))]"
_UNIT = "array_to_string(list_transform(v, lambda x: printf('%.6f', x / CASE WHEN n = 0 THEN 1 ELSE n END)), ',')"


def _shown(embedding):
    return F.array_join(F.transform(embedding, lambda x: F.format_string("%.6f", x)), ",")


@query("B1_embedded_backfill", f"SELECT point_id, CASE WHEN vec_id % 6 = 0 AND trim(c) <> '' THEN 'complete' WHEN vec_id % 6 = 0 THEN 'pending' ELSE 'stored' END AS embedding_status, CASE WHEN vec_id % 6 = 0 AND trim(c) <> '' THEN {_UNIT} END AS embedding FROM (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (SELECT point_id, vec_id, c, {_COUNTED}::DOUBLE[] AS v FROM (SELECT point_id, vec_id, CASE WHEN vec_id % 30 = 0 THEN ' ' ELSE content END AS c FROM {{memories}})))")
def embedded_backfill(spark, d):
    """Pending memories get their vectors; those without content stay pending."""
    v = F.col("vec_id")
    m = memories(spark, d).select("point_id", F.when(v % 30 == 0, " ").otherwise(F.col("content")).alias("content"), F.lit(None).cast("array<double>").alias("embedding"), F.when(v % 6 == 0, "pending").otherwise("stored").alias("embedding_status"))
    return backfill.embed_pending(m, _embed).select("point_id", "embedding_status", _shown(F.col("embedding")).alias("embedding"))


@query("V24_embedded_pieces", f"SELECT doc_id, i, {_UNIT} AS embedding FROM (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (SELECT doc_id, i, {_COUNTED}::DOUBLE[] AS v FROM (SELECT doc_id, i, substr(text, i * 500 + 1, 500) AS c FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 499) // 500)) AS i FROM documents))))")
def embedded_pieces(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    return backfill.embed_by_offset(rows, _embed, 500, "doc_id").filter("embedding IS NOT NULL").select("doc_id", "i", _shown(F.col("embedding")).alias("embedding"))


@query("C16_exact_tokens")
def exact_tokens(spark, d):
    """Tokens of whole texts by a tokenizer's file."""
    return table(spark, d, "documents").select("doc_id", chunking.exact_tokens(F.col("text"), tables.tokenizer_file()).alias("tokens"))
