"""Queries of similarity search, fusion and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import vector
from tessera.operators import index, late, search
from tessera.plans import tables
from tessera.plans.registry import query
from tessera.plans.tables import NOW, memories, queries_table, sessions, table



def _now():
    """NOW"""
    return F.timestamp_seconds(F.lit(1709251200))


_SIM = "list_cosine_similarity(m.embedding::DOUBLE[], q.query::DOUBLE[])"
_HALF = "CASE type WHEN 'github_pr' THEN 30 WHEN 'jira_issue' THEN 30 WHEN 'guideline' THEN 60 WHEN 'rule' THEN 60 ELSE CASE collection WHEN 'code-patterns' THEN 14 WHEN 'discussions' THEN 21 WHEN 'conventions' THEN 60 WHEN 'jira-data' THEN 30 WHEN 'github' THEN 14 ELSE 21 END END"
_AGE = f"greatest((epoch_us(TIMESTAMP '{NOW}') - epoch_us(stored_at)) / 86400e6, 0)"
_TIME = f"CASE WHEN access_count >= 3 THEN 1.0 ELSE pow(0.5, {_AGE} / ({_HALF})) END"


def _ranked(inner: str, score: str, k: int, columns: str = "query_id, point_id", by: str = "query_id") -> str:
    return f"SELECT {columns}, round({score}, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {score} DESC, point_id) AS rank FROM ({inner})) WHERE rank <= {k}"


def _out(df, *columns):
    return df.select("query_id", "point_id", *columns, F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_PAIRS = "SELECT query_id, m.*, {sim} AS similarity FROM {memories} m, {queries} q".replace("{sim}", _SIM)


@query("V1_dense_search", _ranked(f"SELECT * FROM ({_PAIRS}) WHERE similarity >= 0 AND collection = 'code-patterns' AND coalesce(freshness_status <> 'expired', true)", "similarity", 5))
def dense(spark, d):
    return _out(search.dense(memories(spark, d), queries_table(spark, d), 5, search.Filters(collection="code-patterns")))


@query("V1_indexed_search")
def indexed(spark, d):
    """The same search through an index of all memories; it may miss hits, so it is compared by recall."""
    m = memories(spark, d).select("point_id", "embedding")
    cells = index.fit(m)
    return _out(index.search(index.indexed(m, cells), queries_table(spark, d), cells, 10))


@query("V2_decay_search", _ranked(f"SELECT *, 0.7 * similarity + 0.3 * ({_TIME}) AS final FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, point_id) AS pre FROM ({_PAIRS}) WHERE similarity >= 0) WHERE pre <= 50", "final", 10))
def decay(spark, d):
    return _out(search.decayed(memories(spark, d), queries_table(spark, d), _now(), 10))


@query("V3_decay_score", f"SELECT point_id, round(pow(0.5, {_AGE} / 21), 9) AS decay FROM {{memories}}")
def decay_score(spark, d):
    return memories(spark, d).select("point_id", F.round(vector.temporal(vector.age_days(F.col("stored_at"), _now()), F.lit(21.0)), 9).alias("decay"))


@query("V4_half_life", f"SELECT point_id, ({_HALF})::DOUBLE AS half_life FROM {{memories}}")
def half_life(spark, d):
    return memories(spark, d).select("point_id", vector.half_life(F.col("type"), F.col("collection")).alias("half_life"))


def _asked(spark, d):
    """Query texts: the content of every hundredth row."""
    return memories(spark, d).filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("content").alias("text"), F.col("embedding").alias("query"))


_ASKED = "SELECT vec_id AS query_id, content AS text FROM {memories} WHERE vec_id % 100 = 0"
_BM25 = f"""
WITH docs AS (SELECT point_id, term, count(*) AS tf FROM (SELECT point_id, unnest(list_filter(regexp_split_to_array(lower(content), '\\W+'), lambda x: x <> '')) AS term FROM {{memories}}) GROUP BY ALL),
sizes AS (SELECT point_id, sum(tf) AS dl FROM docs GROUP BY 1), whole AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM sizes), df AS (SELECT term, count(*) AS df FROM docs GROUP BY 1),
asked AS (SELECT DISTINCT query_id, unnest(regexp_split_to_array(lower(text), '\\W+')) AS term FROM ({_ASKED}))
SELECT query_id, point_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
FROM docs JOIN asked USING (term) JOIN df USING (term) JOIN sizes USING (point_id), whole GROUP BY ALL"""


@query("V7_bm25", f"SELECT query_id, point_id, round(score, 6) AS score FROM ({_BM25})")
def bm25(spark, d):
    return search.bm25(memories(spark, d), _asked(spark, d)).select("query_id", "point_id", F.round("score", 6).alias("score"))


_LEG = "SELECT query_id, point_id, row_number() OVER (PARTITION BY query_id ORDER BY round({s}, 9) DESC, point_id) AS rank FROM ({t})"
_DENSE = f"SELECT query_id, point_id, {_SIM} AS similarity FROM {{memories}} m, {{queries}} q"
_RRF = f"SELECT query_id, point_id, sum(1.0 / (60 + rank)) AS fused FROM (SELECT * FROM ({_LEG.format(s='similarity', t=_DENSE)}) WHERE rank <= 50 UNION ALL SELECT * FROM ({_LEG.format(s='score', t=_BM25)}) WHERE rank <= 50) GROUP BY ALL".replace("{{", "{").replace("}}", "}")


def _legs(spark, d):
    m, q = memories(spark, d), _asked(spark, d)
    first = search.nearest(m, q.select("query_id", "query"), 50, digits=9)
    return first, search.lexical(m, q.select("query_id", "text"), 50, 9)


@query("V5_hybrid_prefetch", f"SELECT 'dense' AS leg, * FROM ({_LEG.format(s='similarity', t=_DENSE)}) WHERE rank <= 50 UNION ALL SELECT 'sparse', * FROM ({_LEG.format(s='score', t=_BM25)}) WHERE rank <= 50")
def prefetch(spark, d):
    a, b = _legs(spark, d)
    pick = lambda x, leg: x.select(F.lit(leg).alias("leg"), "query_id", "point_id", F.col("rank").cast("long").alias("rank"))
    return pick(a, "dense").unionByName(pick(b, "sparse"))


@query("V6_rrf_fusion", f"SELECT query_id, point_id, round(fused, 9) AS score FROM ({_RRF})")
def fusion(spark, d):
    return search.rrf(*_legs(spark, d)).select("query_id", "point_id", F.round("score", 9).alias("score"))


@query("V8_max_sim", """WITH t AS (SELECT conv AS id, list(v ORDER BY vec_id) AS m FROM (SELECT vec_id, vec_id // 4 AS conv, embedding::DOUBLE[] AS v FROM embeddings) GROUP BY conv),
p AS (SELECT q.id AS query_id, d.id AS doc_id, q.m AS a, d.m AS b FROM t q, t d WHERE q.id % 100 = 0)
SELECT query_id, doc_id, round(list_sum(list_transform(a, lambda x: list_max(list_transform(b, lambda y: list_dot_product(x, y))))), 6) AS score FROM p""")
def max_sim(spark, d):
    t = table(spark, d, "embeddings").groupBy(F.floor(F.col("vec_id") / 4).alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]).alias("vectors"))
    return late.all_sums(t, t.filter("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id"), 6)


@query("V9_rescaled", f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 9) DESC, point_id) AS rank FROM ({_RRF})), k AS (SELECT *, min(round(fused, 9)) OVER (PARTITION BY query_id) AS lo, max(round(fused, 9)) OVER (PARTITION BY query_id) AS hi FROM t WHERE rank <= 20)
SELECT query_id, point_id, round(CASE WHEN hi = lo THEN 0.75 ELSE 0.5 + 0.45 * (round(fused, 9) - lo) / (hi - lo) END, 5) AS score FROM k""")
def rescaled(spark, d):
    found = search.rrf(*_legs(spark, d)).withColumn("score", F.round("score", 9))
    return search.rescaled(search.top(found, 20)).select("query_id", "point_id", F.round("score", 5).alias("score"))


@query("V10_attribution", f"SELECT query_id, point_id, '[' || collection || ':' || type || '] (' || floor(round(similarity, 9) * 100)::INT || '%)' AS attribution FROM ({_PAIRS}) WHERE similarity >= 0.3")
def attribution(spark, d):
    return search.scored(memories(spark, d), queries_table(spark, d), 0.3).select("query_id", "point_id", vector.attribution(F.col("collection"), F.col("type"), F.round("similarity", 9)).alias("attribution"))


@query("V11_dual_search", " UNION ALL ".join([
    _ranked(f"SELECT *, 'code' AS leg FROM ({_PAIRS}) WHERE collection = 'code-patterns' AND group_id = 'g1' AND similarity >= -1 AND coalesce(freshness_status <> 'expired', true)", "similarity", 3, "leg, query_id, point_id"),
    _ranked(f"SELECT *, 'shared' AS leg FROM ({_PAIRS}) WHERE collection = 'conventions' AND similarity >= -1", "similarity", 3, "leg, query_id, point_id")]))
def dual(spark, d):
    m, q = memories(spark, d), queries_table(spark, d)
    legs = [("code", search.Filters("code-patterns", "g1")), ("shared", search.Filters("conventions"))]
    a, b = (_out(search.dense(m, q, 3, f, -1.0).withColumn("leg", F.lit(n)), "leg") for n, f in legs)
    return a.unionByName(b)


_PRIMARY = f"SELECT query_id, point_id, similarity, 0 AS leg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, point_id) AS r FROM ({_PAIRS}) WHERE collection = 'discussions' AND type = 'decision' AND group_id = 'g2' AND similarity >= 0.1) WHERE r <= 5"
_SECOND = f"SELECT query_id, point_id, similarity, 1 AS leg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, point_id) AS r FROM ({_PAIRS}) WHERE collection = 'conventions' AND group_id = 'g2' AND similarity >= 0.1) WHERE r <= 5"


@query("V12_cascading_search", _ranked(f"""WITH p AS ({_PRIMARY}), s AS ({_SECOND}), strong AS (SELECT query_id FROM p GROUP BY 1 HAVING count(*) >= 3 AND max(similarity) >= 0.5)
SELECT * FROM p UNION ALL SELECT * FROM s WHERE query_id NOT IN (SELECT query_id FROM strong)""", "similarity", 5))
def cascade(spark, d):
    m, q = memories(spark, d), queries_table(spark, d)
    first = search.dense(m, q, 5, search.Filters("discussions", "g2", ("decision",)), 0.1)
    return _out(search.cascade(first, search.dense(m, q, 5, search.Filters("conventions", "g2"), 0.1)))


@query("V13_shared_best_practices", _ranked(f"SELECT * FROM ({_PAIRS}) WHERE collection = 'conventions' AND similarity >= 0", "similarity", 3))
def shared(spark, d):
    return _out(search.dense(memories(spark, d), queries_table(spark, d), 3, search.Filters("conventions")))


@query("V14_intent_routed_search", _ranked(f"SELECT * FROM ({_PAIRS}) WHERE similarity >= 0 AND collection = ['code-patterns', 'conventions', 'discussions'][((query_id // 100) % 3 + 1)::INT] AND (collection <> 'code-patterns' OR coalesce(freshness_status <> 'expired', true))", "similarity", 5))
def routed(spark, d):
    m, q = memories(spark, d), queries_table(spark, d).withColumn("target", tables.pick(["code-patterns", "conventions", "discussions"], F.floor(F.col("query_id") / 100)))
    legs = [search.dense(m, q.filter(F.col("target") == c).drop("target"), 5, search.Filters(c)) for c in ("code-patterns", "conventions", "discussions")]
    return _out(legs[0].unionByName(legs[1]).unionByName(legs[2]))


@query("V19_confidence", f"SELECT query_id, round(0.7 * avg(similarity) + 0.3 * least(count(*) / 3.0, 1), 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, point_id) AS r FROM ({_PAIRS}) WHERE similarity >= 0) WHERE r <= 5 GROUP BY 1")
def confidence(spark, d):
    return search.confidence(search.dense(memories(spark, d), queries_table(spark, d), 5)).select("query_id", F.round("confidence", 6).alias("confidence"))


@query("V20_access_increment", f"""WITH hit AS (SELECT point_id, count(DISTINCT query_id) AS n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, point_id) AS r FROM ({_PAIRS}) WHERE similarity >= 0) WHERE r <= 10 GROUP BY 1)
SELECT point_id, access_count + coalesce(n, 0) AS access_count, access_count < 3 AND access_count + coalesce(n, 0) >= 3 AS newly_protected FROM {{memories}} LEFT JOIN hit USING (point_id)""")
def access(spark, d):
    m = memories(spark, d)
    hit = search.dense(m, queries_table(spark, d), 10).groupBy("point_id").agg(F.countDistinct("query_id").alias("n"))
    after = F.col("access_count") + F.coalesce("n", F.lit(0))
    return m.select("point_id", "access_count").join(hit, "point_id", "left").select("point_id", after.alias("access_count"), ((F.col("access_count") < 3) & (after >= 3)).alias("newly_protected"))


@query("V21_topic_drift", """SELECT session_id, point_id, round(CASE WHEN b IS NULL THEN 0.5 ELSE least(greatest(1 - list_cosine_similarity(embedding::DOUBLE[], b::DOUBLE[]), 0), 1) END, 6) AS drift
FROM (SELECT *, lag(embedding) OVER (PARTITION BY session_id ORDER BY vec_id) AS b FROM {memories})""")
def drift(spark, d):
    return search.drift(memories(spark, d), "session_id", "vec_id").select("session_id", "point_id", F.round("drift", 6).alias("drift"))


@query("V22_embedding_model", "SELECT point_id, CASE WHEN collection = 'code-patterns' OR type IN ('github_code_blob', 'implementation') THEN 'code' ELSE 'prose' END AS model FROM {memories}")
def model(spark, d):
    code = (F.col("collection") == "code-patterns") | F.col("type").isin("github_code_blob", "implementation")
    return memories(spark, d).select("point_id", F.when(code, "code").otherwise("prose").alias("model"))


_GOLDEN = f"SELECT query_id, coalesce(max((file_path IN ('src/m' || (query_id % 11) || '.py', 'src/m3.md', 'src/m5.go'))::INT), 0) AS hit FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, point_id) AS r FROM ({_PAIRS})) WHERE r <= 5 GROUP BY 1"


@query("V25_recall_at_5", f"SELECT query_id, hit AS recalled FROM ({_GOLDEN})")
def recall(spark, d):
    found = search.dense(memories(spark, d), queries_table(spark, d), 5, threshold=None)
    expected = F.array(F.concat(F.lit("src/m"), (F.col("query_id") % 11).cast("string"), F.lit(".py")), F.lit("src/m3.md"), F.lit("src/m5.go"))
    return found.groupBy("query_id").agg(F.collect_set("file_path").alias("files")).select("query_id", F.arrays_overlap("files", expected).cast("int").alias("recalled"))


@query("V26_quality_metrics", f"WITH g AS ({_GOLDEN}) SELECT count(*) AS queries, sum(hit)::BIGINT AS recalled, min(hit) AS min_recall, count(*) FILTER (WHERE hit < b) AS regressions FROM (SELECT *, CASE WHEN query_id % 200 = 0 THEN 1 ELSE 0 END AS b FROM g)")
def quality(spark, d):
    base = F.when(F.col("query_id") % 200 == 0, 1).otherwise(0)
    return recall(spark, d).agg(F.count(F.lit(1)).alias("queries"), F.sum("recalled").alias("recalled"), F.min("recalled").alias("min_recall"), F.count_if(F.col("recalled") < base).alias("regressions"))


@query("J9_activity_since", "SELECT conv_id, count(*) AS n FROM {sessions} WHERE ts > (SELECT max(ts) - INTERVAL 1 DAY FROM {sessions} WHERE role = 'assistant') GROUP BY 1")
def since(spark, d):
    s = sessions(spark, d)
    last = s.filter("role = 'assistant'").agg(F.max("ts").alias("last"))
    return s.join(F.broadcast(last)).filter(F.col("ts") > F.col("last") - F.expr("INTERVAL 1 DAY")).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
