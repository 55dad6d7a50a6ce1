"""Queries of near duplicates by signatures, quantized vectors, late interaction, impact indexes, and search by the best means."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import dedup, hybrid, index, inverted, late, quantize, search, similar
from tessera.plans.registry import query
from tessera.plans.search import _BM25, _DENSE, _LEG, _SIM, _TIME, _asked, _now, _ranked
from tessera.plans.services import _incoming, _stored
from tessera.plans.tables import memories, queries_table, table
from tessera.sources.shared import shared_dir

_M = "{memories}"


# Near duplicates
@query("J11_hyperplane_duplicates")
def hyperplane_duplicates(spark, d):
    """As J11_vector_near_duplicates, by signatures; it may miss pairs, so it is compared by recall."""
    return similar.near(_incoming(spark, d), _stored(spark, d), ["group_id"], 0.85).select("point_id", F.round("similarity", 6).alias("similarity"))


_UNIQUE = "'u' || (vec_id % 331)"


@query("D4_duplicate_report", f"""WITH m AS (SELECT *, {_UNIQUE} AS unique_id, content || (vec_id % 40) AS body FROM {_M}), a AS (SELECT * FROM m WHERE vec_id % 100 = 0),
s AS (SELECT a.point_id, count(b.point_id) AS same FROM a LEFT JOIN m b ON a.body = b.body AND a.collection <> b.collection GROUP BY 1),
n AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY s DESC, point_id) AS r FROM (SELECT a.point_id AS p, b.point_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS s FROM a JOIN m b ON a.collection <> b.collection WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3)),
l AS (SELECT p AS point_id, string_agg(point_id, ',' ORDER BY r) AS near FROM n WHERE r <= 5 GROUP BY 1), c AS (SELECT unique_id, count(*) AS n FROM m GROUP BY 1)
SELECT a.point_id, same, CASE WHEN same = 0 THEN coalesce(near, '') ELSE '' END AS similar, c.n > 1 AS collides, same > 0 OR c.n > 1 AS is_duplicate FROM a JOIN s USING (point_id) LEFT JOIN l USING (point_id) JOIN c USING (unique_id)""")
def duplicate_report(spark, d):
    v = F.col("vec_id")
    m = memories(spark, d).select("vec_id", "point_id", "collection", "embedding", F.concat(F.lit("u"), (v % 331).cast("string")).alias("unique_id"), F.concat("content", (v % 40).cast("string")).alias("content"))
    return dedup.across_collections(m.filter("vec_id % 100 = 0"), m, 0.3).withColumn("similar", F.array_join("similar", ","))


# Quantized vectors and indexes
_PAIRS = f"SELECT query_id, m.*, {_SIM} AS similarity FROM {_M} m, {{queries}} q"


@query("S31_quantized_search", _ranked(_PAIRS, "similarity", 10))
def quantized(spark, d):
    """A stored table of codes is scanned, and the exact vectors of what it proposes are scored again."""
    m, out = memories(spark, d).select("point_id", "embedding"), shared_dir(spark, "codes")
    scale = quantize.fit(m)
    quantize.coded(m, scale).write.parquet(out)
    codes = spark.read.schema("point_id string, norm float, code binary").parquet(out)
    return quantize.searched(codes, m, queries_table(spark, d), scale).select("query_id", "point_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("V1_filtered_index")
def filtered_index(spark, d):
    """A search with filters through the stored index; compared by recall."""
    m, out = memories(spark, d), shared_dir(spark, "cells")
    cells = index.fit(m)
    index.store(m, cells, out)
    found = index.search(spark.read.parquet(out), queries_table(spark, d), cells, 5, search.Filters(collection="code-patterns"))
    return found.select("query_id", "point_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


# Late interaction: the vectors of a memory are the four parts of its embedding
_PARTS = "[embedding[i:i + 15]::DOUBLE[] for i in [1, 17, 33, 49]]"


def _vectors(spark, d):
    parts = F.transform(F.array(F.lit(1), F.lit(17), F.lit(33), F.lit(49)), lambda i: F.slice("embedding", i, F.lit(16)))
    return memories(spark, d).select("vec_id", "point_id", "content", "embedding", parts.alias("vectors"))


@query("V8_late_interaction")
def late_interaction(spark, d):
    """The best memories by late interaction through a store of cells and codes; compared by recall."""
    m, out = _vectors(spark, d).select("vec_id", "point_id", "vectors"), shared_dir(spark, "late")
    cells = late.fit(m)
    late.coded(m, cells).write.parquet(out)
    q = m.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vectors")
    store = spark.read.schema("point_id string, at int, cell int, code binary").parquet(out)
    return late.search(store, m, q, cells).select("query_id", "point_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _questions(spark, d):
    """Every third query has no vectors of its own, every fourth no words."""
    n = F.floor(F.col("vec_id") / 100)
    return _vectors(spark, d).filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.when(n % 4 != 3, F.col("content")).alias("text"), F.when(n % 3 != 1, F.col("vectors")).alias("vectors"))


_MODE = "CASE WHEN query_id // 100 % 4 = 3 THEN 'dense' WHEN query_id // 100 % 3 <> 1 THEN 'hybrid_colbert' ELSE 'hybrid_rrf' END"
_WORDS = "query_id // 100 % 4 <> 3"
_LEGS = f"d AS (SELECT query_id, point_id, round(similarity, 9) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, point_id) AS rank FROM ({_DENSE})) WHERE rank <= 50), s AS (SELECT * FROM ({_LEG.format(s='score', t=_BM25)}) WHERE rank <= 50 AND {_WORDS})".replace("{{", "{").replace("}}", "}")
_FUSED = "f AS (SELECT query_id, point_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT query_id, point_id, rank FROM d UNION ALL SELECT query_id, point_id, rank FROM s) GROUP BY ALL)"


@query("V6_fallback_chain", f"""WITH {_LEGS}, {_FUSED}, v AS (SELECT vec_id, point_id, {_PARTS} AS parts FROM {_M}),
c AS (SELECT p.query_id, p.point_id, round(list_sum([list_max([list_dot_product(x, y) for y in b.parts]) for x in a.parts]), 9) AS score FROM (SELECT query_id, point_id FROM d UNION SELECT query_id, point_id FROM s) p JOIN v a ON a.vec_id = p.query_id JOIN v b ON b.point_id = p.point_id WHERE b.vec_id % 9 <> 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM (SELECT query_id, point_id, score FROM d WHERE {_MODE} = 'dense' UNION ALL SELECT query_id, point_id, score FROM f WHERE {_MODE} = 'hybrid_rrf' UNION ALL SELECT query_id, point_id, score FROM c WHERE {_MODE} = 'hybrid_colbert'))
SELECT query_id, point_id, {_MODE} AS mode, score, rank FROM t WHERE rank <= 5""")
def fallback_chain(spark, d):
    """Each query by the best means it has; one memory of nine has no vectors for late interaction."""
    found = hybrid.searched(memories(spark, d), _questions(spark, d), 5, vectors=_vectors(spark, d).filter("vec_id % 9 <> 0").select("point_id", "vectors"), digits=9)
    return found.withColumn("rank", F.col("rank").cast("long"))


@query("V2_hybrid_decay", f"""WITH {_LEGS}, {_FUSED}, n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS pre FROM f) WHERE pre <= 50 AND {_WORDS}),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, point_id) AS rank FROM (SELECT query_id, point_id, round(0.7 * score + 0.3 * ({_TIME}), 9) AS final FROM n JOIN {_M} USING (point_id) UNION ALL SELECT query_id, point_id, score FROM d WHERE NOT ({_WORDS})))
SELECT query_id, point_id, CASE WHEN {_WORDS} THEN 'hybrid_rrf_decay' ELSE 'dense' END AS mode, round(final, 6) AS score, rank FROM t WHERE rank <= 5""")
def hybrid_decay(spark, d):
    found = hybrid.searched(memories(spark, d), _questions(spark, d), 5, now=_now(), digits=9)
    return found.withColumn("rank", F.col("rank").cast("long")).withColumn("score", F.round("score", 6))


# Impact indexes
@query("V5_impact_index", f"SELECT * FROM ({_LEG.format(s='score', t=_BM25)}) WHERE rank <= 50")
def impact_index(spark, d):
    """The sparse leg through a stored index that leaves out blocks."""
    out = shared_dir(spark, "impacts")
    inverted.store(inverted.build(memories(spark, d)), out)
    found = inverted.search(inverted.load(spark, out), _asked(spark, d).select("query_id", "text"), 50, digits=9)
    return found.select("query_id", "point_id", F.col("rank").cast("long").alias("rank"))


def _turns(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.format_string("%08d-%04d", "conv_id", "turn").alias("point_id"), F.col("text").alias("content"))


_SPLIT = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\W+'), lambda x: x <> '')"


@query("V7_ranked_turns", f"""WITH t AS (SELECT conv_id, turn, printf('%08d-%04d', conv_id, turn) AS point_id, {_SPLIT} AS w FROM conversations), docs AS (SELECT point_id, len(w) AS dl, unnest(w) AS term FROM t),
tf AS (SELECT point_id, dl, term, count(*) AS tf FROM docs GROUP BY ALL), whole AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
asked AS (SELECT DISTINCT conv_id AS query_id, unnest(w) AS term FROM t WHERE conv_id % 100 = 0 AND turn = 0),
s AS (SELECT query_id, point_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN asked USING (term) JOIN df USING (term), whole GROUP BY ALL)
SELECT query_id, point_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM s) WHERE rank <= 10""")
def ranked_turns(spark, d):
    """The turns that say most of what the first turn of every hundredth conversation says."""
    t, out = _turns(spark, d), shared_dir(spark, "turns")
    inverted.store(inverted.build(t.select("point_id", "content")), out)
    asked = t.filter("conv_id % 100 = 0 AND turn = 0").select(F.col("conv_id").alias("query_id"), F.col("content").alias("text"))
    found = inverted.search(inverted.load(spark, out), asked, 10, digits=6)
    return found.select("query_id", "point_id", "score", F.col("rank").cast("long").alias("rank"))
