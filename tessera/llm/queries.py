"""Queries of the operators, with their contracts' columns, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import audio, decontamination, language, lexical_search, merkle, mixing, ngram_join, oracles, pii, quality, sharding, substring_dedup, token_counts, toxicity

from tessera.llm.columns import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.inspect(audio.store(audio.encode(table(spark, sf_dir, "documents")), shared_dir(spark, "media")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count(table(spark, sf_dir, "documents"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.mapped(table(spark, sf_dir, "documents"), shared_dir(spark, "slot-map"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.removed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontamination.judged(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", F.sha2("text", 256).alias("kept_sha256"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # at the top of the repository; it imports the operators

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mpeg_audio": op1_mpeg_audio,
    "op2_sharding": op2_sharding,
    "op3_token_counts": op3_token_counts,
    "op4_toxicity": op4_toxicity,
    "op5_mixing": op5_mixing,
    "op6_decontamination": op6_decontamination,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_quality": op8_quality,
    "op9_ngram_join": op9_ngram_join,
    "op10_pii": op10_pii,
    "op11_lexical_search": op11_lexical_search,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_language": op13_language,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {
    "op11_lexical_search": oracles.lexical_search(),
    "op12_merkle_manifest": oracles.merkle_manifest(),
    "op5_mixing": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(0) || 'null')), 1, 8))::BIGINT AS h
  FROM documents),
k AS (SELECT *, CASE WHEN size > 0 THEN floor(log2(size) * 4)::BIGINT ELSE -1 END AS class, h % 32 AS bucket FROM d),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM s0),
s2 AS (SELECT *, (CASE (r - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END)::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM s1),
s3 AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS here
  FROM s2 WINDOW b AS (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT arg_min(here, cap / w) AS level FROM s3 WHERE here * w < cap),
s5 AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM s4) * w, cap))::DOUBLE AS target FROM s3),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, bucket, h, size, doc_id) AS place FROM k),
e AS (SELECT n.*, source_size, target, CASE WHEN source_size > 0 THEN least(target / source_size, 2.0) ELSE 0 END AS e,
    ('0x' || substr(md5('mix-1|' || coalesce(n.source, chr(0) || 'null')), 1, 6))::BIGINT / 16777216.0 AS u
  FROM n JOIN s5 ON n.source IS NOT DISTINCT FROM s5.source)
SELECT doc_id, size, source_size, target,
  (size * least(floor(place * e + u) - floor((place - 1) * e + u), ceil(e)))::BIGINT AS taken
FROM e
""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
