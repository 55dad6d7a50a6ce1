from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, got, free = 1.5 * sum(sizes.values()), {}, set(sizes)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return got | share
        for s in over:
            got[s] = 2.0 * sizes[s]
            left -= got[s]
        free -= over
    return got


def test_targets_and_copies(spark, docs, documents):
    got = mixing.mix(docs.withColumn("size", F.lit("clash")).withColumn("target", F.lit(1))).collect()
    count = {d[0]: len(re.findall(r"[^\x20\x09-\x0D]+", d[1] or "")) for d in documents}
    sizes = {}
    for d in documents:
        sizes[d[3]] = sizes.get(d[3], 0) + count[d[0]]
    want, source = targets(sizes), {d[0]: d[3] for d in documents}
    assert len(got) == len(documents)
    for r in got:
        assert r["size"] == count[r.doc_id] and r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]])
        assert r.taken == r["size"] * r.copies <= 2 * r["size"]
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_hot_source_comes_near_its_target(spark):
    d = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7)).alias("source"), F.repeat(F.lit("w "), (1 + F.pmod(F.hash("id"), F.lit(50))).cast("int")).alias("text"))
    got = mixing.mix(d).join(d.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 0.005 * r.target for r in got)


def test_no_words_and_empty(spark, empty):
    assert mixing.mix(empty).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")).collect()
    assert [r.taken for r in got] == [0, 0] and [r.target for r in got] == [0.0, 0.0]
