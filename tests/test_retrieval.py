"""Near duplicates, indexes, codes and late interaction against plain versions."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import dedup, hybrid, index, inverted, late, quantize, search, similar

DIM = 32


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


@pytest.fixture(scope="module")
def clustered():
    """2,000 vectors around 60 middles."""
    rng = np.random.default_rng(1)
    middles = unit(rng.standard_normal((60, DIM)))
    return unit(middles[rng.integers(0, 60, 2000)] + 0.12 * rng.standard_normal((2000, DIM))).astype(np.float32)


def frame(spark, x, first=0, **more):
    rows = [(f"p{first + i:06d}", [float(v) for v in e], *(f(i) for f in more.values())) for i, e in enumerate(x)]
    return spark.createDataFrame(rows, "point_id string, embedding array<float>" + "".join(f", {n} string" for n in more))


def queries_of(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in e]) for i, e in enumerate(x)], "query_id long, query array<float>")


# Near duplicates
@pytest.fixture(scope="module")
def near_pairs(spark, clustered):
    """Nine of ten rows are one tenant's; incoming rows are stored ones turned by an angle whose cosine is about 0.95 to 0.99."""
    rng = np.random.default_rng(2)
    tenant = lambda i: "hot" if i % 10 else f"g{i % 3}"
    stored = clustered[:1200]
    turned = unit(stored + rng.uniform(0.02, 0.055, (len(stored), 1)) * rng.standard_normal(stored.shape)).astype(np.float32)
    return frame(spark, turned, 10_000, group_id=tenant).cache(), frame(spark, stored, group_id=tenant).cache()


@pytest.mark.parametrize("most", [similar.MOST, 20])
def test_signatures_find_what_the_product_finds(near_pairs, monkeypatch, most):
    monkeypatch.setattr(similar, "MOST", most)  # the smaller one deals every bucket into parts
    incoming, stored = near_pairs
    want = {r.point_id: r for r in dedup.nearest(incoming, stored, ["group_id"], 0.95).collect()}
    got = {r.point_id: r for r in similar.near(incoming, stored, ["group_id"], 0.95).collect()}
    assert len(want) > 600 and set(got) <= set(want)
    same = sum(p in got and got[p].existing_id == want[p].existing_id for p in want)
    assert same >= 0.97 * len(want)
    assert all(r.similarity == pytest.approx(want[p].similarity) for p, r in got.items() if r.existing_id == want[p].existing_id)


def test_very_many_copies_and_the_row_itself(spark):
    e = [1.0, 0.0, 0.0, 0.0]
    rows = [(f"p{i:04d}", "g", e) for i in range(3000)] + [("q", "g", [0.999, 0.01, 0.0, 0.0]), ("lone", "g", [0.0, 0.0, 1.0, 0.0]), ("none", "g", None), ("zero", "g", [0.0] * 4), ("far", "h", e)]
    d = spark.createDataFrame(rows, "point_id string, group_id string, embedding array<float>")
    got = {r.point_id: r.existing_id for r in similar.near(d, d, ["group_id"], 0.95).collect()}
    assert len(got) == 3001 and got["q"] in {f"p{i:04d}" for i in range(3000)} and all(a != b for a, b in got.items())


def test_vectors_that_must_differ_in_a_column(spark):
    rows = [("a", "x", [1.0, 0.0]), ("b", "x", [1.0, 0.0]), ("c", "y", [1.0, 0.01])]
    d = spark.createDataFrame(rows, "point_id string, collection string, embedding array<float>")
    assert {(r.point_id, r.existing_id) for r in similar.near(d, d, [], 0.9, ["collection"]).collect()} - {("c", "a")} == {("a", "c"), ("b", "c"), ("c", "b")}
    assert similar.near(d.limit(0), d, [], 0.9).count() == similar.near(d, d.limit(0), [], 0.9).count() == 0


def test_bands_reach_the_recall_that_they_are_made_for():
    rng = np.random.default_rng(0)
    for rows in (1000, 10**9):
        p = similar.planes(DIM, rows, 0.95)
        x = unit(rng.standard_normal((400, DIM)))
        y = unit(x * 0.95 + unit(np.cross(x[:, :3], rng.standard_normal((400, 3))) @ np.eye(3, DIM)) * 0)
        side = unit(rng.standard_normal((400, DIM)))
        side = unit(side - (side * x).sum(1, keepdims=True) * x)
        y = 0.95 * x + math.sqrt(1 - 0.95**2) * side
        a, b = p.buckets(x.astype(np.float32), True), p.buckets(y.astype(np.float32), False)
        assert np.mean([bool(set(i) & set(j)) for i, j in zip(a, b, strict=True)]) >= 0.98


def test_checked_reads_each_side_a_few_times(spark, near_pairs):
    incoming, stored = (x.withColumn("content", F.concat(F.lit("some content "), "point_id")) for x in near_pairs)
    some = incoming.limit(20).withColumn("content", F.when(F.substring("point_id", -1, 1) == "1", "").otherwise(F.col("content")))
    got = {r.point_id: r.reason for r in dedup.checked(some, stored, ["group_id"]).collect()}
    exact = {r.point_id: r.reason for r in dedup.checked(some, stored, ["group_id"], dedup.nearest).collect()}
    assert got == exact and {"empty_content", "semantic_similarity"} <= set(got.values())


# Quantized vectors
def exact_hits(x, q, k):
    return [set(np.argsort(-(unit(q) @ unit(x).T), axis=1, kind="stable")[i, :k].tolist()) for i in range(len(q))]


def test_codes_with_exact_scores_after_them(spark, clustered):
    m = frame(spark, clustered, kind=lambda i: "a" if i % 4 else "b").repartition(5)
    q = queries_of(spark, clustered[::50] + 0.01)
    scale = quantize.fit(m)
    codes = quantize.coded(m.unionByName(spark.createDataFrame([("null", None, "a")], m.schema)), scale).cache()
    assert codes.count() == 2000 and codes.selectExpr("max(octet_length(code)) AS n").first().n == DIM  # a quarter of four-byte numbers
    want = exact_hits(clustered, clustered[::50] + 0.01, 10)
    found = quantize.searched(codes, m, q, scale, 10).collect()
    hits = [{int(r.point_id[1:]) for r in found if r.query_id == i} for i in range(len(want))]
    assert sum(len(a & b) for a, b in zip(hits, want, strict=True)) >= 0.99 * 10 * len(want)
    assert {r["rank"] for r in found} == set(range(1, 11))
    assert quantize.searched(codes.limit(0), m, q, scale).count() == 0 == quantize.searched(codes, m, q.limit(0), scale).count()


def test_codes_lose_half_a_step_at_most(clustered):
    low, high = clustered.min(0), clustered.max(0)
    scale = quantize.Scale(low, (high - low) / 255)
    assert (np.abs(scale.decode(scale.encode(clustered)) - clustered) <= scale.step * 0.51).all()


# Index
def test_cells_grow_and_filters_keep_the_recall(spark, clustered):
    rng = np.random.default_rng(5)
    asked = unit(clustered[rng.integers(0, 2000, 60)] + 0.05 * rng.standard_normal((60, DIM))).astype(np.float32)  # none of them is stored
    m, q = frame(spark, clustered, collection=lambda i: "a" if i % 5 == 0 else "b", group_id=lambda i: "g").cache(), queries_of(spark, asked)
    for rows in (index.ROWS, 10):
        cells = index.fit(m, sample=1000, rows=rows)
        assert (len(cells.planes) > 0) == (rows == 10)
        stored = index.indexed(m, cells).cache()
        exact = search.dense(m, q, 10, threshold=None)
        assert index.recall(index.search(stored, q, cells, 10), exact).first().recall >= 0.95
        few = search.Filters(collection="a")
        got = index.search(stored, q, cells, 10, few)
        assert {r.collection for r in got.select("collection").distinct().collect()} == {"a"}
        assert index.recall(got, search.dense(m, q, 10, few, threshold=None)).first().recall >= 0.95
    assert index.search(stored.limit(0), q, cells, 10, few).count() == 0


# Late interaction
def test_late_interaction_against_all_sums(spark, clustered):
    rng = np.random.default_rng(3)
    docs = {f"p{i:06d}": clustered[rng.integers(0, 2000, rng.integers(1, 6))] for i in range(600)}
    rows = [(k, [[float(v) for v in e] for e in x]) for k, x in docs.items()]
    d = spark.createDataFrame([*rows, ("none", None), ("empty", [])], "point_id string, vectors array<array<float>>").cache()
    asked = [clustered[rng.integers(0, 2000, 4)] for _ in range(15)]
    q = spark.createDataFrame([(i, [[float(v) for v in e] for e in x]) for i, x in enumerate(asked)] + [(99, None)], "query_id long, vectors array<array<float>>")
    total = {i: sorted(((-float((x @ y.T).max(1).sum()), k) for k, y in docs.items()))[:10] for i, x in enumerate(asked)}
    pairs = q.crossJoin(d).select("query_id", "point_id")
    exact = late.rerank(pairs, d, q, 10).collect()
    assert all([r.point_id for r in sorted((r for r in exact if r.query_id == i), key=lambda r: r["rank"])] == [k for _, k in total[i]] for i in total)
    cells = late.fit(d, sample=2000)
    store = late.coded(d, cells).cache()
    assert store.filter("octet_length(code) <> 32").count() == 0 and len(cells.centroids) > 10
    found = late.search(store, d, q, cells, 10).collect()
    assert {r.query_id for r in found} == set(total)
    hit = sum(r.point_id in {k for _, k in total[r.query_id]} for r in found)
    assert hit >= 0.9 * 10 * len(total)


def test_each_query_by_the_best_means_that_it_has(spark, clustered):
    m = frame(spark, clustered[:300], content=lambda i: f"word{i % 7} text{i}", collection=lambda i: "c", type=lambda i: "t").withColumn("stored_at", F.timestamp_seconds(F.lit(1_700_000_000))).withColumn("access_count", F.lit(0))
    vectors = m.select("point_id", F.array("embedding").alias("vectors"))
    rows = [(k, [float(v) for v in clustered[k]], text, None if many is None else [[float(v) for v in clustered[k]]] * many) for k, (text, many) in enumerate([("word3 text3", 2), ("word3", None), ("word3", 0), (None, 2), (" ?", None), ("nothing known", None)])]
    q = spark.createDataFrame(rows, "query_id long, query array<float>, text string, vectors array<array<float>>")
    modes = lambda found: {r.query_id: r["mode"] for r in found.collect()}
    assert modes(hybrid.searched(m, q, 3, vectors=vectors)) == {0: "hybrid_colbert", 1: "hybrid_rrf", 2: "hybrid_rrf", 3: "dense", 4: "dense", 5: "hybrid_rrf"}
    assert set(modes(hybrid.searched(m, q, 3)).values()) == {"hybrid_rrf", "dense"}
    assert modes(hybrid.searched(m, q, 3, vectors=vectors, now=F.timestamp_seconds(F.lit(1_700_100_000)))) == {0: "hybrid_rrf_decay", 1: "hybrid_rrf_decay", 2: "hybrid_rrf_decay", 3: "dense", 4: "dense", 5: "hybrid_rrf_decay"}


# Impact index
def bm25(docs, text, k):
    own = {i: [w for w in re.split(r"\W+", (t or "").lower(), flags=re.A) if w] for i, t in docs}
    n, mean = len(docs), sum(map(len, own.values())) / len(docs)
    df = Counter(w for x in own.values() for w in set(x))
    out = []
    for i, x in own.items():
        tf = Counter(x)
        s = sum(math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(x) / mean)) for w in set(re.split(r"\W+", (text or "").lower(), flags=re.A)) if w and tf[w])
        out += [(-round(s, 9), i)] if s else []
    return [(i, pytest.approx(-s, abs=1e-6)) for s, i in sorted(out)[:k]]


def test_blocks_that_are_left_out_hold_no_hits(spark, tmp_path):
    rng = random.Random(4)
    names = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    docs = [(f"d{i:05d}", " ".join(rng.choice(names) for _ in range(rng.randint(1, 40)))) for i in range(3000)] + [("null", None), ("empty", ""), ("zz", "w1 w1 w1")]
    asked = [(i, " ".join([rng.choice(names[:900]), "w1", *rng.sample(names, 2)])) for i in range(8)] + [(50, "unknown"), (51, None), (52, "W1 w1!")]
    d, q = spark.createDataFrame(docs, "point_id string, content string"), spark.createDataFrame(asked, "query_id long, text string")
    inverted.store(inverted.build(d), f"file://{tmp_path}/i")
    i = inverted.load(spark, f"file://{tmp_path}/i")
    got = inverted.search(i, q, 10, digits=9).collect()
    for query_id, text in asked:
        assert [(r.point_id, r.score) for r in sorted((r for r in got if r.query_id == query_id), key=lambda r: r["rank"])] == bm25(docs, text, 10)
    assert inverted.share_read(i, q.filter("query_id < 50"), 10).first().share <= 0.5
    assert i.postings.selectExpr("max(size(entries)) AS n").first().n <= 5 * inverted.BLOCK
    assert inverted.search(inverted.build(d.limit(0)), q).count() == 0
