from __future__ import annotations

import math
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from tessera.functions import vector
from tessera.operators import dedup, pairs, quantize, search

MEMORY = "point_id string, collection string, unique_id string, content string, embedding array<float>"


def _cosine(a, b):
    if a is None or b is None:
        return None
    if len(a) != len(b):
        return None if any(a) and any(b) else 0.0
    dot = na = nb = 0.0
    for x, y in zip(a, b, strict=True):
        dot, na, nb = dot + x * y, na + x * x, nb + y * y
    return max(-1.0, min(1.0, dot / math.sqrt(na * nb))) if na * nb else 0.0


@pytest.fixture(scope="module")
def made(spark):
    """Random vectors, many copies of one, zero vectors, nulls and a shorter one."""
    rng = random.Random(3)
    vectors = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(500)]
    vectors += [vectors[3]] * 120 + [[0.0] * 6, None, [1.0, 2.0]]
    rows = [(f"p{i * 7919 % 1000:04d}", f"c{i % 3}", f"u{i}", f"t{i}", v) for i, v in enumerate(vectors)]
    m = spark.createDataFrame(rows, MEMORY).repartition(3)
    return m, {r.point_id: r for r in m.collect()}


def _queries(rows, spark):
    own = sorted(r for r in rows if r[-2:] in ("00", "21", "57"))
    own += [k for k, r in rows.items() if r.embedding is None or len(r.embedding) < 6 or not any(r.embedding)]
    return spark.createDataFrame([(k, rows[k].collection, rows[k].embedding) for k in own], "query_id string, collection string, query array<float>"), own


@pytest.mark.parametrize("threshold", [None, 0.2])
@pytest.mark.parametrize("digits", [None, 2])
@pytest.mark.parametrize("apart", [False, True])
def test_nearest_equals_a_plain_version(spark, made, threshold, digits, apart, monkeypatch):
    m, rows = made
    q, own = _queries(rows, spark)
    monkeypatch.setattr(pairs, "TOGETHER", 7)
    got = search.nearest(m, q if apart else q.drop("collection"), 10, threshold, digits, "collection" if apart else None).collect()
    for k in own:
        found = [(s, p) for p, r in rows.items() for s in [_cosine(r.embedding, rows[k].embedding)] if not (apart and r.collection == rows[k].collection) and (threshold is None or (s is not None and s >= threshold))]
        found = [(s if s is None or digits is None else float(Decimal(repr(s)).quantize(Decimal(10) ** -digits, ROUND_HALF_UP)), p) for s, p in found]
        want = sorted(found, key=lambda x: (x[0] is None, -(x[0] or 0.0), x[1]))[:10]
        assert [(r.similarity, r.point_id) for r in sorted((r for r in got if r.query_id == k), key=lambda r: r["rank"])] == want


def test_scored_equals_the_expression(spark, made):
    m, rows = made
    q, _ = _queries(rows, spark)
    got = {(r.query_id, r.point_id): r.similarity for r in search.scored(m, q.drop("collection")).collect()}
    want = {(r.query_id, r.point_id): r.s for r in m.crossJoin(q.drop("collection")).select("query_id", "point_id", vector.cosine(F.col("embedding"), F.col("query")).alias("s")).collect()}
    assert got == want and len(got) == len(rows) * q.count()


def test_a_vector_is_similar_to_itself_by_one(spark, made):
    """The root of each square alone gives 0.9999999999999999 for some, which moves a budget that lies at a step."""
    m, _ = made
    a = F.col("embedding")
    have = m.filter(F.size("embedding") == 6).filter(vector.square(a) > 0)
    assert have.filter(vector.cosine(a, a) != 1.0).count() == 0 and have.filter(vector.dot(a, a) / (vector.norm(a) * vector.norm(a)) != 1.0).count() > 0


def test_duplicates_across_collections_without_the_own_one(spark, made):
    m, rows = made
    got = {r.point_id: r.similar for r in dedup.across_collections(m.filter("point_id LIKE '%21'"), m, 0.2).collect()}
    for k, ids in got.items():
        found = [(-round(s, 9), p) for p, r in rows.items() for s in [_cosine(r.embedding, rows[k].embedding)] if r.collection != rows[k].collection and s is not None and s >= 0.2]
        assert ids == [p for _, p in sorted(found)[:5]]


def test_lexical_search_by_distinct_texts_equals_all_pairs(spark, monkeypatch):
    """Contents with many rows, equal queries, nulls and empties: ranks as of all pairs, and no pair lost or made twice."""
    rng = random.Random(5)
    words = ["memory", "about", "red", "blue", "green", "seven"]
    contents = [" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(40)] + ["", None, "memory memory", "rare"]
    m = spark.createDataFrame([(f"p{i * 7919 % 1000:03d}", "memory red" if i % 3 else contents[i % len(contents)]) for i in range(600)], "point_id string, content string")
    q = spark.createDataFrame([(1, "memory red"), (2, "memory red"), (3, "rare"), (4, "Memory, about: SEVEN seven"), (5, ""), (6, None), (7, "nothing")], "query_id int, text string")
    monkeypatch.setattr(search, "SHARED", 50)
    rows = m.collect()
    split = {r.point_id: [w for w in r.content.lower().split() if w] for r in rows if r.content is not None}
    n, avg = len(rows), sum(map(len, split.values())) / len(split)
    df = {w: sum(w in t for t in split.values()) for w in [*words, "rare"]}
    want = {}
    for a in q.collect():
        for p, t in split.items():
            shared = {w.strip(",:") for w in (a.text or "").lower().split()} & set(t)
            if shared:
                want[a.query_id, p] = sum(math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / avg)) for w in shared)
    got = search.bm25(m, q).collect()
    assert len(got) == len(want) and {(r.query_id, r.point_id): round(r.score, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    for k in (1, 7, 300):
        found = search.lexical(m, q, k, 9).collect()
        for a in range(1, 8):
            order = sorted((-round(v, 9), p) for (i, p), v in want.items() if i == a)[:k]
            assert [(r.point_id, -r.score) for r in sorted((r for r in found if r.query_id == a), key=lambda r: r["rank"])] == [(p, s) for s, p in order]


def test_nearest_of_a_block_in_parts_equals_all_pairs(spark, made, monkeypatch):
    m, _ = made
    rows = [r for r in m.collect() if r.embedding is not None and len(r.embedding) == 6]
    d = spark.createDataFrame([(r.point_id, None if i % 50 == 0 else f"g{min(i % 9, 2)}", r.embedding) for i, r in enumerate(rows)], "point_id string, group_id string, embedding array<float>")
    i, s = d.filter("point_id < 'p0600'"), d.filter("point_id > 'p0300'")
    monkeypatch.setattr(dedup, "PART", 40)
    known = s.collect()
    got = {r.point_id: (r.similarity, r.existing_id) for r in dedup.nearest(i, s, ["group_id"], 0.6).collect()}
    want = {}
    for a in i.collect():
        found = [(c, b.point_id) for b in known if a.group_id is not None and a.group_id == b.group_id and a.point_id != b.point_id for c in [_cosine(a.embedding, b.embedding)] if c >= 0.6]
        if found:
            want[a.point_id] = max(found)
    assert got == want and len(want) > 100


def test_codes_propose_every_row_that_may_be_a_hit(spark):
    """More copies than four times the hits, their least ids last: ties go by point_id."""
    rng = random.Random(9)
    one = [rng.gauss(0, 1) for _ in range(8)]
    rows = [(f"p{i:04d}", one if i % 2 else [rng.gauss(0, 1) for _ in range(8)]) for i in reversed(range(600))]
    m = spark.createDataFrame(rows, "point_id string, embedding array<float>").coalesce(2)
    q = spark.createDataFrame([(1, one)], "query_id int, query array<float>")
    scale = quantize.fit(m)
    got = quantize.searched(quantize.coded(m, scale), m, q, scale, 10).orderBy("rank").collect()
    assert [(r.point_id, r.score) for r in got] == [(f"p{i:04d}", 1.0) for i in range(1, 20, 2)]
