"""Searches whose pairs of rows and queries must not pass through joins, shuffles or row by row expressions; results as of plain versions."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.operators import index, inverted, late, pairs

DIM = 16


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_an_index_multiplies_the_rows_of_a_cell_with_the_queries_that_look_into_it(spark, monkeypatch):
    """No row is made for a pair; hits are those of all pairs of a query and a row of its cells. A null query has none."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((900, DIM)).astype(np.float32)
    x[600:700] = x[7]  # copies: ties go by the least id
    m = spark.createDataFrame([(f"p{i:04d}", [float(v) for v in e]) for i, e in enumerate(x)], "point_id string, embedding array<float>").repartition(3)
    q = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(0, 900, 9)] + [(-1, None)], "query_id long, query array<float>")
    cells = index.fit(m, sample=400, rows=20)
    assert 0 < len(cells.planes) and cells.probes < len(cells.centroids)
    stored = index.indexed(m, cells).cache()
    found = index.search(stored, q, cells, 10)
    assert "Join" not in _plan(found)
    got = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.point_id, pytest.approx(r.score, abs=1e-12)))
    # the same in one task, by small products and batches
    monkeypatch.setattr(pairs, "HELD", 100)
    monkeypatch.setattr(pairs, "TILE", (30, 16))
    asked = pairs.Asked.of(q.filter("query IS NOT NULL").toArrow(), "query", None)
    parts = pairs.scan_cells(iter(stored.toArrow().to_batches(max_chunksize=200)), asked, cells.looked(asked.vectors.astype(np.float32), 10), "embedding", 10)
    alone = {}
    for r in sorted((r for p in parts for r in p.to_pylist()), key=lambda r: (-r["similarity"], r["point_id"])):
        alone.setdefault(r["query_id"], []).append((r["point_id"], r["similarity"]))
    assert alone == got
    own, bits, unit = cells.cell(x), len(cells.planes), x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    _, probes, flips = cells.taken(10)
    for i in range(0, 900, 9):
        looked = set()
        for c in cells.nearest(x[i : i + 1], probes)[0]:
            side = cells.sides(x[i : i + 1], np.array([c]))[0]
            codes = {sum(1 << int(j) for j in np.flatnonzero(side > 0))}
            for j in np.argsort(np.abs(side))[:flips]:
                codes |= {code ^ (1 << int(j)) for code in codes}
            looked |= {(int(c) << bits) | code for code in codes}
        score = np.round(unit @ unit[i], 12)
        assert got.pop(i) == [(f"p{r:04d}", score[r]) for r in sorted((r for r in range(900) if own[r] in looked), key=lambda r: (-score[r], r))[:10]]
    assert not got


def test_late_interaction_sums_what_meets_in_the_task_that_holds_the_document(spark, monkeypatch):
    """No row is made for a vector that meets a query's; sums are those of all pairs by codes, of equal ones the least ids are kept."""
    rng = np.random.default_rng(6)
    docs = [rng.standard_normal((rng.integers(1, 6), DIM)).astype(np.float32) for _ in range(300)]
    docs[0][1:] = docs[0][0] + 0.01 * rng.standard_normal((len(docs[0]) - 1, DIM))  # several vectors in one cell
    docs[200:290] = [docs[7]] * 90  # more copies than are kept
    asked = [docs[7], docs[0], -docs[3], *[rng.standard_normal((3, DIM)).astype(np.float32) for _ in range(6)]]
    nested = lambda x: [[float(v) for v in e] for e in x]
    d = spark.createDataFrame([(f"p{i:04d}", nested(x)) for i, x in enumerate(docs)] + [("null", None)], "point_id string, vectors array<array<float>>").repartition(3)
    q = spark.createDataFrame([(i, nested(x)) for i, x in enumerate(asked)] + [(98, []), (99, None), (97, [None])], "query_id long, vectors array<array<float>>")
    cells = late.fit(d, sample=400, probes=2)
    store = late.coded(d, cells).cache()
    found = late.candidates(store, q, cells, 20)
    assert "Join" not in _plan(found)
    got = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.point_id, pytest.approx(r.score, abs=1e-5)))

    def plain(x, own):
        total, met = 0.0, False
        for v in x:
            looked = set(np.argsort(-(v @ cells.centroids.T), kind="stable")[:2].tolist())
            best = max((float(v.astype(np.float64) @ e.astype(np.float64)) for c, e in own if c in looked), default=None)
            total, met = (total, met) if best is None else (total + best, True)
        return total if met else None

    for i, x in enumerate(asked):
        scores = {k: plain(x, list(zip(cell.tolist(), cells.decode(cell, code), strict=True))) for k, y in enumerate(docs) for cell, code in [cells.encode(y)]}
        order = sorted((k for k in scores if scores[k] is not None), key=lambda k: (-round(scores[k], 5), k))[:20]
        assert got.pop(i) == [(f"p{k:04d}", scores[k]) for k in order]
    assert not got
    # small tiles in one task keep the same
    monkeypatch.setattr(late, "TILE", (37, 1024))
    whole = store.selectExpr("point_id", "struct(cell, code) AS c").groupBy("point_id").agg({"c": "collect_list"}).toArrow()
    assert whole.num_rows == 300
    block = late.Asked.of(spark.createDataFrame([(0,)], "query_id long").toArrow().column(0).combine_chunks(), [nested(docs[7])], cells)
    alone = [r for b in late._scan(iter(whole.to_batches(max_chunksize=64)), [block], cells, 20) for r in b.to_pylist()]
    assert sorted(r["id"] for r in alone) == [f"p{k:04d}" for k in [7, *range(200, 219)]]


def _bm25(docs, text, k, digits):
    own = {i: re.findall(r"\w+", (t or "").lower()) for i, t in docs}
    n, mean, df = len(docs), sum(map(len, own.values())) / len(docs), Counter(w for x in own.values() for w in set(x))
    wanted, out = sorted(set(re.findall(r"\w+", (text or "").lower()))), []
    for i, x in own.items():
        tf = Counter(x)
        s = sum(math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(x) / mean)) for w in wanted if tf[w])
        out += [(-round(s, digits), i)] if s else []
    return [(i, pytest.approx(-s, abs=1e-6)) for s, i in sorted(out)[:k]]


def test_many_queries_are_scored_together_by_groups_of_blocks(spark, tmp_path, monkeypatch):
    """No row is made for a query and a block or document; the hits are those of all pairs, of equal scores the least ids."""
    rng = random.Random(8)
    names = [f"w{int(rng.paretovariate(0.7))}" for _ in range(2000)]
    docs = [(f"d{i:05d}", " ".join(rng.choice(names) for _ in range(rng.randint(1, 30)))) for i in range(1500)]
    docs += [(f"c{i:05d}", "w1 w2 same") for i in rng.sample(range(400), 400)] + [("null", None), ("empty", "")]
    asked = [(i, " ".join([rng.choice(names), "w1", *rng.sample(names, 3)])) for i in range(60)] + [(90, "unknown"), (91, None), (92, "W1 w2 same!"), (93, "same")]
    d, q = spark.createDataFrame(docs, "point_id string, content string"), spark.createDataFrame(asked, "query_id long, text string")
    inverted.store(inverted.build(d), f"file://{tmp_path}/i")
    i = inverted.load(spark, f"file://{tmp_path}/i")
    monkeypatch.setattr(inverted, "GROUP", 5)
    found = inverted.search(i, q, 10, digits=9)
    assert "Aggregate" not in _plan(found) and "rank" in found.columns
    got = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.point_id, r.score))
    for query_id, text in asked:
        assert got.pop(query_id, []) == _bm25(docs, text, 10, 9)
    assert not got
    assert {r.term: r.df for r in i.terms.collect()} == Counter(w for _, t in docs for w in set((t or "").split()))
    few = inverted.search(i, q.filter("query_id IN (3, 92)"), 10, digits=9).collect()
    assert [(r.point_id, r.score) for r in sorted((r for r in few if r.query_id == 92), key=lambda r: r["rank"])] == _bm25(docs, "w1 w2 same", 10, 9)
    assert inverted.search(inverted.build(d.limit(0)), q).count() == 0


def test_queries_leave_out_groups_and_slices_keep_every_sum(monkeypatch):
    """One task, small slices and batches that part a group: the best are those of all sums."""
    import pyarrow as pa

    rng = np.random.default_rng(9)
    terms = [f"t{i:02d}" for i in range(40)]
    rarity = {t: float(r) for t, r in zip(terms, rng.uniform(0.5, 6, 40), strict=True)}
    pairs_of = [(i, t) for i in range(50) for t in rng.choice(terms, 5, replace=False)]
    asked = inverted.Asked.of(pa.table({"query_id": [p[0] for p in pairs_of], "term": [p[1] for p in pairs_of], "rarity": [rarity[p[1]] for p in pairs_of]}))
    rows, want = [], {}
    for group in range(6):
        for t in terms:
            own = [(f"p{group * 30 + int(d):03d}", float(rng.uniform(0.1, 2) / (1 + group))) for d in rng.choice(30, 8, replace=False)]
            rows += [{"group": group, "term": t, "top": max(g for _, g in own), "entries": [{"point_id": p, "gain": g} for p, g in own]}]
            for q, u in pairs_of:
                for p, g in own if u == t else []:
                    want[q, p] = want.get((q, p), 0.0) + g * rarity[t]
    table = pa.Table.from_pylist(rows)
    monkeypatch.setattr(inverted, "SUMS", 50)
    monkeypatch.setattr(inverted, "TOGETHER", 17)
    out = [r for b in inverted._scan(iter(table.to_batches(max_chunksize=33)), asked, 4, None) for r in b.to_pylist()]
    for q in range(50):
        best = sorted(((-s, p) for (i, p), s in want.items() if i == q))[:4]
        assert sorted((-r["score"], r["point_id"]) for r in out if r["query_id"] == q) == [(pytest.approx(s, abs=1e-9), p) for s, p in best]


def test_all_sums_of_best_products_equal_sql(spark):
    """Lists of other lengths, null vectors on either side, and sums that lie at a half; no row by row expression over vectors."""
    import duckdb

    rng = np.random.default_rng(11)
    lists = [[[float(v) for v in e] for e in rng.standard_normal((rng.integers(1, 6), 4)).astype(np.float32)] for _ in range(80)]
    lists += [[None, lists[3][0]], [None], [[0.5, 0.0, 0.0, 0.0], None], [[0.000001, 0.0, 0.0, 0.0]], [[0.0, 0.0, 0.0, 0.0]]]
    rows = [(i, k, v) for i, x in enumerate(lists) for k, v in enumerate(x)]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "doc_id long, vectors array<array<float>>").repartition(3)
    asked = [0, 3, 11, 80, 81, 82, 84]
    found = late.all_sums(t, t.filter(t.doc_id.isin(asked)).withColumnRenamed("doc_id", "query_id"), 6)
    assert "Join" not in _plan(found)
    con = duckdb.connect()
    con.execute("CREATE TABLE e (id BIGINT, n INT, v FLOAT[])")
    con.executemany("INSERT INTO e VALUES (?, ?, ?)", rows)
    want = con.execute(f"""WITH t AS (SELECT id, list(v::DOUBLE[] ORDER BY n) AS m FROM e GROUP BY id)
        SELECT q.id, d.id, list_sum(list_transform(q.m, lambda x: list_max(list_transform(d.m, lambda y: list_dot_product(x, y))))) FROM t q, t d WHERE q.id IN {tuple(asked)}""").fetchall()
    got = {(r.query_id, r.doc_id): r.score for r in found.collect()}
    assert len(got) == len(want) == len(asked) * len(lists)
    assert all(got[q, d] is None if s is None else got[q, d] == pytest.approx(s, abs=6e-7) for q, d, s in want)
    assert any(s is None for _, _, s in want)


def test_sums_near_a_half_are_those_in_the_order_of_the_dimensions(spark):
    from pyspark.sql import functions as F

    from tessera.functions import vector

    rng = np.random.default_rng(12)
    x = np.round(rng.uniform(-1, 1, (60, 3, 4)) * 64) / 64  # all products are multiples of 2 ** -12: halves of six digits among them
    t = spark.createDataFrame([(i, [[float(v) for v in e] for e in y]) for i, y in enumerate(x)], "doc_id long, vectors array<array<float>>")
    q = t.filter("doc_id < 20").withColumnRenamed("doc_id", "query_id")
    got = {(r.query_id, r.doc_id): r.score for r in late.all_sums(t, q, 6).collect()}
    plain = t.crossJoin(q.withColumnRenamed("vectors", "a")).select("query_id", "doc_id", F.round(vector.max_sim(F.col("a"), F.col("vectors")), 6).alias("s"))
    assert got == {(r.query_id, r.doc_id): r.s for r in plain.collect()}
