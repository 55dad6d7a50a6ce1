from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import lexical_search

TERM = re.compile(lexical_search.TERM)


def cut(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    """(item, rank, doc_id, score), straight from the definition."""
    own = [(i, cut(t)) for i, t in docs]
    n, total = sum(bool(t) for _, t in own), sum(len(t) for _, t in own)
    counts = [(i, len(t), Counter(t)) for i, t in own]
    asked = {}
    for item, t in items:
        asked.setdefault(item, []).extend(cut(t))
    out = set()
    for item, terms in asked.items():
        found = []
        for i, size, tf in counts:
            score = 0
            for t in terms:
                if tf[t]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in c for _, _, c in counts) + 1)))
                    score += w * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 8 * (25 + 75 * size * n // total)))
            if score > 0:
                found.append((-score, i is None, i, score))
        out |= {(item, r + 1, i, score) for r, (_, _, i, score) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])}
    return out


def result(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS score", "2 AS rank", "'x' AS item_id", "3 AS term")
    got = lexical_search.search(d, spark.createDataFrame(items, "item_id long, text string"), **more).collect()
    assert len({(r.item_id, r["rank"]) for r in got}) == len(got)
    return {(r.item_id, r["rank"], r.doc_id, r.score) for r in got}


@pytest.fixture(scope="module")
def items(words):
    rng = random.Random(5)
    some = [(k, " ".join(rng.choice(words[:60]) for _ in range(rng.randint(1, 30)))) for k in range(12)]
    return [*some, (12, None), (13, " .,! "), (14, some[0][1].upper()), (15, "qqq zzz"), (16, "th th th er"), (16, "ON"), (None, "er on")]


def test_equals_brute_force(spark, documents, items):
    docs = [(d[0], d[1]) for d in documents] + [(None, "th er on"), (None, "er"), (3, "th ER on er"), (-5, documents[0][1])]
    assert result(spark, docs, items) == brute(docs, items)


def test_blocks_of_items_and_short_runs_give_the_same(spark, documents, items, monkeypatch):
    docs = [(d[0], d[1]) for d in documents]
    want = brute(docs, items, 3)
    assert result(spark, docs, items, k=3, block_pairs=40) == want
    monkeypatch.setattr(lexical_search.accumulate, "__defaults__", (7,))
    assert result(spark, docs, items, k=3) == want


def test_very_many_equal_texts_go_by_doc_id(spark):
    docs = [(i, "alpha beta") for i in range(5000, 0, -1)] + [(9000, "alpha")] + [(-i, "gamma delta") for i in range(1, 9000)]
    got = result(spark, docs, [(1, "alpha BETA"), (2, "gamma")])
    assert [x[2] for x in sorted(got) if x[0] == 1] == list(range(1, 11))
    assert [x[2] for x in sorted(got) if x[0] == 2] == list(range(-8999, -8989))


def test_empty_tables(spark):
    assert result(spark, [], [(1, "a b")]) == set()
    assert result(spark, [(1, "a b"), (2, None)], []) == set()
    assert result(spark, [(1, None), (2, " ")], [(1, "a")]) == set()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**40), st.integers(-9, 9)), max_size=60))
def test_radix_sort_is_a_stable_sort(pairs):
    key, value = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)
    k, v = lexical_search.by_radix(key, value, 2**40 + 1)
    assert list(zip(k.tolist(), v.tolist(), strict=True)) == sorted(pairs, key=lambda p: p[0])


def test_long_documents_of_huge_tables_do_not_overflow():
    n, total, length = 10**12, 10**15, 10**9
    assert lexical_search.length_factor(np.array([length, 1]), n, total).tolist() == [25 + 75 * length * n // total, 25 + 75 * n // total]
