from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import ngram_join


def sets(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else ("text", text or "")


def brute(docs):
    s = [(i, sets(t)) for i, t in docs]
    group, links = list(range(len(s))), defaultdict(int)
    def find(x):
        while group[x] != x:
            x = group[x]
        return x
    for x in range(len(s)):
        for y in range(x):
            a, b = s[x][1], s[y][1]
            if a == b or (isinstance(a, frozenset) and isinstance(b, frozenset) and len(a & b) >= 0.8 * len(a | b)):
                links[x] += 1
                links[y] += 1
                group[find(x)] = find(y)
    least = defaultdict(list)
    for x in range(len(s)):
        least[find(x)].append(s[x][0])
    return sorted((s[x][0], min(least[find(x)]), links[x]) for x in range(len(s)))


@pytest.fixture(scope="module")
def planted(documents, words):
    rng = random.Random(9)
    docs = [(r[0], r[1]) for r in documents if len(r[1] or "") < 20_000]
    n = 1000
    for size in (6, 60, 150, 400):
        base = [rng.choice(words) for _ in range(size)]
        for k in range(25):
            w = list(base)
            for _ in range(rng.randint(0, max(1, size // 40))):
                w[rng.randrange(size)] = rng.choice(words)
            docs.append((n := n + 1, (" " if k % 2 else ", ").join(w) + "." * (k % 3)))
    return [*docs, (n + 1, "a b"), (n + 2, "A, b!"), (n + 3, "..."), (n + 4, "..."), (n + 5, ". .")]


@pytest.mark.parametrize("block", [512, 4])
def test_equals_brute_force(spark, planted, block):
    d = spark.createDataFrame(planted, "doc_id long, text string").withColumn("node", F.lit("clash")).withColumn("key", F.lit(1))
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_join.join(d, block=block).collect())
    assert got == brute(planted)


def test_one_of_each_group_stays(spark, planted):
    d = spark.createDataFrame(planted, "doc_id long, text string").withColumn("extra", F.lit(1))
    got = ngram_join.representatives(d)
    assert got.columns == d.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted({c for _, c, _ in brute(planted)})


def test_repeated_rows_nulls_and_empty(spark, empty):
    assert ngram_join.join(empty).count() == 0
    d = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, None), (3, ""), (None, "q r s t u"), (1, "other text")], "doc_id long, text string")
    got = ngram_join.join(d).collect()
    assert sorted((r.doc_id or 0, r.n_links) for r in got) == [(0, 0), (1, 0), (1, 1), (1, 1), (2, 1), (3, 1)]
    assert sorted((str(r.doc_id), r.text) for r in ngram_join.representatives(d).collect()) == [("1", "a b c d e f g"), ("1", "other text"), ("2", None), ("None", "q r s t u")]


def test_representatives_lose_no_class(spark):
    """Repeated and null doc_ids: one row of each class stays, the same on every run; no text goes without a near copy that stays."""
    base = " ".join(f"w{k}" for k in range(100))
    near = base + " more"
    texts = {"a": "one two three four five six", "b": "seven eight nine ten eleven", "c": "red green blue yellow black white"}
    rows = [(7, texts["a"], 1), (7, texts["b"], 1), (9, texts["c"], 1), (3, near, 1), (2, base, 1), (2, base, 2), (2, texts["a"], 5), (None, near, 1), (None, "only here, without a name", 1), (None, "only here without a name", 2)]
    d = spark.createDataFrame(rows, "doc_id long, text string, rid int").withColumn("m", F.create_map(F.lit("k"), F.col("rid")))
    got = {(r.doc_id, r.text, r.rid) for r in ngram_join.representatives(d).collect()}
    assert {(i, t) for i, t, _ in got if i} == {(7, texts["b"]), (9, texts["c"]), (2, base), (2, texts["a"])} and len(got) == 5
    assert got == {(r.doc_id, r.text, r.rid) for r in ngram_join.representatives(d.repartition(7).orderBy(F.desc("rid"))).collect()}
    joined = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in ngram_join.join(d).collect())
    assert joined == sorted([("7", "2", 1), ("7", "7", 0), ("9", "9", 0), ("3", "2", 3), ("2", "2", 3), ("2", "2", 3), ("2", "2", 1), ("None", "2", 3), ("None", "None", 1), ("None", "None", 1)])


def test_ids_keep_their_type(spark):
    d = spark.createDataFrame([("x", "a b c d e f"), ("y", "a b c d e f")], "doc_id string, text string")
    assert sorted((r.doc_id, r.class_id) for r in ngram_join.join(d).collect()) == [("x", "x"), ("y", "x")]


def test_bands_reach_the_recall():
    bands, rows = ngram_join.bands_and_rows(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 160


@pytest.mark.parametrize(("lo", "hi"), [(0, 0), (0, 1)])
def test_a_path_in_one_bucket_keeps_together(lo, hi):
    """a-b, b-c, c-d with a < c and d < b: a and b name each other, as do c and d, if each names its least neighbour."""
    runs = {b"1a": range(0, 100), b"4b": range(8, 108), b"2c": range(16, 116), b"3d": range(24, 124)}
    far = {b"5e": range(500, 600)}
    rows = [
        {"key": 7, "lo": lo, "hi": hi, "block": hi if node in (b"4b", b"3d") else lo, "node": node, "copies": k + 1, "keys": [7], "shingles": np.array(run, np.uint64).tobytes()}
        for k, (node, run) in enumerate({**runs, **far}.items())
    ]
    found = [r for b in ngram_join._compare(0.8)(iter(pa.RecordBatch.from_pylist(rows).slice(k, 2) for k in range(0, len(rows), 2))) for r in b.to_pylist()]
    assert sorted(r["node"] for r in found) == sorted(runs)
    assert {r["node"]: r["links"] for r in found} == {b"1a": 2, b"4b": 1 + 3, b"2c": 2 + 4, b"3d": 3}
    group = {n: n for n in runs}
    for _ in runs:
        for r in found:
            group[r["node"]] = group[r["to"]] = min(group[r["node"]], group[r["to"]])
    assert set(group.values()) == {b"1a"}


def test_chains_equal_brute_force(spark):
    """Chains of texts, each near to the next alone, many of which share a bucket."""
    rng, docs = random.Random(5), []
    for chain in range(30):
        words = [f"w{chain}x{k}" for k in range(220)]
        docs += [(0, " ".join(words[8 * k : 8 * k + 100])) for k in range(9)]
    rng.shuffle(docs)
    docs = [(k, t) for k, (_, t) in enumerate(docs)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    for block in (512, 3):
        assert sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_join.join(d, block=block).collect()) == brute(docs)


def test_very_long_texts_are_compared_whole(spark, words):
    rng = random.Random(8)
    base = [rng.choice(words) + str(rng.randrange(10**6)) for _ in range(30_000)]
    near, far = list(base), list(base)
    for k in range(25_000, 25_400):  # all differences stand far behind the start
        near[k] = f"x{k}"
    for k in range(15_000, 30_000):
        far[k] = f"y{k}"
    docs = [(1, " ".join(base)), (2, ", ".join(near)), (3, " ".join(far)), (4, " ".join(base[:200])), (5, "z" * 300_000), (6, "z" * 300_000)]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == brute(docs) == [(1, 1, 1), (2, 1, 1), (3, 3, 0), (4, 4, 0), (5, 5, 1), (6, 5, 1)]
