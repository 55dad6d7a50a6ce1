from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import substring_dedup


def brute(docs):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    first = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - 49):
                key = tuple(w[k : k + 50])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def planted(documents, words):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(r[0], r[1]) for r in documents]
    passage, short, base = text(120), text(49), text(200)
    n = len(docs)
    for k in range(30):
        docs.append((n + k, f"{text(rng.randint(0, 40))}\n{passage}\t{text(rng.randint(0, 40))}"))
        docs.append((n + 100 + k, f"{text(20)} {short} {text(20)}"))
        edited = base.split()
        for _ in range(k % 4):
            edited[rng.randrange(200)] = rng.choice(words)
        docs.append((n + 200 + k, " ".join(edited)))
    docs += [(5, passage + " changed"), (None, passage), (n + 300, "w " * 400), (n + 301, "w " * 70), (n + 302, base), (n + 302, passage), (n + 303, base), (n + 303, base)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("largest", [400, 3])
def test_equals_brute_force(spark, planted, largest):
    d = spark.createDataFrame(planted, "doc_id long, text string").repartition(5).withColumn("start", F.lit(1)).withColumn("words", F.lit("clash"))
    got = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in substring_dedup.dedup(d, largest).collect()]
    assert sorted(got, key=str) == brute(planted)


def test_empty(spark, empty):
    assert substring_dedup.dedup(empty).count() == 0
