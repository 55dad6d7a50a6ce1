from __future__ import annotations

import random
import zlib
from hashlib import sha256

import pytest

from tessera.llm import merkle

LOWER = str.maketrans(merkle.UPPER, merkle.LOWER)


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def way(levels, i):
    for level in levels[:-1]:
        a = i // 16 * 16
        yield level[a:i], level[i + 1 : a + 16]
        i //= 16


def brute(rows):
    """One row for each document, as a sorted list, straight from the definition."""
    leaf = lambda r, text: h(*map(field, (r[0], r[3], r[2], r[4], text)))
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for s in names}
    trees = {s: climb([leaf(r, r[1]) for r in own[s]]) for s in names}
    top = climb([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(own[s]):
            steps = [*way(trees[s], i), *way(top, k)]
            change = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            now = leaf(r, r[1].translate(LOWER)) if change else trees[s][0][i]
            for left, right in steps:
                now = h(*left, now, *right)
            out.append((str(r[0]), trees[s][0][i], trees[s][-1][0], top[-1][0], h(*(x for left, right in steps for x in left + right)), now, now == top[-1][0]))
    return sorted(out)


def result(df):
    got = merkle.verified(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    return sorted((str(r.doc_id), *r[1:]) for r in got)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_equals_brute_force(spark, documents):
    rows = [*documents, documents[0], (None, "No ID", None, None, None), (None, "Other", "en", "s1", 5), (documents[3][0], "Same id", "en", documents[3][3], 7), (77, "Lone", "de", "\U0001f600", 4), (78, "Lone", "de", "ß", 4)]
    got = result(spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS key", "2 AS place", "3 AS total", "4 AS digest", "5 AS block", "6 AS path"))
    assert got == brute(rows)
    assert {r[6] for r in got} == {True, False}


def test_sources_of_many_blocks_and_many_sources(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("aAbB") * 3, "en", "hot" if i % 3 else f"s{i % 900}", 3) for i in range(16_000)]
    assert result(spark.createDataFrame(rows, DOCS).repartition(7)) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 4096, 4097])
def test_sizes_at_the_edges_of_levels(spark, n):
    rows = [(i, "Text", "en", "s", 4) for i in range(n)]
    assert result(spark.createDataFrame(rows, DOCS)) == brute(rows)


def test_empty_and_one_row(spark, empty):
    assert result(empty) == []
    rows = [(5, None, None, None, None)]
    got = result(spark.createDataFrame(rows, DOCS))
    assert got == brute(rows) and got[0][1] == got[0][2] == got[0][3] and got[0][4] == sha256(b"").hexdigest()
