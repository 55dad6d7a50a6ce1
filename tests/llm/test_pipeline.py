from __future__ import annotations

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from tessera.llm import decontamination, mixing, ngram_join

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, words):
    """Tables with junk, near copies, contaminated documents, nulls and repeated rows."""
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    bench = [(k, text(20)) for k in range(3)]
    rows, labels = [], []
    for i in range(400):
        t = text(rng.randint(20, 90))
        if i % 5 == 1:
            t = " ".join(w + "###" for w in t.split())
        elif i % 10 == 2:
            t = rows[-2][1] if i > 2 and rows[-2][1] else t
        elif i % 10 == 3:
            w = text(120).split()
            t = " ".join(w)
            rows.append((1000 + i, " ".join(w[:60] + ["zz"] + w[60:]), "en", "s1", 1))
        elif i % 10 == 4:
            t = f"{t} {bench[i % 3][1]}"
        rows.append((i, t, "en", None if i % 19 == 0 else f"s{i % 4}", len(t)))
        labels.append((i, int(i % 5 != 1), 0))
    rows += [(2000, None, None, None, None), (2001, "", "en", "s1", 0), rows[5], rows[5]]
    at = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages_against_brute_force(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    step = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        step[name] = ([tuple(r) for r in before.collect()], [tuple(r) for r in docs.collect()])
    before, after = step["quality classifier"]
    assert not [r for r in after if r[1] and "###" in r[1]]
    assert len([r for r in before if r[1] and "###" not in r[1]]) <= len([r for r in after if r[1]]) + 4
    before, after = step["n-gram Jaccard join"]
    sets = {r[0]: frozenset(re.findall(r"(?=((?:\S+ ){4}\S+))", (r[1] or "").lower().replace(".", ""))) for r in after}
    ids = sorted(sets)
    assert len(ids) == len(after)
    assert not [(x, y) for x in ids for y in ids if x < y and sets[x] and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])]
    assert {r[1] for r in before if r[0] < 1000 and r[0] % 10 == 6} <= {r[1] for r in after}
    before, after = step["benchmark decontamination"]
    found = {r.doc_id for r in decontamination.judged(decontamination.find(spark.createDataFrame(before, COLUMNS), spark.read.parquet(f"{folder}/benchmark.parquet"))).filter("contaminated").collect()}
    assert found and sorted(map(str, after)) == sorted(str(r) for r in before if r[0] not in found)
    before, after = step["mixing sources to target weights"]
    copies = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(before, COLUMNS)).collect()}
    assert Counter(r[0] for r in after) == Counter({r[0]: copies[r[0]] for r in before if copies[r[0]] and (r[1] or "").split()})
    before, after = step["sharding"]
    assert Counter(r[0] for r in after) == Counter(r[0] for r in before)
    again = {tuple(r) for r in corpus_pipeline.run(spark, folder).collect()}
    assert again == set(after)


def test_empty_tables(spark, folder):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


def test_extra_columns_stay(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 as spans", "array(2) as copies", "struct(3 as x) as size", "'k' as node")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns[5:] == ["spans", "copies", "size", "node"]
    assert corpus_pipeline.shards(spark, docs, folder).count() == docs.count()
    assert ngram_join.BLOCK
