from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.llm import token_counts


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_counts.default_tokenizer())
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


ODD = ["a  b", " a", "a ", "it's  we'll<|endoftext|> x", "<|endoftext|>", "x <|endoftext|> y", "a  b", "\x1c a", "tab\t a\n b", "日本 語 é à", "1 2 3a b", "a ​ b", "!!! a ... b", "\x85 a", "ab ́c", "x  \n  y"]


def test_equals_the_library(docs, documents, reference):
    got = {r.doc_id: r for r in token_counts.count(docs.withColumn("digest", F.lit("clash")).withColumn("n_tokens", F.lit(1))).collect()}
    assert len(got) == len(documents)
    assert all(got[i].n_tokens == reference(t) and got[i].n_bytes == len((t or "").encode()) for i, t, *_ in documents)


def test_odd_texts(reference):
    assert token_counts.counter(token_counts.default_tokenizer())(ODD) == [reference(t) for t in ODD]


def test_cache_grows_by_misses(spark, tmp_path, reference):
    cache, path = str(tmp_path / "cache"), token_counts.default_tokenizer()
    table = lambda: spark.read.parquet(f"{cache}/tokenizer={token_counts.tokenizer_version(path)}")
    one = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, None)], "doc_id long, text string")
    assert token_counts.count(one, cache=cache).count() == 4 and table().count() == 3
    two = one.unionByName(spark.createDataFrame([(3, "new text")], one.schema))
    got = token_counts.count(two, cache=cache).collect()
    assert table().count() == 4 and next(r for r in got if r.doc_id == 3).n_tokens == reference("new text")


def test_empty(empty):
    assert token_counts.count(empty).count() == 0
