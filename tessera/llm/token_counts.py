"""Token counts through a digest cache.

The cache is a table keyed by a digest of the content and, as its folder, a digest of the tokenizer's file and library version. Texts
are joined to it by digest alone; the distinct texts that it misses are encoded once and appended.

Content is normalised as far as the count allows: null becomes empty. Any other change could change the count.

Encoding splits a text where no token can span: before a space that follows a non-space and precedes a letter, as byte-level
pre-tokenisation always breaks there. Each distinct piece of a task's texts goes through the library once, so counts are the library's.

Defined cases: a null text counts as empty, 0 tokens; equal texts are encoded once; very long texts are counted whole, piece by piece; repeated and null doc_ids are documents like any
other; an empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.columns import exists, narrow, shared_dir

#: Pieces that one task remembers.
REMEMBERED = 400_000

#: Between a non-space and a letter of ASCII or Latin-1. Python's white space includes all that the tokenizer's pattern knows.
_BREAK = re.compile("(?<=\\S) (?=[A-Za-zÀ-ÖØ-öø-ÿ])")


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def tokenizer_version(path: str) -> str:
    """A digest of the vocabulary file and the library that reads it."""
    import tokenizers

    return hashlib.sha256(Path(path).read_bytes() + tokenizers.__version__.encode()).hexdigest()[:32]


@lru_cache(2)
def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts of texts, remembering pieces."""
    tokenizer, known = _load(path), {}

    def count(texts: list[str]) -> list[int]:
        pieces = []
        for t in texts:
            first, *rest = _BREAK.split(t)
            c = Counter(rest)  # each lost the space it began with
            pieces.append((first, c))
        missing = {" " + p for _, c in pieces for p in c if " " + p not in known} | {f for f, _ in pieces if f not in known}
        if len(known) + len(missing) > REMEMBERED:
            known.clear()
            missing = {" " + p for _, c in pieces for p in c} | {f for f, _ in pieces}
        order = list(missing)
        for i in range(0, len(order), 10_000):
            part = order[i : i + 10_000]
            known.update(zip(part, (len(e) for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True))
        return [known[f] + sum(known[" " + p] * n for p, n in c.items()) for f, c in pieces]

    return count


def count(docs: DataFrame, tokenizer: str | None = None, cache: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, digest, for each document. cache: the table's folder; a fresh one in the shared folder by default."""
    spark = docs.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    path = f"{cache or shared_dir(spark, 'token-counts')}/tokenizer={tokenizer_version(tokenizer)}"
    body = F.coalesce(F.col("text"), F.lit(""))
    keyed = narrow(docs, "doc_id", "text").select(F.col("doc_id"), body.alias("text"), F.unhex(F.sha2(F.encode(body, "UTF-8"), 256)).alias("digest"), F.octet_length(body).cast("long").alias("n_bytes"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("row"))
    distinct = keyed.groupBy("digest").agg(F.min("row").alias("row"))
    schema = "digest binary, n_tokens long"
    if exists(spark, path):
        distinct = distinct.join(spark.read.schema(schema).parquet(path), "digest", "left_anti")
    texts = keyed.select("digest", "row", "text").join(distinct, ["digest", "row"], "left_semi").select("digest", "text")

    def encode(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, last = counter(tokenizer), None
        for batch in iterator:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                digests = part.column(0).to_pylist()  # rows that repeat both doc_id and text stand together
                part = part.filter(pa.array([a != b for a, b in zip(digests, [last, *digests], strict=False)]))
                last = digests[-1]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts(part.column(1).to_pylist()), pa.int64())], ["digest", "n_tokens"])

    texts.mapInArrow(encode, schema).write.mode("append").parquet(path)
    cached = spark.read.schema(schema).parquet(path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # retried appends may repeat
    return keyed.select("doc_id", "n_bytes", "digest").join(cached, "digest").select("doc_id", "n_bytes", "n_tokens", F.lower(F.hex("digest")).alias("digest"))
