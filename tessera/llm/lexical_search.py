"""Ranked lexical search by sort-based accumulation: the best documents for each of a set of items.

Texts and items are cut into runs of letters, digits and non-ASCII characters, A-Z read as a-z. The items are a stated set of queries;
they are broadcast in blocks of a bounded number of (item, term) pairs, and the documents stream past each block twice: once to count
documents, terms and document frequencies, once to score. In the second pass a slice of documents gives arrays of (document, term,
count); these meet the items that hold each term, which gives concatenated arrays of item, document and impact. Packed keys
(item, document) are sorted by radix, 16 bits at a time, and np.add.reduceat sums the impacts of equal keys. A document is always
whole within one task, so no sum crosses tasks. Each task keeps the best k of each item in a heap; what the tasks keep is written,
dealt by ranges of (item, score, document), cut to k within each range, and ranked.

Scores are whole numbers (see score_terms); only a term's weight is a floor of a logarithm in doubles.

Defined cases: null texts and items have no terms, and an item without terms, or whose terms no document holds with a weight above 0,
has no rows; rows of one item_id are one item whose terms add up, null item_ids among them; repeated and null doc_ids are documents
like any other, equal scores go by ascending doc_id, null last; very long texts are cut like any other, in slices of their own, and
their impacts are accumulated in bounded runs; an empty table on either side gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.columns import cut, id_field, narrow
from tessera.llm.tokens import ALNUM, Words, batches, hash_runs

K = 10
#: (item, term) pairs of one block of items, about; some 60 bytes each. That bounds what is broadcast.
BLOCK_PAIRS = 500_000
#: (item, document, impact) triples that are sorted at once.
RUN = 1_000_000
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, times of every term of each item."""
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))
    return narrow(items, "item_id", "text").select("item_id", F.explode(words).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))


@dataclass(frozen=True)
class Block:
    """Some items: their terms sorted by hash, and for each term the items that hold it and how often."""

    ids: pa.Array
    hashes: np.ndarray
    data: np.ndarray
    start: np.ndarray
    first: np.ndarray
    item: np.ndarray
    times: np.ndarray

    @property
    def terms(self) -> int:
        return len(self.hashes)

    def found(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, count) of the words that are terms of this block, by document and term. Hashes only propose; bytes decide."""
        empty = np.zeros(0, np.int64)
        if not len(w.hash) or not self.terms:
            return empty, empty, empty
        term = np.minimum(np.searchsorted(self.hashes, w.hash), self.terms - 1)
        word = np.flatnonzero(self.hashes[term] == w.hash)
        term = term[word]
        size = w.end[word] - w.start[word]
        good = size == self.start[term + 1] - self.start[term]
        word, term, size = word[good], term[good], size[good]
        if not len(word):
            return empty, empty, empty
        edge = np.cumsum(size) - size
        step = np.arange(int(size.sum())) - np.repeat(edge, size)
        same = ALNUM.fold[w.data[np.repeat(w.start[word], size) + step]] == self.data[np.repeat(self.start[term], size) + step]
        good = np.logical_and.reduceat(same, edge)
        word, term = word[good], term[good]
        doc = np.searchsorted(w.bounds, word, "right") - 1
        key, _ = by_radix(doc * self.terms + term, None, w.docs * self.terms)
        at = runs(key)
        return key[at] // self.terms, key[at] % self.terms, np.diff(np.append(at, len(key)))


def block_of(rows: pa.Table) -> Block:
    """A block from item_id, term, times."""
    rows = rows.combine_chunks()
    seen: dict = {}
    item = np.array([seen.setdefault(x, len(seen)) for x in rows.column("item_id").to_pylist()], np.int64)
    words = [t.encode() for t in rows.column("term").to_pylist()]
    own = sorted(set(words))
    ends = np.cumsum([len(t) for t in own], dtype=np.int64)
    data, start = np.frombuffer(b"".join(own), np.uint8), np.concatenate([[0], ends])
    h = hash_runs(data, start[:-1], start[1:])
    if len(np.unique(h)) < len(h):
        raise ValueError("two terms of one hash")  # among 500,000 terms: a chance of 1 in 100,000,000
    by = np.argsort(h)
    place = {own[k]: n for n, k in enumerate(by.tolist())}
    term = np.array([place[t] for t in words], np.int64)
    order = np.lexsort((item, term))
    size = (start[1:] - start[:-1])[by]
    edge = np.concatenate([[0], np.cumsum(size)])
    step = np.arange(int(edge[-1])) - np.repeat(edge[:-1], size)
    first = np.searchsorted(term[order], np.arange(len(own) + 1))
    return Block(pa.array(list(seen), rows.column("item_id").type), h[by], data[np.repeat(start[:-1][by], size) + step], edge, first, item[order], np.asarray(rows.column("times"))[order].astype(np.int64))


def by_radix(key: np.ndarray, value: np.ndarray | None, limit: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Sorts keys below limit, and values with them, 16 bits at a time from the lowest; each step is a stable counting sort."""
    for shift in range(0, max(1, int(limit - 1).bit_length()), 16):
        order = np.argsort((key >> shift).astype(np.uint16), kind="stable")
        key, value = key[order], None if value is None else value[order]
    return key, value


def runs(key: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


def weights(df: np.ndarray, n: int) -> np.ndarray:
    """floor(1000 ln((2 n + 2) / (2 df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


def length_factor(length: np.ndarray, n: int, total: int) -> np.ndarray:
    """100 - 75 + 75 length n div total; in Python's integers where 64 bits might not hold the product."""
    if len(length) and 75 * int(length.max()) * n >= 1 << 62:
        return 25 + np.array([75 * x * n // total for x in length.tolist()], np.int64)
    return 25 + 75 * length * n // max(1, total)


def score_terms(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weight * (1_000_000_000 * tf // (1000 * tf + 8 * m))


class _Worse:
    """An entry of a heap whose worst comes first: lower scores, then larger doc_ids, then none."""

    __slots__ = ("score", "doc")

    def __init__(self, score: int, doc) -> None:
        self.score, self.doc = score, doc

    def __lt__(self, other: _Worse) -> bool:
        if self.score != other.score:
            return self.score < other.score
        return other.doc is not None and (self.doc is None or self.doc > other.doc)


class Best:
    """The k best documents of each item so far."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.heaps, self.least = k, [[] for _ in range(items)], np.ones(items, np.int64)

    def add(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray, ids: list) -> None:
        may = np.flatnonzero(score >= self.least[item])
        if not len(may):
            return
        place = np.empty(len(ids), np.int64)
        place[sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))] = np.arange(len(ids))
        may = may[np.lexsort((place[doc[may]], -score[may], item[may]))]
        at = runs(item[may])
        nth = np.arange(len(may)) - np.repeat(at, np.diff(np.append(at, len(may))))
        for i in may[nth < self.k].tolist():
            heap, entry = self.heaps[item[i]], _Worse(int(score[i]), ids[doc[i]])
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
            if len(heap) == self.k:
                self.least[item[i]] = heap[0].score


def accumulate(block: Block, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, docs: int, limit: int = RUN) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(item, document, score) of a slice, in runs of whole documents of about limit triples."""
    many = block.first[term + 1] - block.first[term]
    upto = np.concatenate([[0], np.cumsum(many)])
    begins, bits = np.append(runs(doc), len(doc)), max(1, int(docs - 1).bit_length())
    i = 0
    while i < len(begins) - 1:
        j = max(i + 1, int(np.searchsorted(upto[begins], upto[begins[i]] + limit, "right")) - 1)
        a, b = begins[i], begins[j]
        n = many[a:b]
        owner = np.repeat(np.arange(a, b), n)
        place = np.arange(int(n.sum())) - np.repeat(upto[a:b] - upto[a], n) + block.first[term[owner]]
        item = block.item[place]
        key, value = by_radix((item << bits) | doc[owner], impact[owner] * block.times[place], len(block.ids) << bits)
        at = runs(key)
        if len(at):
            key = key[at]
            yield key >> bits, key & ((1 << bits) - 1), np.add.reduceat(value, at)
        i = j


def _counting(held):
    def count(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = held.value
        df, docs, words = np.zeros(block.terms, np.int64), 0, 0
        for _, w in batches(iterator, ALNUM):
            per = np.diff(w.bounds)
            docs, words = docs + int((per > 0).sum()), words + int(per.sum())
            df += np.bincount(block.found(w)[1], minlength=block.terms)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *some.tolist()], pa.int32()), pa.array([docs, words, *df[some].tolist()], pa.int64())], ["term", "n"])

    return count


def _scoring(held, weight, n: int, total: int, k: int):
    def run(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = held.value
        best, w_of = Best(len(block.ids), k), weight.value
        kind = None
        for batch, w in batches(iterator, ALNUM):
            kind = batch.column(0).type
            doc, term, tf = block.found(w)
            good = w_of[term] > 0
            doc, term, tf = doc[good], term[good], tf[good]
            m = length_factor(np.diff(w.bounds), n, total)
            impact, ids = score_terms(w_of[term], tf, m[doc]), batch.column(0).to_pylist()
            for item, d, score in accumulate(block, doc, term, impact, w.docs):
                best.add(item, d, score, ids)
        if kind is not None:
            rows = [(i, e.doc, e.score) for i, heap in enumerate(best.heaps) for e in heap]
            yield pa.RecordBatch.from_arrays(
                [block.ids.take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.int64())], ["item_id", "doc_id", "score"]
            )

    return run


def search(docs: DataFrame, items: DataFrame, k: int = K, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the k best documents of each item, of scores above 0."""
    spark, d = docs.sparkSession, narrow(docs, "doc_id", "text")
    asked = cut(item_terms(items), "item-terms")
    blocks = -(-asked.count() // block_pairs)
    schema = f"item_id {asked.schema['item_id'].dataType.simpleString()}, {id_field(docs)}, score long"
    found = spark.createDataFrame([], schema)
    for b in range(blocks):
        held = spark.sparkContext.broadcast(block_of((asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)).toArrow()))
        counted = dict(d.mapInArrow(_counting(held), "term int, n long").groupBy("term").agg(F.sum("n")).collect())  # as many rows as terms of the block
        n, total = counted.pop(-1, 0), counted.pop(-2, 0)
        df = np.zeros(held.value.terms, np.int64)
        df[list(counted)] = list(counted.values())
        weight = spark.sparkContext.broadcast(weights(df, n))
        found = found.unionByName(cut(d.mapInArrow(_scoring(held, weight, n, total, k), schema), "lexical-search"))
        held.unpersist()
        weight.unpersist()
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    ranged = found.repartitionByRange("item_id", *order)
    ranked = ranged.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
