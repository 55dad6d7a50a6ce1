"""A lexical index with the greatest impact of every block, so that a search reads only the blocks that can still hold a hit.

Documents are dealt into blocks; for every term and block there is one row with the documents that hold the term, what each gains by
it (its part of BM25 without the term's rarity), and the greatest of these. A search first adds up those greatest values: no document
of a block can score more than that. The blocks that promise most are scored; the k-th best score found is what a block must reach to
be looked into at all, and all others are left out, which loses nothing. Both rounds are joins; no list of a term's documents is ever
longer than a block.

The two rounds make a row for each query and block, so they are for few queries. Many queries are scored together: every task holds the
postings of some groups of blocks, adds up for each query what its terms gain, and keeps the k best; a query leaves out the groups that
cannot reach its k-th best in the task.

Defined cases: null and empty texts hold no terms, count among the documents and shorten the average; a term is asked for once,
however often a query says it; a query without a known term has no hits; equal scores go by the least id.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.operators import pairs
from tessera.operators.search import parts, tokens, top
from tessera.sources.shared import cut

#: Documents of a block, about, and the blocks of a query that are scored first.
BLOCK, FIRST = 16, 32
#: Scores that differ by less are taken as equal when blocks are left out.
CLOSE = 1e-9
#: Most queries that take the two rounds; blocks of a group, queries and sums that are held at once where more are scored together.
FEW, GROUP, TOGETHER, SUMS = 32, 128, 1024, 2_000_000
#: Terms of at most this rarity (about one document of 16 holds them) are added to whole lines of documents.
FREQUENT = 2.77


@dataclass(frozen=True)
class Index:
    """postings: term, block, top, entries (id, gain); terms: term, df, rarity; whole, until it is stored: the number of documents."""

    postings: DataFrame
    terms: DataFrame
    whole: DataFrame | None = None


def build(docs: DataFrame, k1: float = 1.2, b: float = 0.75, block: int = BLOCK) -> Index:
    """The index of docs (point_id, content)."""
    d = docs.select("point_id", F.coalesce("content", F.lit("")).alias("_c")).withColumn("_n", F.size(tokens(F.col("_c"))))
    # documents of like length gain alike, so a block's greatest gain tells much: blocks are runs of lengths
    before = F.coalesce(F.sum("_same").over(Window.orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lengths = d.groupBy("_n").agg(F.count(F.lit(1)).alias("_same")).withColumn("_before", before)  # a row for each length, not document
    whole = lengths.agg(F.sum("_same").alias("_docs"), (F.sum(F.col("_n") * F.col("_same")) / F.sum("_same")).alias("_mean"))
    place = F.floor((F.col("_before") + F.pmod(F.xxhash64("point_id"), F.col("_same"))) / block)
    # whole texts are dealt by block once; terms are counted and put together where they are
    dealt = d.join(F.broadcast(lengths), "_n").select("point_id", "_c", "_n", place.alias("block")).repartition("block")
    tf = dealt.select("point_id", "_n", "block", F.explode(tokens(F.col("_c"))).alias("term")).groupBy("point_id", "_n", "block", "term").agg(F.count(F.lit(1)).alias("_tf"))
    gain = F.col("_tf") * (k1 + 1) / (F.col("_tf") + k1 * (1 - b + b * F.col("_n") / F.col("_mean")))
    entries = tf.crossJoin(F.broadcast(whole)).select("term", "block", F.struct("point_id", gain.alias("gain")).alias("e"))
    postings = entries.groupBy("term", "block").agg(F.max("e.gain").alias("top"), F.collect_list("e").alias("entries"))
    return Index(postings, _terms(postings, whole), whole)


def _terms(postings: DataFrame, whole: DataFrame) -> DataFrame:
    """term, df, rarity."""
    df = postings.groupBy("term").agg(F.sum(F.size("entries")).alias("df"))
    rarity = F.log((F.col("_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return df.crossJoin(F.broadcast(whole)).select("term", "df", rarity.alias("rarity"))


def store(index: Index, path: str) -> None:
    """Postings are written where they were made, without another shuffle, in order of their terms; terms are counted from what was
    written."""
    index.postings.sortWithinPartitions("term", "block").write.parquet(f"{path}/postings")
    written = index.postings.sparkSession.read.parquet(f"{path}/postings")
    (index.terms if index.whole is None else _terms(written, index.whole)).write.parquet(f"{path}/terms")


def load(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms"))


def _asked(index: Index, queries: DataFrame) -> DataFrame:
    terms = queries.select("query_id", F.explode(F.array_distinct(tokens(F.coalesce("text", F.lit(""))))).alias("term"))
    return terms.join(index.terms.select("term", "rarity"), "term")


def bounds(index: Index, queries: DataFrame) -> DataFrame:
    """query_id, block, bound, size: the most that a document of the block can score; postings themselves are not read."""
    met = index.postings.select("term", "block", "top").join(_asked(index, queries), "term")
    return met.groupBy("query_id", "block").agg(F.sum(F.col("rarity") * F.col("top")).alias("bound"))


def _scored(index: Index, asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """query_id, point_id, score of all documents of some blocks (query_id, block)."""
    wanted = asked.join(blocks, "query_id")
    met = index.postings.select("term", "block", "entries").join(wanted, ["term", "block"])
    return met.select("query_id", "rarity", F.explode("entries").alias("e")).groupBy("query_id", "e.point_id").agg(F.sum(F.col("rarity") * F.col("e.gain")).alias("score"))


def rounds(index: Index, queries: DataFrame, k: int, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
    """The blocks (query_id, block) of the first and of the second round."""
    # a row for each query and block, read by both rounds
    ranked = cut(bounds(index, queries), "block-bounds").withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "block")))
    begin = ranked.filter(F.col("_r") <= first).select("query_id", "block")
    reached = top(_scored(index, _asked(index, queries), begin), k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("_least"))
    more = ranked.filter(F.col("_r") > first).join(reached, "query_id", "left").filter(F.col("_least").isNull() | (F.col("bound") >= F.col("_least") - CLOSE))
    return begin, more.select("query_id", "block")


def search(index: Index, queries: DataFrame, k: int = 10, first: int = FIRST, digits: int | None = None) -> DataFrame:
    """query_id, point_id, score, rank of the k best documents of each query (query_id, text), exactly. digits: scores are rounded
    before they are ranked. Few queries take the two rounds, more are scored together, by groups of blocks."""
    if queries.limit(FEW + 1).count() <= FEW:
        begin, more = rounds(index, queries, k, first)
        found = _scored(index, _asked(index, queries), begin.unionByName(more))
        return top(found if digits is None else found.withColumn("score", F.round("score", digits)), k)
    return top(_together(index, queries, k, digits), k)


def _together(index: Index, queries: DataFrame, k: int, digits: int | None) -> DataFrame:
    """query_id, point_id, score: for each query the k best documents of each task. The terms of the queries are broadcast in parts of a
    checked size; the postings of these terms are dealt to tasks by groups of blocks, and nothing is made for a query and a document."""
    context, out = queries.sparkSession.sparkContext, None
    asked = _asked(index, queries)
    schema = T.StructType([queries.schema["query_id"], T.StructField("point_id", index.postings.schema["entries"].dataType.elementType["point_id"].dataType), T.StructField("score", T.DoubleType())])
    postings = index.postings.select(F.floor(F.col("block") / GROUP).alias("group"), "term", "top", "entries")
    for part in parts(asked, F.lit(2)):  # a term and its rarity
        held = context.broadcast(Asked.of(part))
        terms = queries.sparkSession.createDataFrame(pa.table({"term": held.value.terms}), "term string")
        wanted = postings.join(F.broadcast(terms), "term", "left_semi").repartition("group").sortWithinPartitions("group")

        def scan(batches, held=held):
            return _scan(batches, held.value, k, digits)

        found = wanted.select("group", "term", "top", "entries").mapInArrow(scan, schema)
        out = found if out is None else out.unionByName(found)
    return out


@dataclass
class Asked:
    """Queries: their ids; the terms in order and how rare each is; and the pairs of a query and a term, by query and by term."""

    ids: pa.Array
    terms: pa.Array
    rarity: np.ndarray
    query: np.ndarray
    term: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Asked:
        names, words = table.column("query_id").combine_chunks(), table.column("term").combine_chunks()
        ids, terms = names.unique(), words.unique().sort()
        query, term = pc.index_in(names, value_set=ids).to_numpy().astype(np.int64), pc.index_in(words, value_set=terms).to_numpy().astype(np.int64)
        rarity = np.zeros(len(terms))
        rarity[term] = table.column("rarity").to_numpy()
        order = np.lexsort((term, query))
        return cls(ids, terms, rarity, query[order], term[order])

    def scores(self, some: np.ndarray, term: np.ndarray, doc: np.ndarray, gain: np.ndarray, docs: int) -> np.ndarray:
        """Of some queries and every document of a group, from entries in order of their terms; 0 where they share no term. Frequent
        terms are added up first, then the others, both in order, so that equal documents have equal scores in any group."""
        row = np.full(len(self.ids), -1)
        row[some] = np.arange(len(some))
        near = np.flatnonzero(row[self.query] >= 0)
        near = near[np.argsort(self.term[near], kind="stable")]
        rows, starts = row[self.query[near]], np.searchsorted(self.term[near], np.arange(len(self.terms) + 1))
        out, gain, frequent = np.zeros((len(some), docs)), gain * self.rarity[term], self.rarity[term] <= FREQUENT
        at = np.flatnonzero(frequent)
        for own in np.split(at, np.flatnonzero(np.diff(term[at])) + 1) if len(at) else []:
            t, line = term[own[0]], np.zeros(docs)
            line[doc[own]] = gain[own]
            for r in rows[starts[t] : starts[t + 1]].tolist():
                out[r] += line
        at = np.flatnonzero(~frequent)
        many = starts[term[at] + 1] - starts[term[at]]
        at, many = at[many > 0], many[many > 0]
        ends = np.cumsum(many)
        flat = out.reshape(-1)
        cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, int(ends[-1]), SUMS)), len(at))) if len(at) else []
        for a, b in itertools.pairwise(cuts):
            n, e = many[a:b], at[a:b]
            pair = np.repeat(starts[term[e]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            np.add.at(flat, rows[pair] * docs + np.repeat(doc[e], n), np.repeat(gain[e], n))
        return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The postings of one group after another."""
    held, last = [], None
    for batch in batches:
        own = batch.column("group").to_numpy()
        bounds = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
        for a, b in itertools.pairwise(bounds):
            if a < b:
                if held and own[a] != last:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held = []
                held.append(batch.slice(a, b - a))
                last = own[a]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _scan(batches: Iterator[pa.RecordBatch], asked: Asked, k: int, digits: int | None) -> Iterator[pa.RecordBatch]:
    """The k best documents of a task for each query. A query leaves out the groups whose greatest gains do not reach its k-th best."""
    blocks = [np.arange(b, min(b + TOGETHER, len(asked.ids))) for b in range(0, len(asked.ids), TOGETHER)]
    best, wide = None, CLOSE + (0.0 if digits is None else 10.0**-digits)
    for group in _groups(batches):
        entries = group.column("entries").combine_chunks()
        names = pc.struct_field(entries.flatten(), "point_id")
        ids = names.unique()
        ids = ids.take(pc.sort_indices(ids, null_placement="at_start"))
        own = pc.index_in(group.column("term").combine_chunks(), value_set=asked.terms).to_numpy().astype(np.int64)
        term = np.repeat(own, pc.list_value_length(entries).to_numpy())
        order = np.argsort(term, kind="stable")
        doc, gain = pc.index_in(names, value_set=ids).to_numpy().astype(np.int64), pc.struct_field(entries.flatten(), "gain").to_numpy()
        term, doc, gain = term[order], doc[order], gain[order]
        most = np.zeros(len(asked.terms))
        np.maximum.at(most, own, group.column("top").to_numpy())
        bound = np.bincount(asked.query, most[asked.term] * asked.rarity[asked.term], len(asked.ids))
        best = best or [pairs.Best(len(p), k, ids.type) for p in blocks]
        for p, held in zip(blocks, best, strict=True):
            some = np.flatnonzero((bound[p] > 0) & (bound[p] >= held.least - wide))
            if not len(some):
                continue
            s = asked.scores(p[some], term, doc, gain, len(ids))
            least = held.least[some]
            if s.shape[1] > k and np.isneginf(least).any():
                least = np.maximum(least, np.partition(s, -k, axis=1)[:, -k])
            s[(s < (least - wide)[:, None]) | (s == 0)] = -np.inf
            if digits is not None:
                at = np.nonzero(s > -np.inf)
                s[at] = pairs.rounded(s[at], digits)
            q, d = held.worth(s, ids, some)
            if len(q):
                held.add(some[q], s[q, d], s[q, d], d, ids.take(pa.array(d)))
    for p, held in zip(blocks, best or (), strict=bool(best)):
        yield pa.RecordBatch.from_arrays([asked.ids.take(pa.array(p[held.q])), held.ids, pa.array(held.score)], ["query_id", "point_id", "score"])


def share_read(index: Index, queries: DataFrame, k: int = 10, first: int = FIRST) -> DataFrame:
    """share: of the postings of the terms that are asked for, how many stand in blocks that are looked into."""
    begin, more = rounds(index, queries, k, first)
    asked = _asked(index, queries).select("query_id", "term")
    sizes = index.postings.select("term", "block", F.size("entries").alias("_n")).join(asked, "term")
    read = begin.unionByName(more).withColumn("_in", F.lit(1))
    return sizes.join(read, ["query_id", "block"], "left").agg((F.sum(F.when(F.col("_in") == 1, F.col("_n")).otherwise(0)) / F.sum("_n")).alias("share"))
