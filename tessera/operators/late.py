"""Late interaction: many vectors a document, kept as cells and residual codes; candidates by cell, exact sums of best products last.

Every vector of a document goes to the cell of its nearest centroid and is stored as that centroid's number and one byte a dimension
for what is left. A query's vectors look into their nearest cells; the documents found there get an approximate sum from the codes,
and the best of them the exact one, from their own vectors.

Defined cases: null vectors and documents without vectors are never found; a query without vectors has no hits (search.fused() takes
its words or its one vector instead); equal sums go by the least id.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import vector
from tessera.operators import index, pairs
from tessera.operators.search import parts, top

#: Documents that are summed exactly for each that is asked for; documents and queries whose sums are held at once.
OVERSAMPLE, TILE = 8, (8192, 1024)
#: Documents and queries of one product where all pairs are wanted, and pairs that are handed on together.
PAIRED = 2048, 512, 50_000


@dataclass(frozen=True)
class Cells:
    """Unit centroids, the greatest residual of any dimension, and how many cells a query vector looks into."""

    centroids: np.ndarray
    reach: float
    probes: int

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = (x @ self.centroids.T).argmax(1)
        return cell, np.clip(np.rint((x - self.centroids[cell]) / self.reach * 127), -127, 127).astype(np.int8)

    def decode(self, cell: np.ndarray, code: np.ndarray) -> np.ndarray:
        return self.centroids[cell] + code.astype(np.float32) * (self.reach / 127)


def vectors(docs: DataFrame, key: str) -> DataFrame:
    """key, at, v of every vector of docs (key, vectors)."""
    return docs.select(key, F.posexplode("vectors").alias("at", "v")).filter("v IS NOT NULL")


def fit(docs: DataFrame, key: str = "point_id", cells: int | None = None, probes: int = 4, sample: int = index.SAMPLE) -> Cells:
    """Centroids of at most sample vectors, those of the least hashes; as many as the root of their number."""
    rows = vectors(docs, key).orderBy(F.xxhash64(key, "at"), key, "at").limit(sample).select("v").collect()
    if not rows:
        return Cells(np.zeros((1, 1), np.float32), 1.0, 1)
    x = np.array([r.v for r in rows], np.float32)
    c = index.centroids(x, cells or max(1, int(len(x) ** 0.5)))
    near = (x @ c.T).argmax(1)
    return Cells(c, float(np.abs(x - c[near]).max()) or 1.0, min(probes, len(c)))


def coded(docs: DataFrame, cells: Cells, key: str = "point_id") -> DataFrame:
    """key, at, cell, code of every vector: the table of the store."""
    held = docs.sparkSession.sparkContext.broadcast(cells)

    def encode(column: pd.Series) -> pd.DataFrame:
        if not len(column):
            return pd.DataFrame({"cell": pd.Series([], dtype="int32"), "code": pd.Series([], dtype=object)})
        cell, code = held.value.encode(np.stack([np.asarray(v, np.float32) for v in column]))
        return pd.DataFrame({"cell": cell.astype(np.int32), "code": [r.tobytes() for r in code]})

    encode.__annotations__ = {"column": pd.Series, "return": pd.DataFrame}
    return vectors(docs, key).select(key, "at", F.pandas_udf(encode, "cell int, code binary")("v").alias("c")).select(key, "at", "c.cell", "c.code")


@dataclass
class Asked:
    """A block of queries: their ids, their vectors, and by the place of a vector in its query those that look into each cell."""

    ids: pa.Array
    vectors: np.ndarray
    lookers: list[list[tuple[np.ndarray, np.ndarray]]]

    @classmethod
    def of(cls, ids: pa.Array, vectors: list, cells: Cells) -> Asked:
        own = [[v for v in q or [] if v is not None] for q in vectors]
        x = np.array([v for q in own for v in q], np.float32).reshape(-1, cells.centroids.shape[1])
        query, place = np.repeat(np.arange(len(own)), [len(q) for q in own]), np.array([i for q in own for i in range(len(q))], np.int64)
        looked = np.argsort(-(x @ cells.centroids.T), axis=1, kind="stable")[:, : cells.probes]
        lookers = []
        for i in range(int(place.max(initial=-1)) + 1):
            at = np.flatnonzero(place == i)
            cell, at = looked[at].ravel(), np.repeat(at, looked.shape[1])
            order = np.argsort(cell, kind="stable")
            at = np.split(at[order], np.searchsorted(cell[order], np.arange(1, len(cells.centroids))))
            lookers.append([(query[a], a) for a in at])
        return cls(ids, x.astype(np.float64), lookers)

    def sums(self, x: np.ndarray, cell: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
        """For each query and document the sum of best products; -inf where they meet in no cell. Products are rounded, so that equal
        documents have equal sums whatever they are multiplied with."""
        order = np.lexsort((doc, cell))
        first = np.append(True, (cell[order][1:] != cell[order][:-1]) | (doc[order][1:] != doc[order][:-1])) if len(order) else np.zeros(0, bool)
        nth = np.arange(len(order)) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(order) else np.zeros(0, np.int64)
        order = order[np.lexsort((cell[order], nth))]  # of a document's vectors in one cell, one at a time
        nth = np.sort(nth)
        bounds = np.append(np.flatnonzero(np.append(True, (cell[order][1:] != cell[order][:-1]) | (nth[1:] != nth[:-1]))), len(order)) if len(order) else np.zeros(1, np.int64)
        total, met = np.zeros((len(self.ids), docs), np.float32), np.zeros((len(self.ids), docs), bool)
        for lookers in self.lookers:
            best = np.full(total.shape, -np.inf, np.float32)
            for a, b in itertools.pairwise(bounds.tolist()):
                own = order[a:b]
                query, at = lookers[cell[own[0]]]
                if len(query):
                    here = np.ix_(query, doc[own])
                    best[here] = np.maximum(best[here], np.rint(self.vectors[at] @ x[own].T * 2.0**20) / 2.0**20)
            hit = best > -np.inf
            np.add(total, best, out=total, where=hit)
            met |= hit
        total[~met] = -np.inf
        return total


def _scan(batches: Iterator[pa.RecordBatch], asked: list[Asked], cells: Cells, most: int) -> Iterator[pa.RecordBatch]:
    """The best documents of a task (id, parts: cell and code of each vector) for each query, by codes."""
    best = None
    for batch in batches:
        batch = batch.take(pc.sort_indices(batch.column(0), null_placement="at_start"))
        best = best or [pairs.Best(len(a.ids), most, batch.schema.types[0]) for a in asked]
        for part in (batch.slice(b, TILE[0]) for b in range(0, batch.num_rows, TILE[0])):
            ids, flat = part.column(0), part.column(1).flatten()
            cell, code = pc.struct_field(flat, "cell").to_numpy(), pc.struct_field(flat, "code").to_pylist()
            x = cells.decode(cell, np.frombuffer(b"".join(code), np.int8).reshape(len(cell), -1)).astype(np.float64)
            doc = np.repeat(np.arange(len(ids)), pc.list_value_length(part.column(1)).to_numpy())
            for a, held in zip(asked, best, strict=True):
                s = a.sums(x, cell, doc, len(ids))
                q, d = held.worth(s, ids)
                if len(q):
                    held.add(q, s[q, d], s[q, d], d, ids.take(pa.array(d)))
    for a, held in zip(asked, best or (), strict=bool(best)):
        yield pa.RecordBatch.from_arrays([a.ids.take(pa.array(held.q)), held.ids, pa.array(held.score)], ["query_id", "id", "score"])


def candidates(store: DataFrame, queries: DataFrame, cells: Cells, most: int, key: str = "point_id") -> DataFrame:
    """query_id, key, score: the best so many documents of each query (query_id, vectors) by codes. A vector of the query whose cells
    hold none of a document's vectors adds nothing to that document. The queries are broadcast in blocks of a checked size; what a
    vector meets in its cells is summed within the task that holds the document's vectors, which hands on so many documents a query."""
    context, out = store.sparkSession.sparkContext, None
    docs = store.groupBy(key).agg(F.collect_list(F.struct("cell", "code")).alias("parts"))
    schema = T.StructType([queries.schema["query_id"], T.StructField("id", store.schema[key].dataType), T.StructField("score", T.DoubleType())])
    values = F.aggregate("vectors", F.lit(0).cast("long"), lambda s, v: s + F.coalesce(F.size(v), F.lit(0)) + 8)
    for part in parts(queries.select("query_id", "vectors").filter(F.size("vectors") > 0), values):
        ids, own = part.column("query_id").combine_chunks(), part.column("vectors").to_pylist()
        held = context.broadcast((cells, [Asked.of(ids.slice(b, TILE[1]), own[b : b + TILE[1]], cells) for b in range(0, len(own), TILE[1])]))

        def scan(batches, held=held):
            return _scan(batches, held.value[1], held.value[0], most)

        found = docs.mapInArrow(scan, schema)
        out = found if out is None else out.unionByName(found)
    return top(out.withColumnRenamed("id", "point_id"), most).withColumnRenamed("point_id", key)


@dataclass
class Stacked:
    """Lists of vectors, those with most first: which list each is, and of every place the vectors of the lists that reach so far."""

    order: np.ndarray
    places: list[np.ndarray]
    lengths: list[np.ndarray]

    @classmethod
    def of(cls, column: pa.Array) -> Stacked:
        x, length = pairs.matrix(column.flatten())
        own = np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(column), 0).to_numpy())
        x, length, own = x[length >= 0], length[length >= 0], own[length >= 0]
        many = np.bincount(own, minlength=len(column))
        order = np.argsort(-many, kind="stable")
        at = np.argsort(np.argsort(order)[own], kind="stable")  # vectors by the new order of their lists
        ends = np.cumsum(many[order])
        place = np.arange(len(at)) - np.repeat(ends - many[order], many[order])
        by = [at[place == i] for i in range(int(many.max(initial=0)))]
        return cls(order, [x[i] for i in by], [length[i] for i in by])

    def greatest(self) -> float:
        return max((float(pairs.squares(x).max(initial=0.0)) for x in self.places), default=0.0) ** 0.5


def _products(q: np.ndarray, d: np.ndarray, q_length: np.ndarray, d_length: np.ndarray) -> np.ndarray:
    wide = min(q.shape[1], d.shape[1])
    s = q[:, :wide] @ d[:, :wide].T
    if len(q) and len(d) and not (q_length.min() == d_length.max() and q_length.max() == d_length.min()):
        s[q_length[:, None] != d_length] = -np.inf
    return s


def _sums(q: Stacked, some: slice, d: Stacked) -> np.ndarray:
    """Sums of best products of some lists with others, as they are ordered; NaN where no vector has a product."""
    out = np.zeros((len(q.order[some]), len(d.order)))
    met = np.zeros(out.shape, bool)
    for x, length in zip(q.places, q.lengths, strict=True):
        x, length = x[some], length[some]
        best = np.full((len(x), out.shape[1]), -np.inf)
        for y, other in zip(d.places, d.lengths, strict=True):
            np.maximum(best[:, : len(y)], _products(x, y, length, other), out=best[:, : len(y)])
        hit = best > -np.inf
        np.add(out[: len(x)], best, out=out[: len(x)], where=hit)
        met[: len(x)] |= hit
    out[~met] = np.nan
    return out


def _in_order(q: Stacked, a: np.ndarray, d: Stacked, b: np.ndarray) -> np.ndarray:
    """Sums of pairs of lists, every product in the order of the dimensions."""
    out = np.zeros(len(a))
    for x, length in zip(q.places, q.lengths, strict=True):
        best = np.full(len(a), -np.inf)
        for y, other in zip(d.places, d.lengths, strict=True):
            at = np.flatnonzero((a < len(x)) & (b < len(y)))
            at = at[length[a[at]] == other[b[at]]]
            dot = np.zeros(len(at))
            for j in range(min(x.shape[1], y.shape[1])):
                dot += x[a[at], j] * y[b[at], j]
            best[at] = np.maximum(best[at], dot)
        out += np.where(np.isneginf(best), 0.0, best)
    return out


def _all(batches: Iterator[pa.RecordBatch], ids: pa.Array, q: Stacked, digits: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Every pair of a query and a document (id, vectors) with its rounded sum. What lies so near to a half that the order of the
    products could tell is summed again in the order of the dimensions."""
    most, places = q.greatest(), len(q.places)
    for batch in batches:
        for part in (batch.slice(b, PAIRED[0]) for b in range(0, batch.num_rows, PAIRED[0])):
            d = Stacked.of(part.column(1))
            docs = part.column(0).take(pa.array(d.order))
            wide = 10.0**digits * 4e-16 * places * max((x.shape[1] for x in q.places), default=0) * most * d.greatest() + 1e-7
            for b in range(0, len(q.order), PAIRED[1]):
                some = slice(b, b + PAIRED[1])
                s = _sums(q, some, d)
                big = s * 10.0**digits
                near = np.nonzero(np.abs(big - np.floor(big) - 0.5) < wide)
                s = np.rint(big) / 10.0**digits + 0.0
                if len(near[0]):
                    s[near] = pairs.rounded(_in_order(q, near[0] + b, d, near[1]), digits)
                step = max(1, PAIRED[2] // max(1, len(docs)))
                for r in range(0, len(s), step):
                    own = s[r : r + step]
                    left = ids.take(pa.array(np.repeat(q.order[some][r : r + step], len(docs))))
                    right = docs.take(pa.array(np.tile(np.arange(len(docs)), len(own))))
                    yield pa.RecordBatch.from_arrays([left, right, pa.array(own.ravel(), mask=np.isnan(own).ravel())], names)


def all_sums(docs: DataFrame, queries: DataFrame, digits: int) -> DataFrame:
    """query_id, doc_id, score of every pair of a stated set of queries (query_id, vectors) and documents (doc_id, vectors): for each
    vector of the query its best product with one of the document, summed and rounded. Null vectors have none; a pair without any
    product has a null score. The queries are broadcast in blocks of a checked size; the documents are multiplied batch by batch."""
    context, out, names = docs.sparkSession.sparkContext, None, ["query_id", "doc_id", "score"]
    schema = T.StructType([queries.schema["query_id"], docs.schema["doc_id"], T.StructField("score", T.DoubleType())])
    values = F.aggregate("vectors", F.lit(0).cast("long"), lambda s, v: s + F.coalesce(F.size(v), F.lit(0)) + 8)
    for part in parts(queries.select("query_id", "vectors"), values):
        held = context.broadcast((part.column("query_id").combine_chunks(), Stacked.of(part.column("vectors").combine_chunks())))

        def scan(batches, held=held):
            return _all(batches, *held.value, digits, names)

        found = docs.select("doc_id", "vectors").mapInArrow(scan, schema)
        out = found if out is None else out.unionByName(found)
    return out


def rerank(found: DataFrame, docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, point_id, score, rank of found pairs (query_id, point_id) by the exact sum of best products."""
    d, q = docs.select("point_id", F.col("vectors").alias("_d")), queries.select("query_id", F.col("vectors").alias("_v"))
    has = lambda c: F.col(c).isNotNull() & (F.size(c) > 0)
    pairs = found.select("query_id", "point_id").join(q.filter(has("_v")), "query_id").join(d.filter(has("_d")), "point_id")
    return top(pairs.select("query_id", "point_id", vector.max_sim(F.col("_v"), F.col("_d")).alias("score")), k)


def search(store: DataFrame, docs: DataFrame, queries: DataFrame, cells: Cells, k: int = 10, oversample: int = OVERSAMPLE) -> DataFrame:
    """The k best documents (point_id, vectors) of each query: proposed by the store's codes, summed exactly."""
    return rerank(candidates(store, queries, cells, k * oversample), docs, queries, k)
