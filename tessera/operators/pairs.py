"""Cosines of every memory with every query of a stated set, by matrix products over Arrow batches; all pairs, or the best of each query.

A product proposes: what lies within its rounding error of a query's k-th best in the task. Only that is scored, in double precision
and in the order of the dimensions, as vector.cosine() does, so equal vectors have equal scores and results do not depend on batches.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Queries that are multiplied together, and how far a product may be from the score in the order of dimensions.
TOGETHER, SLACK = 256, 1e-9
#: Bytes of vectors that are dealt to their cells together, rows and queries of one product there, and hits that are sorted in together.
GATHERED, TILE, HELD = 16 << 20, (4096, 1024), 500_000


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, shorter ones filled up with zeros, and their lengths; -1 for a null or a vector with a null in it."""
    if not len(column):
        return np.zeros((0, 0)), np.zeros(0, np.int64)
    flat = column.flatten()
    length = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    if not column.null_count and not flat.null_count and (length == length[0]).all():
        return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1), length
    out = np.zeros((len(column), max(0, int(length.max()))))
    for i, v in enumerate(column.to_pylist()):
        if v is None or None in v:
            length[i] = -1
        else:
            out[i, : len(v)] = v
    return out, length


def squares(x: np.ndarray) -> np.ndarray:
    """Squared lengths, summed in the order of the dimensions."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j] * x[:, j]
    return out


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As Spark rounds: halves of the decimal form go away from zero."""
    big = x * 10.0**digits
    out = np.rint(big) / 10.0**digits
    for i in np.flatnonzero(np.isfinite(x) & (np.abs(np.abs(big - np.trunc(big)) - 0.5) < 1e-5)):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


@dataclass
class Asked:
    """A block of queries: their columns, vectors, lengths, squares, and codes of the value that a hit must not share."""

    columns: pa.RecordBatch
    vectors: np.ndarray
    lengths: np.ndarray
    squares: np.ndarray
    codes: np.ndarray | None
    known: dict

    @classmethod
    def of(cls, table: pa.Table, vector: str, apart: str | None) -> Asked:
        x, length = matrix(table.column(vector).combine_chunks())
        rest = table.drop_columns([vector, *([apart] if apart else [])]).combine_chunks()
        known: dict = {}
        codes = np.array([-2 if v is None else known.setdefault(v, len(known)) for v in table.column(apart).to_pylist()]) if apart else None
        columns = pa.RecordBatch.from_arrays([c.combine_chunks() for c in rest.columns], rest.column_names)
        return cls(columns, x, length, squares(x), codes, known)


def _products(asked: Asked, rows: slice | np.ndarray, x: np.ndarray, length: np.ndarray, square: np.ndarray, codes: np.ndarray | None) -> np.ndarray:
    """About the cosines of some queries with a batch; -inf where there is none, NaN where the pair is left out."""
    d = min(x.shape[1], asked.vectors.shape[1])
    n = np.sqrt(asked.squares[rows, None] * square)
    with np.errstate(invalid="ignore", divide="ignore"):
        s = asked.vectors[rows, :d] @ x[:, :d].T / n
    s[n == 0] = 0.0
    q = asked.lengths[rows]
    if (q < 0).any() or (length < 0).any() or q.min() != length.max() or q.max() != length.min():
        s[((q[:, None] != length) & (n != 0)) | (q[:, None] < 0) | (length < 0)] = -np.inf
    if codes is not None:
        own = asked.codes[rows]
        s[(own[:, None] == codes) | (own[:, None] < -1) | (codes == -2)] = np.nan
    return s


def _exact(asked: Asked, q: np.ndarray, x: np.ndarray, r: np.ndarray, square: np.ndarray, about: np.ndarray) -> np.ndarray:
    """Scores of pairs (q, r), where there is one, in the order of the dimensions."""
    dot = np.zeros(len(q))
    for j in range(min(x.shape[1], asked.vectors.shape[1])):
        dot += x[r, j] * asked.vectors[q, j]
    n = np.sqrt(asked.squares[q] * square[r])
    with np.errstate(invalid="ignore", divide="ignore"):
        s = np.where(n == 0, 0.0, np.clip(dot / n, -1.0, 1.0))
    return np.where(np.isneginf(about), -np.inf, s)


class Best:
    """The best rows of a block of queries: query, key (the score as it is ranked), score, row and id."""

    def __init__(self, queries: int, k: int, kind: pa.DataType) -> None:
        self.k, self.q, self.row = k, np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.key, self.score, self.ids = np.zeros(0), np.zeros(0), pa.array([], kind)
        self.least, self.last = np.full(queries, -np.inf), np.zeros(queries, np.int64)

    def worth(self, s: np.ndarray, ids: pa.Array, queries: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of scores that may be among the best: a row for each query, or each of some, a column for each of ids, which
        are in order; -inf where there is none. Equal scores count as equal here, so of those at the limit only the first are taken."""
        queries = slice(None) if queries is None else queries
        least, last = self.least[queries].astype(s.dtype), self.last[queries]
        new = np.isneginf(least)
        if s.shape[1] > self.k and new.any():
            least[new] = np.partition(s[new], -self.k, axis=1)[:, -self.k]
        above, tied = s > least[:, None], (s == least[:, None]) & ~np.isneginf(least)[:, None]
        if not ids.null_count and len(known := np.flatnonzero(tied.any(1) & ~new)):
            place = np.searchsorted(np.array(ids.to_pylist(), object), np.array(self.ids.take(pa.array(last[known])).to_pylist(), object))
            tied[known] &= np.arange(s.shape[1]) < place[:, None]
        if len(many := np.flatnonzero(tied.sum(1) > self.k)):
            tied[many] &= np.cumsum(tied[many], axis=1, dtype=np.int32) <= self.k
        return np.nonzero(above | tied)

    def take(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], seen: int, ids: pa.Array) -> None:
        """Adds queries, rows and scores of a batch; seen rows came before it."""
        if found:
            q, r, score = (np.concatenate(p) for p in zip(*found, strict=True))
            self.add(q, score, score, r + seen, ids.take(pa.array(r)))

    def add(self, q: np.ndarray, key: np.ndarray, score: np.ndarray, row: np.ndarray, ids: pa.Array) -> None:
        q, key, score, row = (np.concatenate(p) for p in ((self.q, q), (self.key, key), (self.score, score), (self.row, row)))
        ids = pa.concat_arrays([self.ids, ids])
        place = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        order = np.lexsort((place, -key, q))
        q = q[order]
        at = np.arange(len(q)) - np.searchsorted(q, q)
        keep = order[at < self.k]
        self.q, self.key, self.score, self.row, self.ids = q[at < self.k], key[keep], score[keep], row[keep], ids.take(pa.array(keep))
        full = at[at < self.k] == self.k - 1
        self.least[self.q[full]], self.last[self.q[full]] = self.key[full], np.flatnonzero(full)


def _found(rows: pa.RecordBatch, asked: Asked, at: np.ndarray, q: np.ndarray, s: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The columns of rows, those of their queries, and similarity."""
    for b in range(0, len(q), 10_000):
        part = slice(b, b + 10_000)
        left, right = rows.take(pa.array(at[part])), asked.columns.take(pa.array(q[part]))
        sim = pa.array(s[part], mask=np.isneginf(s[part]))
        yield pa.RecordBatch.from_arrays([*left.columns, *right.columns, sim], [*left.schema.names, *right.schema.names, "similarity"])


def _whole(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    whole = pa.Table.from_batches(held).combine_chunks()
    return pa.RecordBatch.from_arrays([c.combine_chunks() for c in whole.columns], whole.schema.names)


def scan(batches: Iterator[pa.RecordBatch], asked: Asked, vector: str, k: int | None, threshold: float | None, digits: int | None, apart: str | None) -> Iterator[pa.RecordBatch]:
    """The columns of each memory but its vector, those of a query, and similarity: of every pair that reaches the threshold, or of the
    k best of each query, equal ones by point_id. digits: scores are ranked as rounded."""
    held, seen, best = [], 0, None
    blocks = [slice(b, b + TOGETHER) for b in range(0, asked.columns.num_rows, TOGETHER)]
    wide = SLACK + (0.0 if digits is None else 10.0**-digits)

    for batch in batches:
        rows = batch.drop_columns([vector])
        x, length = matrix(batch.column(vector))
        if not len(x) or not blocks:
            continue
        square = squares(x)
        codes = np.array([-2 if v is None else asked.known.get(v, -1) for v in batch.column(apart).to_pylist()]) if apart else None
        ids = None if k is None else batch.column("point_id")
        if k is not None and best is None:
            best = [Best(len(range(*b.indices(asked.columns.num_rows))), k, ids.type) for b in blocks]
        for n, b in enumerate(blocks):
            s = _products(asked, b, x, length, square, codes)
            least = np.full(len(s), -np.inf if threshold is None else threshold - SLACK)
            if k is not None:
                least = np.maximum(least, best[n].least - wide)
                if s.shape[1] > k and np.isneginf(best[n].least).any():
                    least = np.maximum(least, np.partition(np.where(np.isnan(s), -np.inf, s), -k, axis=1)[:, -k] - 2 * wide)
            q, r = np.nonzero(s >= least[:, None])
            if not len(q):
                continue
            exact = _exact(asked, q + b.start, x, r, square, s[q, r])
            if threshold is not None:
                q, r, exact = (a[exact >= threshold] for a in (q, r, exact))
            if k is None:
                yield from _found(rows, asked, r, q + b.start, exact)
            elif len(q):
                best[n].add(q, exact if digits is None else rounded(exact, digits), exact, r + seen, ids.take(pa.array(r)))
        if k is not None:
            held.append(rows)
            seen += len(x)
    if best is not None:
        whole = _whole(held)
        for b, found in zip(blocks, best, strict=True):
            yield from _found(whole, asked, found.row, found.q + b.start, found.score)


def gathered(batches: Iterator[pa.RecordBatch], column: str, most: int = GATHERED) -> Iterator[pa.RecordBatch]:
    """Batches put together until a column holds so many bytes."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.column(column).nbytes
        if size >= most:
            yield _whole(held)
            held, size = [], 0
    if held:
        yield _whole(held)


def scan_cells(batches: Iterator[pa.RecordBatch], asked: Asked, lookers: Callable[[int], np.ndarray], vector: str, k: int) -> Iterator[pa.RecordBatch]:
    """As scan(), of the k best of each query among the rows (with cell) of the cells that it looks into. lookers: the queries of a cell."""
    held, seen, best = [], 0, None
    for batch in gathered(batches, vector):
        rows, ids, cell = batch.drop_columns([vector]), batch.column("point_id"), batch.column("cell").to_numpy(zero_copy_only=False)
        best = best or Best(len(asked.vectors), k, ids.type)
        x, length = matrix(batch.column(vector))
        square, order, waiting, n = squares(x), np.argsort(cell, kind="stable"), [], 0
        bounds = np.flatnonzero(np.diff(cell[order], prepend=cell[order[0]] - 1, append=cell[order[-1]] + 1))
        for a, b in itertools.pairwise(bounds.tolist()):
            queries = lookers(int(cell[order[a]]))
            for r, q in itertools.product(range(a, b, TILE[0]), range(0, len(queries), TILE[1])):
                r, q = order[r : min(b, r + TILE[0])], queries[q : q + TILE[1]]
                s = _products(asked, q, x[r], length[r], square[r], None)
                least = best.least[q] - SLACK
                if s.shape[1] > k and np.isneginf(least).any():
                    least = np.maximum(least, np.partition(s, -k, axis=1)[:, -k] - 2 * SLACK)
                i, j = np.nonzero(s >= least[:, None])
                if len(i):
                    i, j, about = q[i], r[j], s[i, j]
                    waiting.append((i, j, _exact(asked, i, x, j, square, about)))
                    n += len(i)
                if n >= HELD:
                    best.take(waiting, seen, ids)
                    waiting, n = [], 0
        best.take(waiting, seen, ids)
        held.append(rows)
        seen += len(x)
    if best is not None:
        yield from _found(_whole(held), asked, best.row, best.q, best.score)


def most_similar(left: pa.Table, right: pa.Table, least: float) -> pa.Table:
    """point_id, existing_id, similarity of the most similar row of right with another point_id, for rows of left that have one within
    the bound; of equal ones the greatest id."""
    left, right = left.select(["point_id", "embedding"]).combine_chunks(), right.select(["point_id", "embedding"]).combine_chunks()
    mine, theirs = (t.column("point_id").combine_chunks() for t in (left, right))
    at, of, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    if len(mine) and len(theirs):
        asked = Asked.of(left, "embedding", None)
        x, length = matrix(right.column("embedding").combine_chunks())
        square, place = squares(x), pc.rank(theirs, sort_keys="ascending", tiebreaker="dense").to_numpy()
        known: dict = {}
        codes = np.array([known.setdefault(v, len(known)) for v in theirs.to_pylist()])
        own = np.array([known.get(v, -1) for v in mine.to_pylist()])
        for b in range(0, len(mine), TOGETHER):
            s = _products(asked, slice(b, b + TOGETHER), x, length, square, None)
            q, r = np.nonzero(s >= least - SLACK)
            about, q = s[q, r], q + b
            other = own[q] != codes[r]
            q, r, about = q[other], r[other], about[other]
            exact = _exact(asked, q, x, r, square, about)
            enough = exact >= least
            q, r, exact = q[enough], r[enough], exact[enough]
            order = np.lexsort((place[r], exact, q))
            q, r, exact = q[order], r[order], exact[order]
            last = np.append(q[1:] != q[:-1], True) if len(q) else np.zeros(0, bool)
            at.append(q[last]), of.append(r[last]), score.append(exact[last])
    q, r = np.concatenate(at), np.concatenate(of)
    return pa.table({"point_id": mine.take(pa.array(q)), "existing_id": theirs.take(pa.array(r)), "similarity": pa.array(np.concatenate(score))})
