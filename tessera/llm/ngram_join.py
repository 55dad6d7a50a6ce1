"""N-gram Jaccard join: MinHash banding, verified on full sets of five-word shingles.

Words are runs of letters, digits and non-ASCII characters, A-Z read as a-z. A document's set holds its distinct runs of five
words, or all its words as one run where it has fewer. Documents with equal sets are one class and are compared once.

Bands and rows are chosen so that a pair at the threshold shares a band with the target probability or more. Band hashes are
shuffled without sets; buckets with the same members are compared once; sets travel only to buckets of two members or more. A
bucket of many members is dealt out as pairs of blocks to many tasks, and each task returns a row per document (links counted,
and the least document that it hangs together with over the links of its part), never a row per pair. A pair that meets in several
buckets counts in one of them.

Defined cases: null and empty texts, and texts without words, have empty sets: they link only to texts equal to them (null as
empty); repeated rows, repeated doc_ids and null doc_ids are documents like any other; an empty table gives an empty result; very long
texts are compared by all their n-grams; a class
is named by its least doc_id (null where no document of it has one).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.columns import cut, id_field
from tessera.llm.components import components
from tessera.llm.tokens import ALNUM, Words, batches, grams, inside, mix

SHINGLE = 5
THRESHOLD = 0.8
#: Least probability that a pair at the threshold becomes a candidate.
RECALL = 0.9999
#: Members of one block of a bucket; a task compares two blocks.
BLOCK = 512


def bands_and_rows(threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = 160) -> tuple[int, int]:
    """The most rows, and for them the fewest bands, that reach the recall at the threshold within so many hashes."""
    for rows in range(12, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most_hashes:
            return bands, rows
    return most_hashes, 1


def shingle_sets(words: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a slice, document by document, and their bounds; not yet distinct."""
    count = np.diff(words.bounds)
    sizes = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(int(bounds[-1]), np.uint64)
    if len(words.hash) >= n:
        long = grams(words.hash, n)[inside(words.bounds, n)]
        at = np.repeat(count >= n, sizes)
        out[at] = long
    for d in np.flatnonzero((count > 0) & (count < n)):
        h = count[d : d + 1].astype(np.uint64)
        for k in range(words.bounds[d], words.bounds[d + 1]):
            h = mix(h * np.uint64(31) + words.hash[k : k + 1])
        out[bounds[d]] = h[0]
    return out, bounds


def _set_of(hashes: np.ndarray) -> np.ndarray:
    return np.unique(hashes)


def _node(distinct: np.ndarray, raw: bytes) -> bytes:
    """Names a class: a digest of the set, or of the text where there are no words."""
    return hashlib.blake2b(distinct.tobytes() if len(distinct) else b"text" + raw, digest_size=16).digest()


def _signer(bands: int, rows: int) -> Callable:
    rng = np.random.default_rng(12)
    mult = rng.integers(0, 1 << 32, bands * rows, np.uint64).astype(np.uint32) | np.uint32(1)
    plus = rng.integers(0, 1 << 32, bands * rows, np.uint64).astype(np.uint32)

    def sign(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in batches(iterator, ALNUM):
            hashes, bounds = shingle_sets(words)
            full = np.flatnonzero(np.diff(bounds) > 0)
            keys = np.zeros((len(full), bands), np.uint64)
            if len(full):
                x = (hashes >> np.uint64(32)).astype(np.uint32)
                for b in range(bands):
                    h = np.full(len(full), b + 1, np.uint64)
                    for r in range(b * rows, (b + 1) * rows):
                        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(x * mult[r] + plus[r], bounds[full]).astype(np.uint64))
                    keys[:, b] = h
            offsets = np.zeros(words.docs + 1, np.int32)
            offsets[full + 1] = bands
            text = batch.column(1)
            nodes = []
            for d in range(words.docs):
                distinct = _set_of(hashes[bounds[d] : bounds[d + 1]])
                nodes.append(_node(distinct, b"" if len(distinct) else (text[d].as_py() or "").encode()))
            kept = [batch.column(k) for k in range(batch.num_columns) if k != 1]
            names = [n for n in batch.schema.names if n != "text"]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(offsets), pa.int32()), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([*kept, pa.array(nodes, pa.binary()), lists], [*names, "node", "bands"])

    return sign


def _sets(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, shingles of texts that are what their node says (two texts may have one row hash)."""
    for batch, words in batches(iterator, ALNUM):
        hashes, bounds = shingle_sets(words)
        wanted, out = batch.column(2).to_pylist(), ([], [])
        for d in range(words.docs):
            distinct = _set_of(hashes[bounds[d] : bounds[d + 1]])
            if len(distinct) and _node(distinct, b"") == wanted[d]:
                out[0].append(wanted[d])
                out[1].append(distinct.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary())], ["node", "shingles"])


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Which sets have at least that Jaccard similarity. right None: among left.

    A sparse product: shingles of one set alone count only in sizes; the rest become columns, some thousands at a time.
    """
    both = left + (right or [])
    sizes = np.array([len(s) for s in both])
    flat, owner = np.concatenate(both), np.repeat(np.arange(len(both)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = column[shared], owner[shared]
    column = np.unique(column, return_inverse=True)[1] if len(column) else column
    n = len(left)
    inter = np.zeros((n, len(right) if right is not None else n), np.float32)
    step = max(256, (1 << 23) // len(both))
    total = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, total, step):
        here = slice(*np.searchsorted(column, [at, at + step]))
        x = np.zeros((len(both), min(step, total - at)), np.float32)
        x[owner[here], column[here] - at] = 1
        inter += x[:n] @ (x if right is None else x[n:]).T
    union = sizes[:n, None] + (sizes[None, :n] if right is None else sizes[None, n:]) - inter
    return inter >= threshold * union - 1e-6


def _roots(link: np.ndarray, nodes: list[bytes]) -> list[bytes]:
    """For each of the nodes, the least one of its component; link is symmetric."""
    roots, seen = list(nodes), np.zeros(len(nodes), bool)
    for start in np.flatnonzero(link.any(1)):
        if seen[start]:
            continue
        seen[start], found, front = True, [start], np.array([start])
        while len(front):
            front = np.flatnonzero(link[front].any(0) & ~seen)
            seen[front] = True
            found += front.tolist()
        least = min(nodes[i] for i in found)
        for i in found:
            roots[i] = least
    return roots


def _compare(threshold: float) -> Callable:
    def one(members: list[dict]) -> Iterator[tuple[bytes, int, bytes]]:
        """Links within a bucket's block, or between two of its blocks."""
        key, lo, hi = members[0]["key"], members[0]["lo"], members[0]["hi"]
        a = [m for m in members if m["block"] == lo]
        b = a if lo == hi else [m for m in members if m["block"] == hi]
        if not a or not b or (lo == hi and len(a) < 2):
            return
        skip = np.zeros((len(a), len(b)), bool)
        earlier: dict[int, tuple[list[int], list[int]]] = {}
        for side, part in enumerate((a, b)):
            for i, m in enumerate(part):
                for k in m["keys"]:
                    if k < key:
                        earlier.setdefault(k, ([], []))[side].append(i)
        for x, y in earlier.values():
            if x and y:
                skip[np.ix_(x, y)] = True
        if lo == hi:
            np.fill_diagonal(skip, True)
        if skip.all():
            return
        sets = lambda part: [np.frombuffer(m["shingles"], np.uint64) for m in part]
        link = linked(sets(a), None if lo == hi else sets(b), threshold) & ~skip
        weight = lambda part: np.array([m["copies"] for m in part], np.int64)
        nodes, counts = [m["node"] for m in a], link @ weight(b)
        if lo != hi:
            nodes, counts = nodes + [m["node"] for m in b], np.concatenate([counts, weight(a) @ link])
            link = np.block([[np.zeros((len(a), len(a)), bool), link], [link.T, np.zeros((len(b), len(b)), bool)]])
        roots = _roots(link, nodes)
        for i in np.flatnonzero(link.any(1)):
            yield nodes[i], int(counts[i]), roots[i]

    def compare(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group = [], None

        def emit(rows: list[tuple[bytes, int, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["node", "links", "to"])

        for batch in iterator:
            out: list[tuple[bytes, int, bytes]] = []
            for row in batch.to_pylist():
                g = (row["key"], row["lo"], row["hi"])
                if g != group:
                    if held:
                        out += one(held)
                    held, group = [], g
                held.append(row)
            if out:
                yield emit(out)
        if held:
            yield emit(list(one(held)))

    return compare


def _row(docs: DataFrame) -> list:
    """Hashes of a row: of doc_id and text (a key of work tables, checked wherever it matters), again with another seed, of the rest."""
    rest = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in t else F.col(f"`{c}`") for c, t in docs.dtypes if c not in ("doc_id", "text")]
    text = F.col("`text`").cast("string")
    return [F.xxhash64("`doc_id`", text).alias("rid"), F.xxhash64(F.lit("second"), text, "`doc_id`").alias("rid2"), F.xxhash64(F.lit(0), *rest).alias("rest")]


def _grouped(docs: DataFrame, threshold: float, recall: float, block: int, *more: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, rid, more, node) and nodes (node, root, copies, first, links)."""
    bands, rows = bands_and_rows(threshold, recall)
    hashes = dict(zip(("rid", "rid2", "rest"), _row(docs), strict=True))
    source = docs.select(F.col("`doc_id`"), F.col("`text`").cast("string").alias("text"), *(hashes[k] for k in ("rid", *more)))
    schema = f"{id_field(docs)}, " + "".join(f"{k} long, " for k in ("rid", *more)) + "node binary, bands array<long>"
    signed = cut(source.mapInArrow(_signer(bands, rows), schema), "signatures")
    classes = signed.groupBy("node").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    # a class's bands are those of any of its documents: they depend on the set alone
    keyed = signed.join(classes.select("node", "rid"), ["node", "rid"]).select("node", F.explode("bands").alias("key")).distinct()
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("node")).alias("m1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("m2")).filter("members > 1")
    kept = buckets.groupBy("m1", "m2", "members").agg(F.min("key").alias("key")).select("key", "members")
    members = cut(keyed.join(kept, "key"), "buckets")
    keys = members.groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    wanted = keys.join(classes.select("node", "rid", "copies"), "node")
    texts = source.join(wanted.select("rid", "node"), "rid").select("doc_id", "text", "node")
    sets = texts.mapInArrow(_sets, "node binary, shingles binary").join(wanted.select("node", "keys", "copies"), "node").dropDuplicates(["node"])
    blocks = F.ceil(F.col("members") / F.lit(block)).cast("int")
    placed = members.select("key", "node", blocks.alias("blocks")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", "node", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    work = dealt.join(sets, "node").select("key", "lo", "hi", "block", "node", "copies", "keys", "shingles")
    found = cut(work.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(_compare(threshold), "node binary, links long, to binary"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("u"), F.col("to").alias("v")))
    named = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(links, "node", "left")
    return signed, named.select("node", "root", "copies", "first", F.coalesce("links", F.lit(0)).alias("links"))


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id (least doc_id of all documents linked to it, directly or over others), n_links (other documents with at
    least that similarity, equal ones included), set_id (names documents with equal sets), for each document."""
    signed, named = _grouped(docs, threshold, recall, block)
    least = named.groupBy("root").agg(F.min("first").alias("class_id"))
    named = named.join(least, "root").select("node", "class_id", (F.col("copies") - 1 + F.col("links")).alias("n_links"))
    return signed.select("doc_id", "node").join(named, "node").select("doc_id", "class_id", "n_links", F.hex("node").alias("set_id"))


def representatives(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """docs less all but one row of each class: the one with the least doc_id (null last), and, where a doc_id repeats, the least
    hash of its text and of its other columns. Rows of other classes stay whatever their doc_id is; reruns agree."""
    signed, named = _grouped(docs, threshold, recall, block, "rid2", "rest")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "rid", "rid2", "rest")
    keep = signed.drop("bands").join(named.select("node", "root"), "node").groupBy("root").agg(F.min(order).alias("row")).select("row.rid", "row.rid2", "row.rest")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    return docs.select(row, *_row(docs)).join(keep, ["rid", "rid2", "rest"], "left_semi").dropDuplicates(["rid", "rid2", "rest"]).select("row.*")
