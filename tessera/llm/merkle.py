"""Merkle manifest of a dataset: a tree of digests over the rows of each source, a tree over the sources, and a proof for every row.

A row's digest is the SHA-256 of its fields; runs of 16 neighbouring digests, as hexadecimal text, are hashed into the next level
until one is left. Rows are ordered by ranges, so that no task holds a whole source, and numbered by counts of the ranges before. The
tree is climbed in aligned blocks of 4,096 digests: a block is a contiguous matrix of 64 bytes a row, each level is that matrix
reshaped by 16 and hashed row by row, so one shuffle climbs three levels. A proof needs the other digests of each run on the way up:
within a block they come from index arithmetic, above it every block is handed the path of its parent, down from the root.

Defined cases: null fields are "-"; null sources are a source of their own, which comes first; within a source rows go by doc_id, null
first, and repeated doc_ids by digest; a source of one row has that row's digest as its root, and with one source alone its root is
the root; rows that repeat have equal digests, and each has a proof of its own place; very long texts are hashed in the JVM and go no
further; an empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.columns import cut, id_field

FANOUT, BITS = 16, 4
#: Digests of one block, and the levels that it climbs.
DEPTH = 3
BLOCK = FANOUT**DEPTH
#: Bytes of a digest as text.
HEX = 64
#: Key of all sources' roots, which are one more tree.
ALL = "*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """A field as it is hashed: its size in bytes, a colon, and the value; "-" if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*(field(v) for v in values)), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with place (from 0, in the order of its key) and total (rows of the key). Keys and order decide on ranges, so a large key
    is spread; a range's rows are numbered where they are and moved up by the counts of the key's ranges before."""
    ranged = rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    written = cut(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "merkle-order")
    per = written.groupBy("key", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("key")
    before = F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = per.select("key", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(w).alias("total"))
    return written.join(counted, ["key", "_part"]).withColumn("place", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_first", "_shift")


def height(total: int) -> int:
    """Levels above so many digests."""
    h = 0
    while FANOUT**h < total:
        h += 1
    return h


def levels(leaves: np.ndarray, total: int) -> list[np.ndarray]:
    """The matrices of a block's levels, leaves first. A block of a larger tree climbs all levels of a block, a tree of its own as
    many as it has."""
    out = [leaves]
    for _ in range(height(total) if total <= BLOCK else DEPTH):
        m = out[-1]
        up = b"".join(hashlib.sha256(m[k : k + FANOUT]).hexdigest().encode() for k in range(0, len(m), FANOUT))
        out.append(np.frombuffer(up, np.uint8).reshape(-1, HEX))
    return out


def _matrix(column: pa.ChunkedArray, order: np.ndarray) -> np.ndarray:
    return np.frombuffer("".join(column.to_pylist()).encode(), np.uint8).reshape(-1, HEX)[order]


def _block(table: pa.Table) -> tuple[np.ndarray, np.ndarray, int]:
    """Order of a block's rows, its digests in that order, the size of its tree."""
    order = np.argsort(table.column("place").to_numpy(), kind="stable")
    return order, np.ascontiguousarray(_matrix(table.column("digest"), order)), table.column("total")[0].as_py()


def _climb(table: pa.Table) -> pa.Table:
    _, leaves, total = _block(table)
    top, place = levels(leaves, total)[-1], table.column("place")[0].as_py() // BLOCK
    return pa.table({"key": [table.column("key")[0].as_py()], "place": pa.array([place], pa.int64()), "total": pa.array([-(-total // BLOCK)], pa.int64()), "digest": [top.tobytes().decode()]})


def climb(level: DataFrame, name: str) -> list[DataFrame]:
    """All block levels of the trees of rows (key, place, total, digest), roots last; each is written."""
    most = level.agg(F.max("total")).first()[0] or 0
    out = [level]
    while most > 1:
        up = out[-1].select("key", "place", "total", "digest").groupBy("key", F.expr(f"place div {BLOCK}").alias("block")).applyInArrow(_climb, "key string, place long, total long, digest string")
        out.append(cut(up, name))
        most = -(-most // BLOCK)
    return out


def siblings(path: bytes) -> Iterator[tuple[bytes, bytes]]:
    """What stands left and right of a node in each run on the way up, from a path: position, size and digests of each run."""
    at = 0
    while at < len(path):
        k, n = path[at], path[at + 1]
        run = path[at + 2 : at + 2 + n * HEX]
        yield run[: k * HEX], run[(k + 1) * HEX :]
        at += 2 + n * HEX


def own_path(matrices: list[np.ndarray], i: int) -> bytes:
    """Path of the i-th digest of a block to the block's top."""
    out = []
    for level, m in enumerate(matrices[:-1]):
        at = i >> (BITS * level)
        run = m[at & ~(FANOUT - 1) : (at | (FANOUT - 1)) + 1]
        out += [bytes((at & (FANOUT - 1), len(run))), run.tobytes()]
    return b"".join(out)


def fold(digest: bytes, steps: list[tuple[bytes, bytes]]) -> bytes:
    for left, right in steps:
        digest = hashlib.sha256(left + digest + right).hexdigest().encode()
    return digest


def _descend(table: pa.Table, parent: pa.Table) -> pa.Table:
    """key, place, path, subroot, root of a block's digests below a parent."""
    order, leaves, total = _block(table)
    matrices, above = levels(leaves, total), parent.column("path")[0].as_py()
    n = len(order)
    out = {"key": table.column("key").take(pa.array(order)), "place": table.column("place").take(pa.array(order)), "path": pa.array([own_path(matrices, i) + above for i in range(n)], pa.binary())}
    for name in ("subroot", "root"):
        out[name] = pa.array([parent.column(name)[0].as_py()] * n, pa.string())
    return pa.table(out)


def _prove(table: pa.Table, parent: pa.Table) -> pa.Table:
    """The rows of a block with proof_sha256 and folded_root; folds that reach the block's top alike share the way above it."""
    order, leaves, total = _block(table)
    matrices, above = levels(leaves, total), list(siblings(parent.column("path")[0].as_py()))
    rest, tops = b"".join(left + right for left, right in above), {}
    changed, proof, folded = table.column("changed").take(pa.array(order)).to_pylist(), [], []
    for i in range(len(order)):
        steps = list(siblings(own_path(matrices, i)))
        h = hashlib.sha256(b"".join(left + right for left, right in steps))
        h.update(rest)
        proof.append(h.hexdigest())
        top = fold(leaves[i].tobytes() if changed[i] is None else changed[i].encode(), steps)
        if top not in tops:
            tops[top] = fold(top, above).decode()
        folded.append(tops[top])
    rows = table.take(pa.array(order))
    many = len(order)
    return pa.table({
        "doc_id": rows.column("doc_id"), "leaf": rows.column("digest"), "subroot": pa.array([parent.column("subroot")[0].as_py()] * many, pa.string()),
        "root": pa.array([parent.column("root")[0].as_py()] * many, pa.string()), "proof_sha256": pa.array(proof, pa.string()), "folded_root": pa.array(folded, pa.string()),
    })


def _below(level: DataFrame, parents: DataFrame, function, schema: str) -> DataFrame:
    """Blocks of a level, each with the row of its parent."""
    blocks = level.withColumn("block", F.expr(f"place div {BLOCK}")).groupBy("key", "block")
    return blocks.cogroup(parents.withColumnRenamed("place", "block").groupBy("key", "block")).applyInArrow(function, schema)


PATHS = "key string, place long, path binary, subroot string, root string"


def manifest(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, for every row of documents.

    changed: the text that a row is found to hold now, null where it is the text of the manifest; folded_root is the root that follows
    from it (from the stored leaf, where null) and the stored siblings.
    """
    fields = [F.col(f"`{n}`") for n in ("doc_id", "source", "lang", "n_chars", "text")]
    source = fields[1].cast("string")
    key = F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source))  # null first, then by bytes
    now = F.lit(None).cast("string") if changed is None else F.when(changed.isNotNull(), row_digest(*fields[:4], changed))
    leaves = cut(docs.select(key.alias("key"), fields[0].alias("doc_id"), row_digest(*fields).alias("digest"), now.alias("changed")), "merkle-leaves")
    rows = numbered(leaves, ["doc_id", "digest"])
    schema = f"{id_field(docs)}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    below = climb(rows, "merkle-sources")
    roots = below[-1].select(F.lit(ALL).alias("key"), F.col("key").alias("name"), "digest")
    tops = climb(numbered(roots, ["name"]), "merkle-root")
    # from the root down to the roots of sources; there is one row for each source
    parents = tops[-1].select("key", "place", F.lit(b"").alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    for level in reversed(tops[:-1]):
        parents = cut(_below(level.select("key", "place", "total", "digest"), parents, _descend, PATHS), "merkle-paths")
    parents = tops[0].select("place", F.col("name").alias("key"), F.col("digest").alias("subroot")).join(parents.select("place", "path", "root"), "place").select("key", F.lit(0).cast("long").alias("place"), "path", "subroot", "root")
    for level in reversed(below[1:-1]):
        parents = cut(_below(level, parents, _descend, PATHS), "merkle-paths")
    return _below(below[0], parents, _prove, schema)


def tampered(docs: DataFrame) -> Column:
    """The text with A-Z lower-cased, of the rows whose doc_id as text has a crc32 that 5 divides; null for the others."""
    hit = F.crc32(F.encode(F.col("`doc_id`").cast("string"), "UTF-8")) % 5 == 0
    return F.when(hit, F.translate(F.col("`text`").cast("string"), UPPER, LOWER))


def verified(docs: DataFrame) -> DataFrame:
    """The manifest's rows after tampering, and whether each still leads to the root."""
    return manifest(docs, tampered(docs)).withColumn("verified", F.col("folded_root") == F.col("root"))
