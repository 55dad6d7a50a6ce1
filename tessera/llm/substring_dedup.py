"""Substring dedup: suffix automata of reference shards find every run of 50 words that an earlier document holds too.

The corpus is both what is searched and what it is searched for, so the shards of the reference grow with it; broadcasting each of
them to every task would cost shards x documents. Instead a shard travels only to the texts that may match it:

1. Each window of 50 words is named by an anchor, the least hash among its runs of 25 words (a minimiser). Equal windows have equal
   anchors. Anchors that only one document holds are dropped; so are documents equal to an earlier one, which fall as a whole.
2. What is left of a document is cut into stretches, the consecutive windows of one anchor with all their words. Equal stretches are
   merged, keeping the least doc_id. A shard is all distinct stretches of an anchor.
3. A shard is dealt into parts of some hundred stretches, most shards into one. A part becomes a suffix automaton whose states know the
   least doc_id; each stretch streams through it, and the matching statistics give the first holder of each of its windows. A shard
   of one stretch needs no automaton. The parts of one shard exchange, for each distinct window, the first holder they know; a
   window that very many stretches hold costs a row for each part, not for each stretch, so no task is hot.
4. Windows whose first holder precedes their document are merged into maximal spans, which are removed.

Words are runs of characters other than space, tab and line breaks, unchanged. Matching compares words, not hashes.

Defined cases: null and empty texts have no words; documents of fewer than 50 words lose nothing; very long texts are
read whole, in stretches around their anchors; of equal windows the least doc_id keeps them; a null doc_id is neither earlier
nor later than any other and loses nothing; rows that repeat a doc_id are not earlier than each other; an empty table gives an
empty result; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.automaton import SuffixAutomaton
from tessera.llm.columns import cut, id_field, narrow
from tessera.llm.tokens import NON_SPACE, Words, batches, grams

WINDOW = 50
ANCHOR = 25
#: Stretches of one automaton, about; larger shards are dealt into parts.
LARGEST = 400


def anchors(words: Words, d: int, window: int = WINDOW, anchor: int = ANCHOR) -> np.ndarray:
    """The anchor of each window of document d."""
    h = words.hash[words.bounds[d] : words.bounds[d + 1]]
    if len(h) < window:
        return np.zeros(0, np.uint64)
    g, span, have = grams(h, anchor), window - anchor + 1, 1
    while have * 2 <= span:  # the least of 2, 4, 8, ... and then of two overlapping runs
        g = np.minimum(g[:-have], g[have:])
        have *= 2
    return np.minimum(g[: len(g) - (span - have)], g[span - have :]) if span > have else g


def _describe(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, rid, digest of the text, words and distinct anchors, of doc_id, text, rid."""
    for batch, words in batches(iterator, NON_SPACE):
        digests = [hashlib.blake2b(b, digest_size=16).digest() for b in _raw(batch)]
        found = [np.unique(anchors(words, d)).view(np.int64) for d in range(words.docs)]
        ends = np.cumsum([0, *(len(x) for x in found)])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(digests, pa.binary()), pa.array(np.diff(words.bounds), pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))],
            ["doc_id", "rid", "digest", "n_words", "anchors"],
        )


def _raw(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]


def _stretches(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches of wanted anchors: anchor, sub (digest of its words), doc_id, digest, start, windows, words."""
    for batch, words in batches(iterator, NON_SPACE):
        ids, digests, wanted, raw = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), _raw(batch)
        cols: list[list] = [[] for _ in range(7)]
        for d in range(words.docs):
            if hashlib.blake2b(raw[d], digest_size=16).digest() != digests[d]:
                continue  # another text with this row hash
            a = anchors(words, d)
            want = np.sort(wanted[d].values.to_numpy(zero_copy_only=False).view(np.uint64))
            hit = want[np.minimum(np.searchsorted(want, a), len(want) - 1)] == a
            cuts = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1, [len(a)]])
            own = raw[d].split()
            for i, j in zip(cuts, cuts[1:], strict=False):
                if hit[i]:
                    text = b" ".join(own[i : j + WINDOW - 1])
                    for c, v in zip(cols, (int(a[i : i + 1].view(np.int64)[0]), hashlib.blake2b(text, digest_size=16).digest(), ids[d], digests[d], int(i), int(j - i), text), strict=True):
                        c.append(v)
        kinds = (pa.int64(), pa.binary(), batch.column(0).type, pa.binary(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["anchor", "sub", "doc_id", "digest", "start", "windows", "words"])


def first_holders(stretches: list[tuple[int, bytes]], window: int = WINDOW) -> list[list[int]]:
    """For (doc_id, words) stretches of one shard: the least doc_id that holds each window of each, from one suffix automaton."""
    vocabulary: dict[bytes, int] = {}
    sequences = [[vocabulary.setdefault(w, len(vocabulary)) for w in text.split()] for _, text in stretches]
    a = SuffixAutomaton()
    for s in sequences:
        a.add(s)
    least: dict[int, int] = {}  # of a state's runs of window words: a run of that length has one state
    states = []
    for (doc, _), s in zip(stretches, sequences, strict=True):
        own = [a.at_length(state, window) for k, (state, n) in enumerate(a.matches(s)) if n >= window and k >= window - 1]
        states.append(own)
        for x in own:
            if x not in least or doc < least[x]:
                least[x] = doc
    return [[least[x] for x in own] for own in states]


def _search(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor and part: anchor, part, sub, first, words, parts. Gives anchor, part, sub, firsts, and, where a shard has
    several parts, keys: a digest of each window."""
    held: list[tuple] = []

    def solved(rows: list[tuple]) -> Iterator[tuple]:
        for r, f in zip(rows, first_holders([(r[3], r[4]) for r in rows]), strict=True):
            own = r[4].split() if r[5] > 1 else None
            yield r[0], r[1], r[2], f, own and [hashlib.blake2b(b" ".join(own[k : k + WINDOW]), digest_size=16).digest() for k in range(len(f))]

    def emit(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.list_(kind), pa.list_(pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["anchor", "part", "sub", "firsts", "keys"])

    kind = pa.int64()
    for batch in iterator:
        out, kind = [], batch.column(3).type
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:2] != row[:2]:
                out += solved(held)
                held = []
            held.append(row)
        if out:
            yield emit(out, kind)
    if held:
        yield emit(list(solved(held)), kind)


def _kept(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removes the spans that are of the text itself: others name another text with its doc_id."""
    for batch in iterator:
        cols: list[list] = [[] for _ in range(4)]
        for doc, raw, spans in zip(batch.column(0).to_pylist(), _raw(batch), batch.column(2).to_pylist(), strict=True):
            own, upto, out = raw.split(), 0, []
            merged: list[list[int]] = []
            digest = hashlib.blake2b(raw, digest_size=16).digest() if spans else b""
            for i, j in sorted((s["start"], s["start"] + s["windows"] + WINDOW - 1) for s in spans or [] if s["digest"] == digest):
                if merged and i <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], j)
                else:
                    merged.append([i, j])
            for i, j in merged:
                out += own[upto:i]
                upto = j
            out += own[upto:]
            for c, v in zip(cols, (doc, len(own), len(own) - len(out), b" ".join(out)), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.column(0).type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])


def repeated_spans(docs: DataFrame, largest: int = LARGEST) -> DataFrame:
    """doc_id, spans: runs of windows (digest of the text, start, windows) that an earlier document holds, for documents with any."""
    field = id_field(docs)
    kind = field.removeprefix("doc_id ")
    source = narrow(docs, "doc_id", "text").filter("doc_id IS NOT NULL").withColumn("rid", F.xxhash64("doc_id", "text"))
    described = cut(source.mapInArrow(_describe, f"{field}, rid long, digest binary, n_words long, anchors array<long>"), "anchors").filter(F.col("n_words") >= WINDOW)
    first = described.groupBy("digest").agg(F.min(F.struct("doc_id", "rid")).alias("r")).select("digest", F.col("r.doc_id").alias("first"), F.col("r.rid").alias("rid"))
    whole = described.select("doc_id", "digest", "n_words").join(first.drop("rid"), "digest").filter("doc_id > first").select("doc_id", "digest", F.lit(0).alias("start"), (F.col("n_words") - WINDOW + 1).cast("int").alias("windows")).distinct()
    pairs = described.join(first.drop("first"), ["digest", "rid"]).select("doc_id", "rid", "digest", F.explode("anchors").alias("anchor")).distinct()
    shared = pairs.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("anchor")
    wanted = pairs.join(shared, "anchor").groupBy("rid", "digest").agg(F.collect_list("anchor").alias("anchors"))
    found = source.join(wanted, "rid").select("doc_id", "text", "digest", "anchors")
    found = cut(found.mapInArrow(_stretches, f"anchor long, sub binary, {field}, digest binary, start int, windows int, words binary"), "stretches")
    subs = cut(found.groupBy("anchor", "sub").agg(F.min("doc_id").alias("first")), "shards")
    several = subs.groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / F.lit(largest)).cast("int").alias("parts"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    dealt = subs.join(several, "anchor").select("anchor", "sub", F.col("first").alias("doc_id"), "first", "parts", F.pmod(F.xxhash64("sub"), F.col("parts")).cast("int").alias("part"))
    texts = found.join(dealt, ["anchor", "sub", "doc_id"]).select("anchor", "part", "sub", "first", "words", "parts").dropDuplicates(["anchor", "sub"])
    local = texts.repartition("anchor", "part").sortWithinPartitions("anchor", "part").mapInArrow(_search, f"anchor long, part int, sub binary, firsts array<{kind}>, keys array<binary>")
    local = cut(local, "holders")
    one = local.filter("keys IS NULL").select("anchor", "sub", "firsts")
    each = local.filter("keys IS NOT NULL").select("anchor", "part", "sub", F.posexplode(F.arrays_zip("firsts", "keys")).alias("place", "w")).select("anchor", "part", "sub", "place", F.col("w.firsts").alias("first"), F.col("w.keys").alias("key"))
    known = each.groupBy("anchor", "part", "key").agg(F.min("first").alias("own"))
    best = known.join(known.groupBy("anchor", "key").agg(F.min("own").alias("best")), ["anchor", "key"]).filter("best < own").select("anchor", "part", "key", "best")
    merged = each.join(best, ["anchor", "part", "key"], "left").groupBy("anchor", "sub").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.coalesce("best", "first").alias("least")))), lambda x: x["least"]).alias("firsts"))
    firsts = subs.join(one.unionByName(merged), ["anchor", "sub"], "left")
    rows = found.drop("words").join(firsts, ["anchor", "sub"])
    run = F.struct(F.col("start").alias("start"), F.col("windows").alias("windows"))
    places = F.filter(F.sequence(F.lit(0), F.col("windows") - 1), lambda i: F.element_at("firsts", i + 1) < F.col("doc_id"))
    spans = F.when(F.col("firsts").isNull(), F.when(F.col("first") < F.col("doc_id"), F.array(run)).otherwise(F.array().cast("array<struct<start: int, windows: int>>"))).otherwise(F.transform(places, lambda i: F.struct((F.col("start") + i).alias("start"), F.lit(1).alias("windows"))))
    partial = rows.select("doc_id", "digest", F.explode(spans).alias("span")).select("doc_id", "digest", "span.start", "span.windows")
    return partial.unionByName(whole).groupBy("doc_id").agg(F.collect_list(F.struct("digest", "start", "windows")).alias("spans"))


def dedup(docs: DataFrame, largest: int = LARGEST) -> DataFrame:
    """doc_id, n_words, n_removed, kept (kept words joined by one space, UTF-8), for each document."""
    source = narrow(docs, "doc_id", "text")
    return source.join(repeated_spans(docs, largest), "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(_kept, f"{id_field(docs)}, n_words long, n_removed long, kept binary")
