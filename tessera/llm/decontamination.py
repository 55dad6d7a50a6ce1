"""Benchmark decontamination with a generalised suffix automaton of the test items.

A text and an item are lower-cased (A-Z) and cut into runs of letters, digits and non-ASCII characters. A window is 13 words of an
item, or a whole shorter item. Texts stream through the automaton, whose longest matching length tells which windows end at each
word; words inside any window are hit.

The automaton runs only where it could complete a window: a vectorised filter finds runs of consecutive words whose neighbouring
pairs all occur in some item, long enough for the shortest window. All else cannot match, so the filter loses nothing.

A large benchmark is taken in shards of a bounded number of words. Each shard is a pass of its own, written to the shared folder before
the next one is broadcast, so that one automaton at a time is held, however many there are.

Very long texts are taken whole, in slices of their own; ties cannot arise, as a word is hit or not.

Defined cases: null texts and items have no words; an item without words is never found; repeated item_ids merge, repeated items
each count; a null item_id reads as an empty one; repeated and null doc_ids are documents like any other; an empty document table
gives an empty result, an empty benchmark leaves everything clean; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.automaton import SuffixAutomaton
from tessera.llm.columns import cut, narrow
from tessera.llm.tokens import ALNUM, Words, batches, cut_words, grams, inside, slices

WINDOW = 13
#: Words of test items in one automaton, of some 300 bytes each. That bounds what is broadcast.
SHARD_WORDS = 300_000

FOUND = "text string, n_words long, spans array<struct<start: int, end: int>>, items array<string>"


class ItemIndex:
    """Automaton, windows and filter of some test items; small, and the same for every document."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.automaton = SuffixAutomaton()
        sequences = []
        for item, text in items:
            if words := (text or "").encode().translate(ALNUM.table).split():
                sequences.append((item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]))
                self.automaton.add(sequences[-1][1])
        lengths, windows, self.items = set(), {}, []
        place: dict[str, int] = {}
        for item, ids in sequences:
            n, own = min(window, len(ids)), place.setdefault(item, len(place))
            lengths.add(n)
            for k, (state, _) in enumerate(self.automaton.matches(ids)):
                if k >= n - 1:  # mostly one item has a window: its number alone, else a tuple of them
                    key = self.automaton.at_length(state, n) * (window + 1) + n
                    have = windows.setdefault(key, own)
                    if have != own and not (isinstance(have, tuple) and own in have):
                        windows[key] = (*have, own) if isinstance(have, tuple) else (have, own)
        self.items = list(place)
        self.window, self.windows, self.lengths = window, windows, sorted(lengths)
        self.shortest = self.lengths[0] if lengths else 0
        self.gram = min(2, self.shortest)
        self.filter = np.zeros(1 << 22, bool)
        if lengths:
            for first, data, offsets in slices(pa.array([t for _, t in items], pa.string())):
                w = cut_words(first, data, offsets, ALNUM)
                self.filter[grams(w.hash, self.gram)[inside(w.bounds, self.gram)] & np.uint64((1 << 22) - 1)] = True

    def regions(self, words: Words) -> Iterator[tuple[int, int]]:
        """Runs of words that may hold a window."""
        if not self.shortest or len(words.hash) < self.shortest:
            return
        f = self.filter[grams(words.hash, self.gram) & np.uint64((1 << 22) - 1)] & inside(words.bounds, self.gram)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], f.view(np.int8), [0]])))
        start, end = edges[::2], edges[1::2] + self.gram - 1
        for i in np.flatnonzero(end - start >= self.shortest):
            if self.gram > 1:
                yield int(start[i]), int(end[i])
            else:  # single words: a run may go over the edge of a document
                cuts = [int(start[i]), *words.bounds[(words.bounds > start[i]) & (words.bounds < end[i])].tolist(), int(end[i])]
                yield from zip(cuts, cuts[1:], strict=False)

    def hits(self, words: Words, i: int, j: int) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of words (from, to) inside windows and the items found, between words i and j."""
        ids = [self.vocabulary.get(w, -1) for w in words.text(i, j).translate(ALNUM.table).split()]
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        for k, (state, n) in enumerate(self.automaton.matches(ids)):
            for size in self.lengths:
                if size > n:
                    break
                have = self.windows.get(self.automaton.at_length(state, size) * (self.window + 1) + size)
                if have is not None:
                    found.update(self.items[x] for x in (have if isinstance(have, tuple) else (have,)))
                    start, end = i + k + 1 - size, i + k + 1
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, end))
        return spans, found


def _passes(d: DataFrame, benchmark: DataFrame, window: int, shard_words: int, kept: str) -> DataFrame:
    """d (kept, text, n_words, spans, items) with what every shard finds. No shuffle. Each pass hands the texts and what it found on
    to the next; all but the last are written first."""
    spark, before = d.sparkSession, None
    for index in shards(benchmark, window, shard_words):
        if before is not None:
            d = cut(d, "decontamination")
            before.unpersist()
        before = spark.sparkContext.broadcast(index)
        schema = T.StructType([d.schema[kept], *T.StructType.fromDDL(FOUND).fields])
        d = d.mapInArrow(_pass(before, kept), schema)
    return d


def _blank(docs: DataFrame, *kept) -> DataFrame:
    none = F.array().cast("array<struct<start: int, end: int>>")
    return docs.select(*kept, F.col("`text`").cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), none.alias("spans"), F.array().cast("array<string>").alias("items"))


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, spans of hit words, items, for each document."""
    return _passes(_blank(docs, F.col("`doc_id`")), benchmark, window, shard_words, "doc_id").drop("text")


def _pass(held, kept: str):
    def scan(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: ItemIndex = held.value
        for batch, words in batches(iterator, ALNUM):
            spans, items = batch.column(3).to_pylist(), [set(x) for x in batch.column(4).to_pylist()]
            for i, j in index.regions(words):
                d = int(np.searchsorted(words.bounds, i, "right")) - 1
                at = int(words.bounds[d])
                where, which = index.hits(words, i, j)
                spans[d] += [{"start": a - at, "end": b - at} for a, b in where]
                items[d] |= which
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(words.bounds), pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                [kept, "text", "n_words", "spans", "items"],
            )

    return scan


def shards(benchmark: DataFrame, window: int, shard_words: int) -> Iterable[ItemIndex]:
    """Indexes of shard_words words at most, read one row at a time. A longer item is cut into pieces that overlap by a window less
    a word, so that no window is lost."""
    held, words, made = [], 0, 0
    most = max(shard_words, 2 * window)
    rows = narrow(benchmark, "item_id", "text").select(F.col("item_id").cast("string"), "text").toLocalIterator()
    for item, text in rows:
        own = (text or "").encode().translate(ALNUM.table).split()
        starts = range(0, max(1, len(own) - window + 1), most - window + 1)
        for i in starts:
            part = own[i : i + most]
            if held and words + len(part) > most:
                yield ItemIndex(held, window)
                held, words, made = [], 0, made + 1
            held.append(("" if item is None else item, b" ".join(part).decode()))
            words += len(part)
    if held or not made:
        yield ItemIndex(held, window)


def judged(found: DataFrame) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated (5% of the words or more are hit) to what find() gives."""
    merged = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("hit"), F.lit(-1).alias("upto")),
        lambda acc, s: F.struct((acc["hit"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["upto"]))).cast("long").alias("hit"), F.greatest(acc["upto"], s["end"]).alias("upto")),
        lambda acc: acc["hit"],
    )
    d = found.withColumn("n_hit", F.when(F.size("spans") == 0, F.lit(0).cast("long")).otherwise(merged)).withColumn("n_items", F.size("items").cast("long"))
    return d.withColumn("items_sha256", F.sha2(F.encode(F.concat_ws(",", F.array_sort("items")), "UTF-8"), 256)).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs less the contaminated documents, all columns as they are. Rows are judged where they stand, whatever their doc_ids."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    found = _passes(_blank(docs, row), benchmark, window, shard_words, "row")
    return judged(found).filter(~F.col("contaminated")).select("row.*")


def removed(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """As find(), with the text less the spans of its hit words: every stretch of a window's length or more that stands in an item (or
    of a whole shorter item) is cut out, what stands around it stays. Null texts are empty."""
    found = _passes(_blank(docs, F.col("`doc_id`")), benchmark, window, shard_words, "doc_id")
    at, spans_at = found.columns.index("text"), found.columns.index("spans")

    def cut_out(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in iterator:
            texts = batch.column(at).fill_null("")
            hit = np.flatnonzero(np.diff(batch.column(spans_at).offsets.to_numpy()) > 0)
            if len(hit):
                own = texts.to_pylist()
                for k in hit.tolist():
                    own[k] = without_spans(own[k], [(s["start"], s["end"]) for s in batch.column(spans_at)[k].as_py()])
                texts = pa.array(own, pa.string())
            yield pa.RecordBatch.from_arrays([texts if k == at else c for k, c in enumerate(batch.columns)], batch.schema.names)

    return found.mapInArrow(cut_out, found.schema)


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text less the given spans of words, with what stands between their words."""
    if not spans or not text:
        return text or ""
    raw = text.encode()
    w = cut_words(0, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), ALNUM, hashed=False)
    out, at = [], 0
    for i, j in sorted(spans):
        out.append(raw[at : max(at, int(w.start[i]))])
        at = max(at, int(w.end[j - 1]))
    return b"".join([*out, raw[at:]]).decode()
