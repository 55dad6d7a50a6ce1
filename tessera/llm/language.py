"""Language identification with hyperdimensional profiles.

Every letter has a random vector of plus and minus ones, drawn from its code point. Three neighbouring characters are bound into the
vector of their trigram: the first letter's vector permuted twice, the second's once, the third's as it is, multiplied place by place.
What is no letter has a vector of its own, so that word edges count. A text's profile is the sum (bundle) of the vectors of its
trigrams; a language's prototype is the sum over all its training texts, in whole numbers, so it is the same whatever the order of
rows. A text gets the language whose prototype is nearest by cosine.

Profiles are made for a slice of texts at once: the counts of its distinct trigrams, times the trigrams' vectors.

Defined cases: a null text, or one without a letter, is "und" with score 0; without any training text everyone is "und"; equal
cosines give the first language by code point; null langs are never learnt; rows of a null doc_id are not held out; repeated rows are
judged alike, and each counts in training; very long texts are taken in pieces, whose profiles add up; an empty table gives an empty
result; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.columns import id_field, narrow
from tessera.llm.tokens import slices

UNKNOWN = "und"
FOLDS, HELD_OUT = 4, 2
DIMENSIONS, SEED = 1024, 20_011
#: Characters of a text that are looked at together, texts of one matrix of counts, and trigrams of one matrix of vectors.
PIECE, TEXTS, GRAMS = 1 << 20, 512, 8192
#: Sums of a prototype that travel in one row.
WIDE = 16
_VECTORS: dict[int, np.ndarray] = {}


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: crc32 of the doc_id as text leaves 2 modulo 4. A null doc_id is not held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS == HELD_OUT, F.lit(False))


def letter(code: int) -> np.ndarray:
    """The vector of a character; 0 stands for all that are no letters."""
    if code not in _VECTORS:
        _VECTORS[code] = np.random.default_rng([SEED, code]).integers(0, 2, DIMENSIONS).astype(np.float32) * 2 - 1
    return _VECTORS[code]


def pieces(texts: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of (strings, text of each, characters before and after that are only looked at as neighbours)."""
    own: list[str] = []
    doc, before, after, size = [], [], [], 0
    for i, t in enumerate(texts):
        for s in range(0, len(t), PIECE):
            e, a = min(len(t), s + PIECE), max(0, s - 1)
            own.append(t[a : e + 1])
            doc.append(i)
            before.append(s - a)
            after.append(len(own[-1]) - (e - a))
            size += len(own[-1])
            if size >= PIECE:
                yield own, np.array(doc), np.array(before), np.array(after)
                own, doc, before, after, size = [], [], [], [], 0
    if own:
        yield own, np.array(doc), np.array(before), np.array(after)


def trigrams(own: list[str], doc: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct trigrams as rows of three characters, and (text, trigram) of each trigram around a letter."""
    code = np.frombuffer(("\0" + "\0".join(own) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(s) for s in own])
    start = np.cumsum(size + 1) - size
    seen = np.zeros(0x110000, bool)
    seen[code] = True
    chars = np.flatnonzero(seen)
    lower = np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 0 for c in chars.tolist()])
    alphabet = np.unique(np.append(lower, 0))
    to = np.zeros(0x110000, np.int64)
    to[chars] = np.searchsorted(alphabet, lower)
    x, a = to[code], len(alphabet)
    middle = x > 0
    for s, n, b, f in zip(start[(before + after) > 0], size[(before + after) > 0], before[(before + after) > 0], after[(before + after) > 0], strict=True):
        middle[s : s + b] = middle[s + n - f : s + n] = False
    at = np.flatnonzero(middle)
    gram = (x[at - 1] * a + x[at]) * a + x[at + 1]
    owner = doc[np.searchsorted(start, at, "right") - 1]
    if a**3 <= 1 << 22:
        have = np.zeros(a**3, bool)
        have[gram] = True
        distinct = np.flatnonzero(have)
        number = np.zeros(a**3, np.int64)
        number[distinct] = np.arange(len(distinct))
        gram = number[gram]
    else:
        distinct, gram = np.unique(gram, return_inverse=True)
    return alphabet[np.stack([distinct // (a * a), distinct // a % a, distinct % a], 1)], owner, gram


def bound(grams: np.ndarray) -> np.ndarray:
    """The vectors of trigrams."""
    chars, back = np.unique(grams, return_inverse=True)
    v = np.stack([letter(c) for c in chars.tolist()])
    back = back.reshape(grams.shape)
    return np.roll(v, 2, 1)[back[:, 0]] * np.roll(v, 1, 1)[back[:, 1]] * v[back[:, 2]]


def bundled(texts: list[str], group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the trigram vectors of the texts of each group, in whole numbers, and how many trigrams there are."""
    out, many = np.zeros((groups, DIMENSIONS)), np.zeros(groups, np.int64)
    for own, doc, before, after in pieces(texts):
        grams, owner, gram = trigrams(own, doc, before, after)
        if not len(grams):
            continue
        owner = group[owner]
        many += np.bincount(owner, minlength=groups)
        order = np.argsort(owner, kind="stable")
        owner, gram = owner[order], gram[order]
        for g in range(0, len(grams), GRAMS):
            vectors = bound(grams[g : g + GRAMS])
            for lo in range(0, groups, TEXTS):
                a, b = np.searchsorted(owner, [lo, lo + TEXTS])
                inside = (gram[a:b] >= g) & (gram[a:b] < g + len(vectors))
                if inside.any():
                    high = int(owner[b - 1]) + 1
                    count = np.bincount((owner[a:b][inside] - lo) * len(vectors) + gram[a:b][inside] - g, minlength=(high - lo) * len(vectors))
                    out[lo:high] += count.reshape(high - lo, -1).astype(np.float32) @ vectors
    return out, many


def _texts(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    raw = data.tobytes()
    return [raw[i:j].decode("utf-8", "replace") for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _learn(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, part, sums of a task's texts."""
    total: dict[str, np.ndarray] = {}
    for batch in iterator:
        for first, data, offsets in slices(batch.column(0)):
            langs = batch.column(1).slice(first, len(offsets) - 1).to_pylist()
            names = sorted(set(langs))
            place = {x: k for k, x in enumerate(names)}
            sums, _ = bundled(_texts(data, offsets), np.array([place[x] for x in langs]), len(names))
            for name, s in zip(names, sums, strict=True):
                total[name] = total.get(name, 0) + s
    for name, s in total.items():
        n = DIMENSIONS // WIDE
        sums = pa.array(s.astype(np.int64).reshape(n, WIDE).tolist(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(range(n), pa.int32()), sums], ["lang", "part", "sums"])


def prototypes(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages by code point, and a unit vector of each, from text and lang of all rows of docs. What reaches the driver is a row of
    4 KB for each language."""
    known = docs.select(F.col("`text`").cast("string").alias("text"), F.col("`lang`").cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    parts = known.mapInArrow(_learn, "lang string, part int, sums array<long>")
    summed = parts.groupBy("lang", "part").agg(F.array(*(F.sum(F.col("sums")[i]) for i in range(WIDE))).alias("sums"))
    by: dict[str, np.ndarray] = {}
    for r in summed.collect():
        by.setdefault(r.lang, np.zeros((DIMENSIONS // WIDE, WIDE)))[r.part] = r.sums
    names = sorted(x for x, s in by.items() if s.any())
    p = np.stack([by[x].ravel() for x in names]) if names else np.zeros((0, DIMENSIONS))
    return names, p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)


def _guess(held):
    def run(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors = held.value
        for batch in iterator:
            for first, data, offsets in slices(batch.column(1)):
                n = len(offsets) - 1
                lang, score = np.full(n, UNKNOWN, object), np.zeros(n)
                if names:
                    own, many = bundled(_texts(data, offsets), np.arange(n), n)
                    cosine = own @ vectors.T / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
                    best = cosine.argmax(1)
                    some = many > 0
                    lang[some] = np.array(names, object)[best[some]]
                    score[some] = np.clip(cosine[np.arange(n), best][some], 0, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, learnt_from: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, for each document. Prototypes are of all rows of learnt_from (docs, if none) that are not
    held out. One pass to learn, one to judge; nothing is shuffled but sums."""
    seen = (docs if learnt_from is None else learnt_from).filter(~held_out(F.col("`doc_id`")))
    held = docs.sparkSession.sparkContext.broadcast(prototypes(seen))
    d = narrow(docs, "doc_id", "text").mapInArrow(_guess(held), f"{id_field(docs)}, lang_pred string, score double")
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
