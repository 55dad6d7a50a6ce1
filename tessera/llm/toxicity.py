"""Toxicity by a support vector machine over a gapped subsequence string kernel, with Nyström landmarks.

A unit is a token's letters: signs inside it are dropped or read as the letters they stand for, runs of single letters become one
unit, and long units are taken in overlapping windows, so "s-t-u-p-i-d", "s t u p i d" and "stu*pid" are near "stupid". Two short
neighbours are also a unit, with a sign that is no letter between them: so "stu pid" is near "stupid", and an insult of several words
is told by its pairs where its words alone tell nothing. The kernel counts the subsequences of two and three letters that two units
share, each weighted by a decay for every letter it spans.

Training takes labelled sentences, each counted once. A label is of a document, so which units make it toxic is learnt: those that
toxic documents hold more often than chance allows (a test corrected for the number of units). Each is a positive with a margin that
grows with its odds; units that no clean text holds are also learnt with a letter put in at every inner place, as positives and
landmarks of their own, so that "stuxpid" and "stu-xpid" count. Clean units are the other side, those that score highest added with
each round. Landmarks span the Nyström features; the machine is linear in them, and its weights fold into one table over
subsequences, which gives the same decision without comparing to landmarks again.

A document's evidence is its highest decision, the sum of what lies above 0 over its units, and its length; a logistic fit on the
labelled documents maps it to 0..1.

Defined cases: null, empty and letterless texts have the score of a text without units (0 evidence); a table without labels, or with
one label alone, gives everyone the score 0; where no unit tells the labels apart, everyone has the share of toxic rows; an empty
table gives an empty result; equal texts score alike; extra columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.columns import id_field, narrow
from tessera.llm.labelled import held_out, sample
from tessera.llm.tokens import NON_SPACE, cut_words, hash_runs, slices

#: Letters of one comparison, and how far windows of a longer unit are apart.
LONGEST, STEP = 24, 12
#: Letters of two neighbours that are taken together, at least and at most.
PAIRED = (4, 14)
#: Pairs that training looks at: those of so many texts at least, and of the others one in so many by hash, as clean examples.
PAIR_TEXTS, PAIR_SHARE = 3, 16
#: Letters that a subsequence may span, and the weight of each spanned.
SPAN, DECAY = 8, 0.6
LANDMARKS = 600
#: Units that a task remembers.
REMEMBERED = 1_000_000
#: Evidence of a text without units.
NOTHING = -3.0
#: Numbers that describe a text.
EVIDENCE = 5

LETTER = np.full(256, 255, np.uint8)
LETTER[97:123] = np.arange(26)
LETTER[65:91] = np.arange(26)
LETTER[128:] = 26
for _sign, _letter in {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}.items():
    LETTER[ord(_sign)] = 64 + ord(_letter) - 97  # read so only between letters
#: Letters, all others as one, and the edge of a unit.
KINDS, EDGE, SIGN = 28, 27, 26
PAIRS, TRIPLES = KINDS**2, KINDS**3


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """letters, and start, end, document of each unit of a slice."""
    w = cut_words(0, data, offsets, NON_SPACE, hashed=False)
    code = LETTER[data]
    plain = code < 32
    between = np.zeros(len(code), bool)
    if len(code) > 2:
        between[1:-1] = plain[:-2] & plain[2:]
    keep = plain | (between & (code < 128))
    upto = np.concatenate([[0], np.cumsum(keep)])
    letters = (code & 63)[keep]
    start, end = upto[w.start], upto[w.end]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(w.bounds))
    full = end > start
    start, end, doc = start[full], end[full], doc[full]
    lone = end - start == 1
    if lone.any():  # a run of single letters is a unit: its first token takes the last one's end
        begins = lone & ~np.concatenate([[False], lone[:-1] & (doc[1:] == doc[:-1])])
        last = lone & ~np.concatenate([lone[1:] & (doc[1:] == doc[:-1]), [False]])
        end[begins] = end[last]
        stay = ~lone | begins
        start, end, doc = start[stay], end[stay], doc[stay]
    long = np.flatnonzero(end - start > LONGEST)
    if len(long):
        many = -(-(end[long] - start[long] - LONGEST) // STEP)
        k = np.concatenate([np.arange(1, n + 1) for n in many])
        more = np.repeat(start[long], many) + k * STEP
        start, end, doc = np.concatenate([start, more]), np.concatenate([np.minimum(end, start + LONGEST), np.minimum(np.repeat(end[long], many), more + LONGEST)]), np.concatenate([doc, np.repeat(doc[long], many)])
    return letters, start, end, doc


def with_pairs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """As units(), with pairs of neighbours after them; and how many are no pairs."""
    letters, start, end, doc = units(data, offsets)
    plain = len(start)
    order = np.argsort(start, kind="stable")  # windows of a long unit are too long to be paired
    s, e, d = start[order], end[order], doc[order]
    size = e - s
    both = size[:-1] + size[1:]
    at = np.flatnonzero((d[:-1] == d[1:]) & (both >= PAIRED[0]) & (both <= PAIRED[1]) & (e[:-1] <= s[1:])) if plain > 1 else np.zeros(0, np.int64)
    if not len(at):
        return letters, start, end, doc, plain
    n = both[at] + 1
    begin = len(letters) + np.cumsum(n) - n
    step, own = np.arange(int(n.sum())) - np.repeat(begin - len(letters), n), np.repeat(np.arange(len(at)), n)
    first = size[at][own]
    source = np.where(step < first, s[at][own] + step, s[at + 1][own] + step - first - 1)
    more = np.where(step == first, SIGN, letters[np.minimum(source, len(letters) - 1)]).astype(letters.dtype)
    return np.concatenate([letters, more]), np.concatenate([start, begin]), np.concatenate([end, begin + n]), np.concatenate([doc, d[at]]), plain


def _places(n: int) -> list[tuple[tuple[int, ...], float]]:
    """Places of the subsequences of two and three letters in n letters, and their weights."""
    out = []
    for i in range(n):
        for j in range(i + 1, min(n, i + SPAN)):
            out.append(((i, j), DECAY ** (j - i + 1)))
            out += [((i, j, k), DECAY ** (k - i + 1)) for k in range(j + 1, min(n, i + SPAN))]
    return out


PLACES = {n: _places(n) for n in range(4, LONGEST + 3)}
#: What a unit of n letters is divided by: its length in kernel space, were all its subsequences distinct.
NORM = {n: sum(w * w for _, w in p) ** 0.5 for n, p in PLACES.items()}


def _codes(u: np.ndarray, at: tuple[int, ...]) -> np.ndarray:
    x = u[:, at[0]] * KINDS + u[:, at[1]]
    return x if len(at) == 2 else PAIRS + x * KINDS + u[:, at[2]]


def apply_table(table: np.ndarray, letters: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The sum of a table's entries over each unit's subsequences. Table rows may be numbers or vectors."""
    out = np.zeros((len(start), *table.shape[1:]), np.float32)
    size = end - start
    for n in np.unique(size):
        if n < 2:
            continue
        own = np.flatnonzero(size == n)
        u = np.full((len(own), n + 2), EDGE, np.int32)
        u[:, 1:-1] = letters[start[own][:, None] + np.arange(n)]
        acc = np.zeros((len(own), *table.shape[1:]), np.float32)
        for at, weight in PLACES[int(n) + 2]:
            acc += np.float32(weight) * table[_codes(u, at)]
        out[own] = acc / np.float32(NORM[int(n) + 2])
    return out


def embed(strings: list[bytes]) -> np.ndarray:
    """Units in kernel space; for landmarks alone, which are few."""
    out = np.zeros((len(strings), PAIRS + TRIPLES), np.float32)
    for row, s in zip(out, strings, strict=True):
        u = np.array([[EDGE, *s, EDGE]], np.int32)
        if u.shape[1] >= 4:
            for at, weight in PLACES[u.shape[1]]:
                row[_codes(u, at)[0]] += weight / NORM[u.shape[1]]
    return out


def _flat(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum([len(s) for s in strings], dtype=np.int64)
    return np.frombuffer(b"".join(strings), np.uint8), np.concatenate([[0], ends[:-1]])[: len(ends)].astype(np.int64), ends


@dataclass
class Machine:
    """The folded table over subsequences, its offset, and the logistic map of a text's evidence."""

    table: np.ndarray
    bias: float
    weights: np.ndarray
    shift: float
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    def decide(self, letters: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return apply_table(self.table, letters, start, end) + self.bias

    def score(self, evidence: np.ndarray) -> np.ndarray:
        x = evidence if self.low is None else np.clip(evidence, self.low, self.high)  # no further than what was seen in training
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.shift, -40, 40)))


def _sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?])\s|\n", text) if s.strip()]


def _novel(rows: list[tuple[str, int]]) -> list[str]:
    """What each text says that no earlier one did, and, of toxic texts, no clean one: copies and near copies add nothing."""
    clean, seen, out = {hash(x) for t, y in rows if not y for x in _sentences(t)}, set(), []
    for text, y in rows:
        own = [x for x in _sentences(text) if (h := hash(x)) not in seen and not (y and h in clean)]
        seen.update(map(hash, own))
        out.append("\n".join(own))
    return out


@dataclass
class Bags:
    """The distinct units of some texts, and which text holds which: pairs (doc, unit), sorted."""

    strings: list[bytes]
    doc: np.ndarray
    unit: np.ndarray


def bags(texts: list[str]) -> Bags:
    hashes, docs, kinds, at = [], [], [], 0
    column = pa.array(texts, pa.string())
    for _, data, offsets in slices(column):
        letters, start, end, doc, plain = with_pairs(data, offsets)
        pairs, first = np.unique(np.stack([doc.astype(np.uint64) + np.uint64(at), hash_runs(letters, start, end)]), axis=1, return_index=True)
        docs.append(pairs[0].astype(np.int64))
        hashes.append(pairs[1])
        kinds.append(first < plain)
        at += len(offsets) - 1
    every, single = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((hashes, np.uint64), (kinds, bool)))
    own, back, count = np.unique(every, return_inverse=True, return_counts=True)
    keep = (count >= PAIR_TEXTS) | (own % np.uint64(PAIR_SHARE) == 0)
    keep[back[single]] = True
    own, names = own[keep], {}
    for _, data, offsets in slices(column):
        letters, start, end, _, _ = with_pairs(data, offsets)
        found, first = np.unique(hash_runs(letters, start, end), return_index=True)
        raw = letters.tobytes()
        new = np.isin(found, own)
        for k, i in zip(found[new].tolist(), first[new].tolist(), strict=True):
            if k not in names:
                names[k] = raw[start[i] : end[i]]
    order = sorted(names, key=names.__getitem__)
    place = np.array(order, np.uint64)
    by = np.argsort(place)
    stay = keep[back] if len(every) else np.zeros(0, bool)
    unit = by[np.searchsorted(place[by], every[stay])] if len(order) else np.zeros(0, np.int64)
    return Bags([names[k] for k in order], np.concatenate(docs)[stay] if docs else np.zeros(0, np.int64), unit)


def _tail(k: int, n: int, p: float) -> float:
    """Log of a bound (Chernoff) on the chance of k or more of n at rate p."""
    q = k / n
    return 0.0 if q <= p else -n * (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0.0))


def insults(b: Bags, y: np.ndarray) -> dict[int, float]:
    """Units that toxic texts hold more often than chance allows, and the log of their odds.

    That chance times the number of units must stay below 1 in 20, so the test is as strict for any number of units and texts.
    """
    n, rate = len(b.strings), float(y.mean())
    toxic, clean = (np.bincount(b.unit[y[b.doc] == k], minlength=n) for k in (1, 0))
    some = np.flatnonzero(toxic * (1 - rate) > clean * rate)
    limit, prior = math.log(0.05 / n) if n else 0.0, math.log((1 - rate) / rate)
    return {u: math.log((toxic[u] + 0.5) / (clean[u] + 0.5)) + prior for u in some.tolist() if _tail(int(toxic[u]), int(toxic[u] + clean[u]), rate) < limit}


def disguised(unit: bytes, rng: np.random.Generator, letters: int = 6) -> list[bytes]:
    """The unit with one letter put in at each inner place: doubled, and some at random; and split there."""
    out = []
    for k in range(1, len(unit)):
        out += [unit[:k] + bytes([x]) + unit[k:] for x in {unit[k - 1], SIGN, *rng.integers(0, 26, letters).tolist()}]
    return sorted(set(out))


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 30, l2: float = 1e-5) -> tuple[np.ndarray, float]:
    """Squared hinge by Newton steps over the violated margins, each its own target's size; the last entry is the offset."""
    x = np.hstack([z, np.ones((len(z), 1), z.dtype)]).astype(np.float64)
    c, ridge = weight / weight.sum(), l2 * np.diag(np.append(np.ones(z.shape[1]), 1e-6))
    w, active = np.zeros(x.shape[1]), np.ones(len(x), bool)
    for _ in range(steps):
        own = x[active] * c[active, None]
        w = np.linalg.solve(own.T @ x[active] + ridge, own.T @ y[active])
        now = np.sign(y) * (x @ w) < np.abs(y)
        if (now == active).all():
            break
        active = now
    return w[:-1], float(w[-1])


def fit(rows: list[tuple[str, int]], rounds: int = 5, seed: int = 4) -> Machine | None:
    """Learns from (text, label) rows. None without both labels; the base rate for everyone where no unit tells them apart."""
    rows = list(dict.fromkeys(rows))
    y = np.array([label for _, label in rows])
    if not len(y) or y.min() == y.max():
        return None
    b = bags(_novel(rows))
    known = insults(b, y)
    target = {b.strings[u]: min(2.0, 0.3 * odds) for u, odds in known.items() if len(b.strings[u]) >= 2}
    if not target:  # a single letter has no subsequences
        rate = float(y.mean())
        return Machine(np.zeros(PAIRS + TRIPLES, np.float32), 0.0, np.zeros(EVIDENCE), math.log(rate / (1 - rate)))
    rng = np.random.default_rng(seed)
    seen = np.bincount(b.unit[y[b.doc] == 0], minlength=len(b.strings))
    pure = [u for k in known if not seen[k] and len(u := b.strings[k]) >= 4 and SIGN not in u]  # no clean text holds them
    clean = [u for k, u in enumerate(b.strings) if seen[k] and len(u) >= 2 and u not in target]
    common = [u for k in np.argsort(-seen, kind="stable")[:300].tolist() if len(u := b.strings[k]) >= 2 and u not in target]
    hard = [clean[i] for i in rng.choice(len(clean), min(len(clean), 3000), replace=False)] if clean else []
    forms, held = {f: target[u] for u in pure for f in disguised(u, rng)}, set(clean)
    forms = {f: t for f, t in forms.items() if f not in target and f not in held}
    per_form = 4 * len(pure) / max(1, len(forms))
    flat_clean = _flat(clean)
    for step in range(rounds):
        plus, minus = [*target, *forms], sorted({*hard, *common}) or [b""]  # without clean units, what shares nothing with any
        marks = sorted(target, key=lambda u: (-target[u], u))[: LANDMARKS // 4]
        for pool, upto in ((sorted(forms), LANDMARKS // 2), (minus, LANDMARKS)):
            marks += pool[:: max(1, -(-len(pool) // max(1, upto - len(marks))))]
        phi = embed(marks)
        gram = np.zeros((len(marks), len(marks)))
        for i in range(0, phi.shape[1], 4096):
            part = phi[:, i : i + 4096].astype(np.float64)
            gram += part @ part.T
        values, vectors = np.linalg.eigh(gram)
        good = values > 1e-6 * values[-1]
        root = (vectors[:, good] / np.sqrt(values[good])).astype(np.float32)
        table, strings = np.ascontiguousarray(phi.T), plus + minus
        z = np.concatenate([apply_table(table, *_flat(strings[i : i + 1000])) @ root for i in range(0, len(strings), 1000)])
        labels = np.array([*target.values(), *forms.values(), *[-1.0] * len(minus)])
        weight = np.concatenate([np.ones(len(target)), np.full(len(forms), per_form), np.ones(len(minus))])
        weight[: len(plus)] *= max(1, len(minus)) / weight[: len(plus)].sum()
        w, bias = _svm(z, labels, weight)
        machine = Machine((phi.T @ (root @ w)).astype(np.float32), bias, np.zeros(EVIDENCE), 0.0)
        if step + 1 < rounds and clean:
            hard = sorted({*hard, *(clean[i] for i in np.argsort(-machine.decide(*flat_clean))[:800])})
    x = evidence([t for t, _ in rows], machine)
    machine.low, machine.high = x.min(0), x.max(0)
    machine.weights, machine.shift = _logistic(x, y.astype(float))
    return machine


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 100) -> tuple[np.ndarray, float]:
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), l2 * np.diag(np.append(np.ones(x.shape[1] - 1), 1e-3))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x / len(x) + ridge
        w -= np.clip(np.linalg.solve(h, x.T @ (p - y) / len(x) + ridge @ w), -2, 2)
    return w[:-1], float(w[-1])


class Known:
    """Decisions on units by hash, so that a task decides on each unit once."""

    def __init__(self, machine: Machine) -> None:
        self.machine, self.hashes, self.values = machine, np.zeros(0, np.uint64), np.zeros(0, np.float32)

    def decide(self, letters: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h, first, back = np.unique(hash_runs(letters, start, end), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, h), max(0, len(self.hashes) - 1))
        have = self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), bool)
        out = np.zeros(len(h), np.float32)
        out[have] = self.values[at[have]]
        new = np.flatnonzero(~have)
        out[new] = self.machine.decide(letters, start[first[new]], end[first[new]])
        if len(self.hashes) + len(new) > REMEMBERED:
            self.hashes, self.values = h, out
        else:
            hashes, values = np.concatenate([self.hashes, h[new]]), np.concatenate([self.values, out[new]])
            order = np.argsort(hashes, kind="stable")
            self.hashes, self.values = hashes[order], values[order]
        return out[back]

    def evidence(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text: its highest decision; its decisions above 0, and what is above 1, summed over distinct units; those
        above 0 over all units; its length."""
        n = len(offsets) - 1
        out = np.zeros((n, EVIDENCE))
        out[:, 0] = NOTHING
        letters, start, end, doc, plain = with_pairs(data, offsets)
        if len(start):
            f = self.decide(letters, start, end)
            np.maximum.at(out[:, 0], doc, f)
            hit = np.flatnonzero(f > 0)
            h = hash_runs(letters, start[hit], end[hit])
            order = np.lexsort((h, doc[hit]))
            hit, h = hit[order], h[order]
            first = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[hit][1:] != doc[hit][:-1])])[: len(hit)]
            out[:, 1] = np.log1p(np.bincount(doc[hit][first], f[hit][first], n))
            out[:, 2] = np.log1p(np.bincount(doc[hit][first], np.maximum(f[hit][first] - 1, 0), n))
            out[:, 3] = np.log1p(np.bincount(doc[hit], f[hit], n))
            out[:, 4] = np.log1p(np.bincount(doc[:plain], minlength=n))
        return out


def evidence(texts: list[str], machine: Machine) -> np.ndarray:
    known = Known(machine)
    return np.concatenate([known.evidence(d, o) for _, d, o in slices(pa.array(texts, pa.string()))])


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted (score of 0.5 or more), for each document. One pass over docs beside the sample."""
    held = docs.sparkSession.sparkContext.broadcast(fit(sample(docs, labels, label)))

    def run(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = held.value
        known = Known(machine) if machine else None
        for batch in iterator:
            for first, data, offsets in slices(batch.column(1)):
                part = batch.slice(first, len(offsets) - 1)
                p = machine.score(known.evidence(data, offsets)) if known else np.zeros(len(part))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    d = narrow(docs, "doc_id", "text").mapInArrow(run, f"{id_field(docs)}, score double")
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
