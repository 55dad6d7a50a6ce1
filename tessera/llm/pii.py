"""Personal data by rules and a character-level bidirectional LSTM with CRF transitions, in numpy.

The rules find e-mail and IP addresses, card and phone numbers, in time linear in the text. The tagger is trained here, from labelled
spans: sentences made of common and invented words, such data in plain and disguised forms ("john at example dot com"), and harmless
look-alikes. It reads every character of every text, in overlapping windows. Where windows overlap, emissions are blended, and the
tags of the whole text are the best sequence under the transitions: one global decoding, split only where no span can gain anything
over staying outside, which loses nothing. Spans of the tagger that pass the kind's own tests and touch no
span of the rules are added; an address around an "@" is taken whole.

Of a text, some bytes a character are held beside it; emissions only for a group of windows and for the windows in doubt.

Defined cases: null and empty texts have no spans; equal texts have equal spans; repeated and null doc_ids are documents like any
other; an empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.columns import exists, id_field, narrow, shared_dir
from tessera.llm.tokens import slices

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match begins at a run's first digit: from a later one of the same run the rest is the same, and the rest decides.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def _part(s: str) -> bool:
    return len(s.lstrip("0")) <= 3 and int(s.lstrip("0") or 0) <= 255


def _emails(text: str) -> Iterator[Span]:
    upto = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > upto and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        upto = m.end() if m else at + 1  # a local part never holds "@"
        if m:
            yield "email", start, m.end()
        at = upto


def base(text: str) -> list[Span]:
    """Spans of the rules by start, then kind: leftmost, not overlapping within a kind; matches that fail a test are dropped."""
    out = list(_emails(text))
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_part, m.groups()))]
    out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{i}:{j}" for k, i, j in spans)


# The tagger. Classes of characters: each sign that matters its own, and the letters of "at" and "dot".
_SIGNS = "@.-+() _%/:,\n[]"
_LETTERS = "adot"
CLASSES = len(_SIGNS) + len(_LETTERS) + 6
_PAD = CLASSES - 1
_CLASS = np.full(256, len(_SIGNS) + len(_LETTERS) + 4, np.uint8)
for _c in range(128):
    _ch, _rest = chr(_c), len(_SIGNS) + len(_LETTERS)
    _CLASS[_c] = (_SIGNS + _LETTERS).index(_ch.lower()) if _ch in _SIGNS or _ch.lower() in _LETTERS else _rest + (0 if _ch.isdigit() else 1 if _ch.islower() else 2 if _ch.isupper() else 4)
_CLASS[128:] = len(_SIGNS) + len(_LETTERS) + 3
TAGS = 1 + 2 * len(KINDS)
#: Characters of a window, how far windows are apart, how many are read at once.
LENGTH, STRIDE, GROUP = 128, 108, 4096
#: Characters of a window in training; no less than those of a window read, whose later states would be new to the tagger.
TAUGHT = 128
#: States of each direction, and numbers that stand for a class of characters.
HIDDEN, EMBED = 16, 8
#: What is added to the gain of each place that quick states give, so that windows in doubt stay in doubt.
SLACK = 1.0
_ONE = 127 << 23  # the bits of 1.0
_PER = (1 << 23) / math.log(4)  # by how many bits half a unit of an exponent moves a float
_EVEN = 16  # steps between two looks at how far cells are out
_FAR = 1e4  # what it costs a span to leave its text: if gains make up for it, more is in doubt than need be


def classes(text: str) -> np.ndarray:
    return _CLASS[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 255)]


@dataclass
class Tagger:
    """emb of the classes; inp, rec, bias of both directions (gates in, forget, out, and the candidate); out, off of the emissions;
    moves between tags (last row: from the start). Gates are logistic, the candidate and the cell's output hyperbolic tangents."""

    p: dict[str, np.ndarray]

    def _run(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        n, steps = x.shape
        h, c, hs, kept = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32), np.zeros((n, steps, HIDDEN), np.float32), []
        half = np.repeat(np.float32([0.5, 1]), [3 * HIDDEN, HIDDEN])
        table = self.p["emb"] @ self.p["inp" + d] + self.p["bias" + d]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            s = np.tanh((table[x[:, t]] + h @ self.p["rec" + d]) * half)
            q = 0.5 + 0.5 * s[:, : 3 * HIDDEN]
            i, f, o, g = q[:, :HIDDEN], q[:, HIDDEN : 2 * HIDDEN], q[:, 2 * HIDDEN :], s[:, 3 * HIDDEN :]
            before, c = c, f * c + i * g
            tc = np.tanh(c)
            kept.append((t, h, i, f, o, g, before, tc))
            h = o * tc
            hs[:, t] = h
        return hs, kept

    def _read(self, xt: np.ndarray, d: str, weights: np.ndarray, out: np.ndarray, first: bool, quick: bool) -> None:
        """Adds the states of one direction, and a last one of 1, by weights (columns, states and 1) to out (steps, columns, windows).
        As _run(), with a state a row, every activation a logistic function, and input, states and the weights of the step before in
        one product. States and cells are halved. Quick activations take exp(v) as a(v / 2) / a(-v / 2), where a interpolates between
        powers of two, which is how floats are laid out: gates within 0.003 of the exact ones."""
        steps, n = xt.shape
        table = self.p["emb"] @ self.p["inp" + d] + self.p["bias" + d]
        quick = quick and float((np.abs(table).max(0) + np.abs(self.p["rec" + d]).sum(0)).max()) < 80  # no sum is further from 0
        w = np.concatenate([self.p["inp" + d], self.p["bias" + d][None], 2 * self.p["rec" + d]]).T * np.repeat([-1.0, -2.0], [3 * HIDDEN, HIDDEN])[:, None]
        if quick:
            w *= _PER
            w[:, EMBED] += _ONE
        w = np.concatenate([w, np.concatenate([np.zeros((len(weights), EMBED)), weights[:, HIDDEN:], 2 * weights[:, :HIDDEN]], 1)]).astype(np.float32)
        emb = np.ascontiguousarray(self.p["emb"].T, np.float32)
        u, every, c, a = np.zeros((EMBED + 1 + HIDDEN, n), np.float32), np.empty((len(w), n), np.float32), np.zeros((HIDDEN, n), np.float32), np.empty((HIDDEN, n), np.float32)
        z, before, sign, h = every[: 4 * HIDDEN], every[4 * HIDDEN :], u[:EMBED], u[EMBED + 1 :]
        i, f, o, g = z.reshape(4, HIDDEN, n)
        bits, bits_c = np.empty((2, *z.shape), np.int32), np.empty((2, *c.shape), np.int32)
        u[EMBED], last, out_far = 1, None, False
        for k, t in enumerate([*(range(steps) if d == "f" else range(steps - 1, -1, -1)), None]):
            if t is not None:
                np.take(emb, xt[t], 1, out=sign, mode="clip")
            np.dot(w, u, out=every)
            if last is not None:
                if first:
                    out[last] = before
                else:
                    out[last] += before
            if t is None:
                break
            last = t
            if quick:
                _quick(z, *bits)
            else:
                _exact(z)
            g -= 0.5
            g *= i
            c *= f
            c += g
            if quick:
                if k % _EVEN == 0:  # a step adds a half at most, and exponents hold up to 44
                    out_far = max(c.max(), -c.min()) > 43 - _EVEN / 2
                np.multiply(np.clip(c, -20, 20, out=a) if out_far else c, -4 * _PER, out=a)
                a += _ONE
                _quick(a, *bits_c)
            else:
                _exact(np.multiply(c, -4, out=a))
            a -= 0.5
            np.multiply(o, a, out=h)

    def projected(self, x: np.ndarray, weights: np.ndarray, quick: bool = False) -> np.ndarray:
        """(steps, columns, windows): the states of both directions by weights of (both, columns); a further row of weights is added."""
        xt = x.T.astype(np.intp, order="C")
        out, more = np.empty((len(xt), weights.shape[1], len(x)), np.float32), np.zeros((1, weights.shape[1]), np.float32)
        with np.errstate(over="ignore"):
            self._read(xt, "f", np.concatenate([weights[:HIDDEN], weights[2 * HIDDEN :] if len(weights) > 2 * HIDDEN else more]).T, out, True, quick)
            self._read(xt, "b", np.concatenate([weights[HIDDEN : 2 * HIDDEN], more]).T, out, False, quick)
        return out

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Emissions (windows, steps, tags) of windows of classes."""
        return self.projected(x, self.p["out"]).transpose(2, 0, 1) + self.p["off"].astype(np.float32)

    def _unroll(self, x: np.ndarray, d: str, dh: np.ndarray, kept: list, g_: dict[str, np.ndarray]) -> None:
        nh, nc = np.zeros_like(dh[:, 0]), np.zeros_like(dh[:, 0])
        table, classes_ = np.zeros((CLASSES, 4 * HIDDEN), dh.dtype), np.arange(CLASSES)[:, None]
        for t, h, i, f, o, g, before, tc in reversed(kept):
            h_ = dh[:, t] + nh
            c_ = nc + h_ * o * (1 - tc * tc)
            z = np.concatenate([c_ * g * i * (1 - i), c_ * before * f * (1 - f), h_ * tc * o * (1 - o), c_ * i * (1 - g * g)], 1)
            table += (classes_ == x[:, t]).astype(z.dtype) @ z
            g_["rec" + d] += h.T @ z
            nh, nc = z @ self.p["rec" + d].T, c_ * f
        g_["inp" + d] += self.p["emb"].T @ table
        g_["emb"] += table @ self.p["inp" + d].T
        g_["bias" + d] += table.sum(0)

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log-likelihood of tag sequences and its gradient."""
        n, steps = x.shape
        hf, kf = self._run(x, "f")
        hb, kb = self._run(x, "b")
        both = np.concatenate([hf, hb], 2)
        # products are taken step by step: small ones, whose sums do not depend on how many threads a BLAS uses
        e = np.stack([both[:, t] @ self.p["out"] for t in range(steps)], 1) + self.p["off"]
        moves, first = self.p["moves"][:TAGS], self.p["moves"][TAGS]
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = first + e[:, 0]
        for t in range(1, steps):
            alpha[:, t] = _lse(alpha[:, t - 1][:, :, None] + moves[None], 1) + e[:, t]
        for t in range(steps - 2, -1, -1):
            beta[:, t] = _lse(moves[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        z = _lse(alpha[:, -1], 1)
        marginal = np.exp(alpha + beta - z[:, None, None])
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        rows = np.arange(n)
        loss = z - first[y[:, 0]] - e[rows[:, None], np.arange(steps), y].sum(1) - moves[y[:, :-1], y[:, 1:]].sum(1)
        de = marginal.copy()
        de[rows[:, None], np.arange(steps), y] -= 1
        for t in range(1, steps):
            g["moves"][:TAGS] += np.exp(alpha[:, t - 1][:, :, None] + moves[None] + (e[:, t] + beta[:, t])[:, None, :] - z[:, None, None]).sum(0)
        np.add.at(g["moves"], (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
        g["moves"][TAGS] += de[:, 0].sum(0)
        g["out"] = sum(both[:, t].T @ de[:, t] for t in range(steps))
        g["off"] = de.sum((0, 1))
        dh = np.stack([de[:, t] @ self.p["out"].T for t in range(steps)], 1)
        self._unroll(x, "f", dh[:, :, :HIDDEN], kf, g)
        self._unroll(x, "b", dh[:, :, HIDDEN:], kb, g)
        return float(loss.mean()), {k: v / n for k, v in g.items()}

    def decode(self, e: np.ndarray, length: np.ndarray | None = None, inner: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """The best tags of (rows, steps, tags) emissions. Rows may be shorter than steps; inner rows come after an outside tag, and
        rows that are not last are followed by one."""
        moves, n, steps = self.p["moves"][:TAGS], len(e), e.shape[1]
        length = np.full(n, steps) if length is None else length
        start = np.repeat(self.p["moves"][TAGS:], n, 0)
        if inner is not None:
            start[inner] = moves[0]
        et = np.ascontiguousarray(e.transpose(1, 2, 0))
        best, back, end = start.T + et[0], np.zeros((steps, TAGS, n), np.int8), np.zeros((TAGS, n), np.float32)
        end[:, length == 1] = best[:, length == 1]
        now, free = np.empty_like(best), np.concatenate([[0], np.arange(1, TAGS, 2)])
        into, first, again = moves[:, free][:, :, None], moves[np.arange(1, TAGS, 2), np.arange(2, TAGS, 2)][:, None], moves[np.arange(2, TAGS, 2), np.arange(2, TAGS, 2)][:, None]
        for t in range(1, steps):
            s = best[:, None] + into
            back[t, free] = s.argmax(0)
            now[free] = s.max(0)
            one, two = best[1::2] + first, best[2::2] + again  # an inside tag follows its own kind alone
            back[t, 2::2] = np.arange(1, TAGS, 2)[:, None] + (two > one)
            np.maximum(one, two, out=now[2::2])
            now += et[t]
            best, now = now, best
            done = length == t + 1
            if done.any():
                end[:, done] = best[:, done]
        if last is not None:
            end[:, ~last] += moves[:, :1]
        out, tag, rows = np.zeros((n, steps), np.int64), end.argmax(0), np.arange(n)
        for t in range(steps - 1, -1, -1):
            live = length > t
            out[live, t] = tag[live]
            tag = np.where(live, back[t, tag, rows], tag)
        return out

    def gains(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """By how much, at most, transitions favour a span of each kind over outside tags in its place: from the start of a text, from
        any tag before it, from within it, and after it."""
        moves = self.p["moves"].astype(np.float32)
        first, inside = np.arange(1, TAGS, 2), np.arange(2, TAGS, 2)
        enter = (moves[:TAGS, first] - moves[:TAGS, :1]).max(0)
        go_on = np.maximum(moves[first, inside], moves[inside, inside]) - moves[0, 0]
        after = np.concatenate([[0], first])
        leave = np.maximum(moves[first][:, after], moves[inside][:, after]) - moves[0, after]
        return moves[TAGS, first] - moves[TAGS, 0], enter, go_on, np.maximum(0, leave.max(1))


def _exact(z: np.ndarray) -> None:
    """The logistic function, in place, of numbers that come negated."""
    np.exp(z, out=z)
    z += 1
    np.divide(1, z, out=z)


def _quick(z: np.ndarray, up: np.ndarray, down: np.ndarray) -> None:
    """The same of numbers that come as the bits of a(v / 2)."""
    np.copyto(up, z, casting="unsafe")
    np.subtract(np.int32(2 * _ONE), up, out=down)
    both, one = up.view(np.float32), down.view(np.float32)
    both += one
    np.divide(one, both, out=z)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.log(np.exp(x - m).sum(axis)) + m.squeeze(axis)


#: Words that stand around and inside look-alikes.
_COMMON = (
    "the of and to in a is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them "
    "then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after "
    "words called just where most know get through back much before go good new write our me man too any day same right look think also around another came come work three word must because does part even "
    "place well such here take why help put different away again off went old number great tell men say small every found still between name should home big give air line set own under read last never us "
    "left end along while might next sound below saw something thought both few those always show large often together asked house don't world going want dot com point dots meet order total price page version"
).split()


def _made(r: random.Random) -> tuple[str, str]:
    """A text of that kind, or harmless signs of kind ''."""
    digits = lambda n: "".join(r.choices("0123456789", k=n))
    invented = lambda lo, hi: "".join(r.choices(_ALPHABET, k=r.randrange(lo, hi)))
    word = lambda lo, hi: invented(lo, hi) if r.random() < 0.6 else r.choice(_COMMON).strip("'")
    one = lambda *forms: r.choice(forms)
    kind = one("email", "email", "ip", "card", "phone", "", "", "")
    if kind == "email":
        at, dot = one(*_AT)
        name = one(word(2, 9), f"{word(2, 7)}.{digits(2)}", f"{word(2, 7)}.{word(2, 9)}", f"{word(1, 5)}_{word(2, 6)}", f"{word(2, 9)}-{word(2, 9)}", f"{word(2, 6)}+{word(2, 5)}", word(2, 5).title(), f"{invented(6, 12)}.{invented(6, 14)}-{invented(4, 9)}", f"{invented(6, 12)}_{invented(10, 20)}")
        return "email", f"{name}{at}{word(2, 9)}{one('', '', '', digits(1), '-' + word(2, 5), invented(8, 18), dot + word(3, 8))}{dot}{one('com', 'org', f'example{dot}com', f'co{dot}uk', 'net', 'de', 'io')}"
    if kind == "ip":
        return "ip", one(".", ".", ".", " . ").join(str(r.randrange(1, 256)) for _ in range(4))
    if kind == "card":
        body = str(r.randrange(3, 7)) + digits(14)
        body += next(c for c in "0123456789" if luhn(body + c))
        return "card", one("", "", " ", "-", ".").join(body[k : k + 4] for k in range(0, 16, 4))
    if kind == "phone":
        a, b, c = digits(3), digits(3), digits(4)
        return "phone", one(f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1-{a}-{b}-{c}")
    n = r.randrange
    return "", one(
        f"{n(1, 30)}.{n(0, 10)}", f"{n(1900, 2100)}", digits(n(1, 7)), f"{n(1, 13)}/{n(1, 29)}/{n(1990, 2030)}", f"{n(1990, 2030)}-{digits(2)}-{digits(2)}",
        f"{digits(1)}.{digits(1)}.{digits(2)}", f"{n(1, 24)}:{digits(2)}", f"@{word(2, 6)}", f"{digits(2)}%", f"{digits(3)}-{digits(2)}-{digits(4)}", f"ssn {digits(3)}-{digits(2)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}-{digits(2)}",
        f"{digits(3)}-{digits(4)}", f"{word(3, 7)} at {word(3, 7)}", f"{word(3, 7)} at the {word(3, 7)}", f"{word(3, 7)} dot {word(3, 7)}", f"{word(3, 7)}.{one('com', 'org', 'py', 'txt')}", f"https://{word(3, 8)}.com/{word(3, 8)}", "".join(r.choices("0123456789abcdef", k=24)), f"({word(2, 9)})", f"[{digits(1)}]",
    )


_ALPHABET = "abcdefghijklmnopqrstuvwxyz"
#: How the two signs of an address are written.
_AT = [("@", "."), ("@", "."), (" @ ", "."), (" at ", " dot "), ("(at)", "."), (" (at) ", "."), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" AT ", " DOT "), ("@", " dot ")]


def sentence(r: random.Random, least: int) -> tuple[str, list[int]]:
    """A text of that many characters or more, and its tags."""
    parts, tags = [], []
    signed = r.choice(["", "", "", "###", "!!", "*", " |"])
    while len(tags) < least:
        if r.random() < 0.25:
            kind, piece = _made(r)
            k = KINDS.index(kind) if kind else -1
            tags += [0 if k < 0 else 1 + 2 * k + (j > 0) for j in range(len(piece))]
        else:
            piece = r.choice(_COMMON) if r.random() < 0.5 else "".join(r.choices(_ALPHABET + "éß", k=r.randrange(1, 12)))
            x = r.random()
            piece = (piece.title() if x < 0.15 else piece.upper() if x < 0.2 else piece) + r.choice(["", "", "", ",", ".", ":"]) + signed
            tags += [0] * len(piece)
        gap = r.choice([" ", " ", " ", "\n", ", ", ". "])
        parts += [piece, gap]
        tags += [0] * len(gap)
    return "".join(parts), tags


def labelled(r: random.Random, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of classes and of tags."""
    x, y = np.full((n, TAUGHT), _PAD), np.zeros((n, TAUGHT), np.int64)
    for row in range(n):
        text, tags = sentence(r, 2 * TAUGHT)
        at, m = r.randrange(len(text) - TAUGHT), TAUGHT if r.random() < 0.7 else r.randrange(12, TAUGHT)
        x[row, :m], y[row, :m] = classes(text)[at : at + m], tags[at : at + m]
    return x, y


@lru_cache(4)
def train(steps: int = 680, batch: int = 48, seed: int = 13, fast: float = 0.03) -> Tagger:
    """Adam on fresh labelled windows; the same model on every run, trained once in a process."""
    rng, made = np.random.default_rng(seed), random.Random(seed)
    small = lambda *shape: (rng.normal(0, 1, shape) * 0.25).astype(np.float32)
    bias = np.zeros(4 * HIDDEN, np.float32)
    bias[HIDDEN : 2 * HIDDEN] = 1
    p = {"emb": 4 * small(CLASSES, EMBED), "out": small(2 * HIDDEN, TAGS), "off": np.zeros(TAGS, np.float32), "moves": np.zeros((TAGS + 1, TAGS), np.float32)}
    for d in "fb":
        p |= {"inp" + d: small(EMBED, 4 * HIDDEN), "rec" + d: small(HIDDEN, 4 * HIDDEN), "bias" + d: bias.copy()}
    never = np.zeros_like(p["moves"], bool)
    for k in range(len(KINDS)):  # an inside tag only follows its own kind
        never[[t for t in range(TAGS + 1) if t not in (1 + 2 * k, 2 + 2 * k)], 2 + 2 * k] = True
    p["moves"][never] = -1e4
    tagger, m, v, mean = Tagger(p), *({k: np.zeros_like(a) for k, a in p.items()} for _ in range(3))
    late = int(steps * 0.7)  # the model is the mean over the last steps, which differ by chance
    for t in range(1, steps + 1):
        _, g = tagger.gradient(*labelled(made, batch))
        g["moves"][never] = 0
        size = sum(float((a * a).sum()) for a in g.values()) ** 0.5
        rate = fast * (1 - t / (steps + 1)) + 1e-3
        for k in p:
            a = g[k] * min(1, 5 / size)
            m[k], v[k] = 0.9 * m[k] + 0.1 * a, 0.99 * v[k] + 0.01 * a * a
            p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
            if t > late:
                mean[k] += p[k] / np.float32(steps - late)
    return Tagger(mean)


def stored(spark: SparkSession) -> Tagger:
    """The trained tagger, from a table in the shared folder that is named by a digest of this module's code: trained where there is
    none yet, and then written for the processes after this one."""
    code = hashlib.sha256(__loader__.get_data(__file__)).hexdigest()[:32]
    path = f"{shared_dir(spark, 'x').rsplit('/', 1)[0]}/pii-weights-{code}"
    if exists(spark, f"{path}/_SUCCESS"):
        rows = spark.read.schema(WEIGHTS).parquet(path).collect()  # a few arrays of some KB in all
        return Tagger({r.name: np.frombuffer(bytes(r.data), r.kind).reshape(r.shape).copy() for r in rows})
    tagger = train()
    rows = [(n, str(a.dtype), list(a.shape), a.tobytes()) for n, a in tagger.p.items()]
    spark.createDataFrame(rows, WEIGHTS).coalesce(1).write.mode("overwrite").parquet(path)
    return tagger


WEIGHTS = "name string, kind string, shape array<int>, data binary"


def _reach(text: str, at: int) -> tuple[int, int]:
    """Where an address around the "@" at that place can begin and end: blanks beside it, then the characters of its kind."""
    i, j = at, at + 1
    while i and text[i - 1] == " ":
        i -= 1
    while i and text[i - 1] in _LOCAL:
        i -= 1
    while j < len(text) and text[j] == " ":
        j += 1
    while j < len(text) and text[j] in _LOCAL:
        j += 1
    return i, j


_OVER = LENGTH - STRIDE
_RISE = (np.arange(1, _OVER + 1) / (_OVER + 1)).astype(np.float32)[:, None]


@dataclass
class _Windows:
    """Where the windows of some texts, one after the other, begin and end: start, end of the text, rank within it, whether the last,
    and how many places are its own: up to the next window, or to the end of the text."""

    start: np.ndarray
    end: np.ndarray
    rank: np.ndarray
    final: np.ndarray
    size: np.ndarray
    first: np.ndarray
    padded: np.ndarray

    @classmethod
    def of(cls, kinds: np.ndarray, bounds: np.ndarray) -> _Windows:
        size = np.diff(bounds)
        per = np.where(size > 0, np.maximum(1, -(-(size - _OVER) // STRIDE)), 0)
        text, first = np.repeat(np.arange(len(size)), per), np.cumsum(per) - per
        rank = np.arange(len(text)) - first[text]
        start, end, final = bounds[text] + rank * STRIDE, bounds[text + 1], rank == per[text] - 1
        return cls(start, end, rank, final, np.where(final, end - start, STRIDE), first, np.concatenate([kinds, np.full(LENGTH, _PAD, kinds.dtype)]))

    def read(self, own: np.ndarray) -> np.ndarray:
        """Classes of some windows."""
        x = np.lib.stride_tricks.sliding_window_view(self.padded, LENGTH)[self.start[own]]
        short = np.flatnonzero(self.start[own] + LENGTH > self.end[own])
        if len(short):
            x[short] = np.where(self.start[own][short][:, None] + np.arange(LENGTH) < self.end[own][short][:, None], x[short], _PAD)
        return x


def in_doubt(tagger: Tagger, w: _Windows, group: int = GROUP) -> np.ndarray:
    """Windows among whose own places the best tags may have some inside a span. All windows are read, a group at a time, by quick
    states; of each window and kind four numbers are kept: how much, with SLACK, a span could gain at most within it, from a place of it
    to its end, from its beginning to a place of it, and all through it. These add up along a text. A window is in doubt if some run of
    places that touches it could gain anything; no other holds a part of a span of the best tags, as leaving that out would be better."""
    begin, enter, go_on, leave = tagger.gains()
    out, off, kinds = tagger.p["out"].astype(np.float32), tagger.p["off"].astype(np.float32), len(KINDS)
    order = np.concatenate([np.arange(1, TAGS, 2), np.arange(2, TAGS, 2)])
    lead = np.concatenate([out[:, order] - out[:, :1], (off[order] - off[0] + np.float32(SLACK) + np.concatenate([enter, go_on]))[None]])
    within, end, start, through = np.empty((4, kinds, len(w.start)), np.float32)
    tail = np.zeros((_OVER, 2 * kinds, 1), np.float32)
    for at in range(0, len(w.start), group):
        own = slice(at, at + group)
        f = tagger.projected(w.read(own), lead, quick=True)
        before = np.concatenate([tail, f[STRIDE:, :, :-1]], 2)
        tail = f[STRIDE:, :, -1:].copy()
        first, size = w.rank[own] == 0, w.size[own]
        rise = np.where(first, np.float32(1), _RISE[:, :, None])  # a text's first window has none before it
        f[:_OVER] = f[:_OVER] * rise + before * (1 - rise)
        f[0, :kinds] += np.where(first, (begin - enter)[:, None], np.float32(0))
        _unowned(f[STRIDE:], STRIDE, size)
        short = np.flatnonzero(size < STRIDE)
        part = f[:STRIDE, :, short]
        _unowned(part, 0, size[short])
        f[:STRIDE, :, short] = part
        (most, now), (reached, total) = np.full((2, kinds, len(size)), -1e9, np.float32), np.zeros((2, kinds, len(size)), np.float32)
        for entry, further in zip(f[:, :kinds], f[:, kinds:], strict=True):
            total += further
            np.maximum(reached, total, out=reached)
            now += further
            np.maximum(now, entry, out=now)
            np.maximum(most, now, out=most)
        within[:, own], end[:, own], start[:, own], through[:, own] = most, now, reached, total
    first = w.rank == 0
    out_of = np.cumsum(through - _FAR * first, axis=1, dtype=np.float64)
    into = np.cumsum(through - _FAR * w.final, axis=1, dtype=np.float64)
    before = np.roll(out_of + np.maximum.accumulate(end - out_of, axis=1), 1, axis=1)  # to the end of the window before
    before[:, first] = -_FAR
    into = np.concatenate([np.zeros((kinds, 1)), into[:, :-1]], 1)
    after = np.roll(np.maximum.accumulate((start + into)[:, ::-1], axis=1)[:, ::-1] - into, -1, axis=1)  # from the beginning of the one after
    after[:, w.final] = 0
    best = np.maximum(np.maximum(within, before + start), np.maximum(end, before + through) + after)
    return np.flatnonzero((best + leave[:, None] >= -1e-2).any(0))


def _unowned(f: np.ndarray, at: int, size: np.ndarray) -> None:
    """No span begins in steps of f, from that one on, that are beyond a window's own, and none gains or loses there."""
    other = (np.arange(at, at + len(f))[:, None] >= size)[:, None]
    np.copyto(f[:, : len(KINDS)], -1e9, where=other)
    np.copyto(f[:, len(KINDS) :], 0, where=other)


def able(tagger: Tagger, e: np.ndarray, place: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Which places the best tags may have inside a span, of all places of the windows in doubt, by their emissions: some run of places
    around it could gain anything. begins: those with which a text begins."""
    begin, enter, go_on, leave = tagger.gains()
    lead = (e[:, 1:] - e[:, :1]).T
    entry, further = lead[::2] + enter[:, None], lead[1::2] + go_on[:, None]
    entry[:, begins] += (begin - enter)[:, None]
    apart = begins.copy()
    apart[1:] |= np.diff(place) > 1
    u = np.cumsum(further - _FAR * apart, axis=1, dtype=np.float64)
    upto = u + np.maximum.accumulate(entry - u, axis=1)
    after = np.maximum.accumulate(u[:, ::-1], axis=1)[:, ::-1] - u + leave[:, None]
    return (upto + after >= -1e-2).any(0)


def _emitted(tagger: Tagger, w: _Windows, doubt: np.ndarray, group: int = GROUP // 2) -> np.ndarray:
    """Exact emissions of the own places of windows in doubt, one after the other."""
    parts = [np.zeros((0, TAGS), np.float32)]
    for g in range(0, len(doubt), group):
        own = doubt[g : g + group]
        later = np.flatnonzero(w.rank[own] > 0)
        wanted = np.unique(np.concatenate([own, own[later] - 1]))
        every = tagger.emissions(w.read(wanted))
        e, before = every[np.searchsorted(wanted, own)], every[np.searchsorted(wanted, own[later] - 1), STRIDE:]
        e[later, :_OVER] = e[later, :_OVER] * _RISE + before * (1 - _RISE)
        parts.append(e[np.arange(LENGTH) < w.size[own, None]])
    return np.concatenate(parts)


def tags(tagger: Tagger, kinds: np.ndarray, bounds: np.ndarray, most: int = 1 << 19) -> Iterable[tuple[int, np.ndarray]]:
    """(place, tags) of the runs in doubt that hold spans. Runs of like length are decoded together."""
    w = _Windows.of(kinds, bounds)
    doubt = in_doubt(tagger, w)
    size = w.size[doubt]
    place = np.repeat(w.start[doubt] - np.cumsum(size) + size, size) + np.arange(size.sum())
    text = np.searchsorted(bounds, place, "right") - 1
    e = _emitted(tagger, w, doubt)
    kept = able(tagger, e, place, bounds[text] == place)
    place, text, e = place[kept], text[kept], e[kept]
    if not len(place):
        return []
    cuts = np.flatnonzero((np.diff(place) > 1) | (np.diff(text) > 0)) + 1
    first, length = np.concatenate([[0], cuts]), np.diff(np.concatenate([[0], cuts, [len(place)]]))
    inner, last = place[first] > bounds[text[first]], place[first] + length == bounds[text[first] + 1]
    out, order, i = [], np.argsort(length, kind="stable"), 0
    while i < len(order):
        j = i + 1
        while j < len(order) and j - i < 1024 and length[order[j]] <= 2 * length[order[i]] + 8 and (j - i + 1) * length[order[j]] <= most:
            j += 1
        own, steps = order[i:j], int(length[order[j - 1]])
        at = np.minimum(first[own][:, None] + np.arange(steps), len(e) - 1)
        for k, t in zip(own, tagger.decode(e[at], length[own], inner[own], last[own]), strict=True):
            if t.any():
                out.append((int(place[first[k]]), t[: length[k]]))
        i = j
    return sorted(out, key=lambda x: x[0])


#: The two signs of an address, as they are or written out.
_AT_SIGN = re.compile(r"@|(?<![A-Za-z])at(?![A-Za-z])", re.IGNORECASE)
_DOT_SIGN = re.compile(r"\.|(?<![A-Za-z])dot(?![A-Za-z])", re.IGNORECASE)


def _plausible(kind: str, s: str) -> bool:
    """What the kind's numbers must obey, and an address must have; its form is the tagger's to judge."""
    n = len(_digits(s))
    if kind == "email":
        return "\n" not in s and _AT_SIGN.search(s) is not None and _DOT_SIGN.search(s) is not None
    if kind == "ip":
        parts = re.findall("[0-9]+", s)
        return len(parts) == 4 and all(map(_part, parts))
    if kind == "card":
        return 12 <= n <= 19 and luhn(_digits(s))
    return 9 <= n <= 15


def spans_of(found: np.ndarray, text: str, at: int, taken: list[tuple[int, int]]) -> list[Span]:
    """Spans of a run of tags that pass their kind's tests and touch nothing taken (sorted, apart from each other)."""
    out, i, n, upto = [], 0, len(found), 0
    while i < n:
        if found[i] == 0:
            i += 1
            continue
        k, j = (int(found[i]) - 1) // 2, i + 1
        while j < n and found[j] == 2 + 2 * k:
            j += 1
        a, b = at + i, at + j
        if KINDS[k] == "email" and text.count("@", a, b) == 1:
            start, end = _reach(text, text.index("@", a))
            a, b = min(a, start), max(b, end)
        while b > a and text[b - 1] in " .,-:\n":
            b -= 1
        while a < b and text[a] in " .,-:\n":
            a += 1
        place = bisect_right(taken, a, key=lambda s: s[1])
        if b > a >= upto and _plausible(KINDS[k], text[a:b]) and not (place < len(taken) and taken[place][0] < b):
            out.append((KINDS[k], a, b))
            upto = b
        i = j
    return out


def _taken(spans: list[Span]) -> list[tuple[int, int]]:
    """What spans cover, merged."""
    out: list[tuple[int, int]] = []
    for _, i, j in sorted(spans, key=lambda s: s[1]):
        if out and i < out[-1][1]:
            out[-1] = out[-1][0], max(j, out[-1][1])
        else:
            out.append((i, j))
    return out


def read(tagger: Tagger, data: np.ndarray, offsets: np.ndarray) -> tuple[list[list[Span]], list[list[Span]]]:
    """Spans of the rules, and those that the tagger adds, for each text of a slice."""
    n = len(offsets) - 1
    upto = np.concatenate([[0], np.cumsum(((data >= 48) & (data <= 57)) | (data == 64))])
    texts: dict[int, str] = {}
    text = lambda d: texts.get(d) or texts.setdefault(d, data[offsets[d] : offsets[d + 1]].tobytes().decode())
    rules: list[list[Span]] = [[] for _ in range(n)]
    added: list[list[Span]] = [[] for _ in range(n)]
    for d in np.flatnonzero(np.diff(upto[offsets])).tolist():  # every rule needs a digit or an "@"; the tagger reads all
        rules[d] = base(text(d))
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    taken: dict[int, list[tuple[int, int]]] = {}
    for place, found in tags(tagger, classes(data.tobytes().decode()), begins):
        d = int(np.searchsorted(begins, place, "right")) - 1
        own = taken.setdefault(d, _taken(rules[d]))
        new = spans_of(found, text(d), place - int(begins[d]), own)
        added[d] += new
        for _, i, j in new:
            insort(own, (i, j))
    return rules, added


SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


#: Bytes of results that a task keeps for texts that it meets again.
KNOWN = 1 << 25
_NOTHING = hashlib.sha256(b"").hexdigest()


def results(tagger: Tagger, texts: pa.Array, known: dict[bytes, tuple]) -> list[tuple]:
    """Counts of the rules' spans by kind, base_sha256 and spans of each text; one that is known, or came before, is not read again."""
    keys, fresh = [], {}
    for first, data, offsets in slices(texts, 1 << 62):
        raw, cuts = memoryview(data), offsets.tolist()
        for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False), first):
            keys.append(hashlib.sha256(raw[i:j]).digest())
            if keys[-1] not in known:
                fresh.setdefault(keys[-1], k)
    for first, data, offsets in slices(texts.take(pa.array(fresh.values(), pa.int64()))):
        names = list(fresh)[first : first + len(offsets) - 1]
        for key, rules, added in zip(names, *read(tagger, data, offsets), strict=True):
            every = written(sorted(rules + added, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))
            digest = hashlib.sha256(written(rules).encode()).hexdigest() if rules else _NOTHING
            known[key] = *(sum(s[0] == k for s in rules) for k in KINDS), digest, every
    return [known[k] for k in keys]


def find(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """doc_id, counts of the rules' spans by kind, base_sha256, spans (kind:start:end, all of them), for each document."""
    held = docs.sparkSession.sparkContext.broadcast(tagger or stored(docs.sparkSession))
    names, types = zip(*(x.split() for x in SCHEMA.split(", ")), strict=True)

    def run(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple] = {}
        for batch in iterator:
            found = results(held.value, batch.column(1), known)
            columns = zip(*found, strict=True) if found else [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64() if t == "long" else pa.string()) for x, t in zip(columns, types, strict=True))], ["doc_id", *names])
            if sum(500 + len(r[-1]) for r in known.values()) > KNOWN:
                known.clear()

    return narrow(docs, "doc_id", "text").mapInArrow(run, f"{id_field(docs)}, {SCHEMA}")
