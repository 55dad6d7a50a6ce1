"""Generalised suffix automaton over sequences of integers, in flat arrays."""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Sequence


class SuffixAutomaton:
    """Recognises every run of symbols of every added sequence; two states at most for each symbol added.

    Most states have one way on, which stands in two arrays; the others of a state, if any, are in a small dict of its own.
    """

    def __init__(self) -> None:
        self.symbol, self.target = array("i", [-1]), array("i", [0])
        self.more: dict[int, dict[int, int]] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])

    def _get(self, state: int, c: int) -> int:
        """Where c leads from a state, or -1."""
        if self.symbol[state] == c:
            return self.target[state]
        m = self.more.get(state)
        return m.get(c, -1) if m is not None else -1

    def _set(self, state: int, c: int, to: int) -> None:
        if self.symbol[state] in (c, -1):
            self.symbol[state], self.target[state] = c, to
        else:
            self.more.setdefault(state, {})[c] = to

    def _new(self, link: int, length: int) -> int:
        self.symbol.append(-1)
        self.target.append(0)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def add(self, sequence: Iterable[int]) -> list[int]:
        """Adds a sequence of symbols from 0 up; returns the state of each of its prefixes as of now (later additions may split off
        shorter runs)."""
        last, path = 0, []
        for c in sequence:
            last = self._extend(last, c)
            path.append(last)
        return path

    def _clone(self, p: int, q: int, c: int) -> int:
        k = self._new(self.link[q], self.length[p] + 1)
        self.symbol[k], self.target[k] = self.symbol[q], self.target[q]
        if q in self.more:
            self.more[k] = dict(self.more[q])
        while p != -1 and self._get(p, c) == q:
            self._set(p, c, k)
            p = self.link[p]
        self.link[q] = k
        return k

    def _extend(self, last: int, c: int) -> int:
        q = self._get(last, c)
        if q >= 0:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, c)
        cur, p = self._new(0, self.length[last] + 1), last
        while p != -1 and self._get(p, c) < 0:
            self._set(p, c, cur)
            p = self.link[p]
        if p != -1:
            q = self._get(p, c)
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
        return cur

    def at_length(self, state: int, n: int) -> int:
        """The state of the last n symbols, for a state whose run has n symbols or more."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def matches(self, sequence: Sequence[int]) -> Iterable[tuple[int, int]]:
        """Matching statistics: for each place, the state and length of the longest known run that ends there."""
        symbol, target, more, link, length = self.symbol, self.target, self.more, self.link, self.length
        s = n = 0
        for c in sequence:
            while True:
                if symbol[s] == c and c >= 0:
                    s, n = target[s], n + 1
                    break
                m = more.get(s)
                if m is not None and c in m:
                    s, n = m[c], n + 1
                    break
                if not s:
                    n = 0
                    break
                s = link[s]
                n = length[s]
            yield s, n
