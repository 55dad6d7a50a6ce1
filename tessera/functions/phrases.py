"""Many phrases in one pass over a text: an automaton of all lists at once tells the first phrase of each list that a text holds."""

from __future__ import annotations

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Phrases:
    """Lists of phrases, each in the order in which they are tried."""

    def __init__(self, lists: dict[str, list[str]]) -> None:
        self.lists = lists
        places: dict[str, list[tuple[int, int]]] = {}
        for k, phrases in enumerate(lists.values()):
            for rank, p in enumerate(phrases):
                places.setdefault(p, []).append((k, rank))
        self.automaton = ahocorasick.Automaton()
        for p, at in places.items():
            self.automaton.add_word(p, tuple(at))
        self.automaton.make_automaton()

    def first(self, text: str) -> list[str | None]:
        """The phrase of each list that comes first in the list, of those that a text holds whatever its case."""
        best: list[int | None] = [None] * len(self.lists)
        for _, at in self.automaton.iter(text.lower()):
            for k, rank in at:
                if best[k] is None or rank < best[k]:
                    best[k] = rank
        return [None if rank is None else phrases[rank] for rank, phrases in zip(best, self.lists.values(), strict=True)]


def first_of_each(text: Column, lists: dict[str, list[str]]) -> Column:
    """A struct with the first phrase of each list; null where a text holds none, and for a null text."""
    phrases = Phrases(lists)

    def find(texts: pd.Series) -> pd.DataFrame:
        rows = [[None] * len(phrases.lists) if t is None else phrases.first(t) for t in texts]
        return pd.DataFrame(rows, columns=list(phrases.lists), dtype=object)

    find.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(find, ", ".join(f"{n} string" for n in lists))(text)
