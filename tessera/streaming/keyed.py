"""Keyed state with values, maps and timers of its own: what a session has edited and been given, forgotten after silence.

State is kept in the store of the stream, not in memory, so the number of sessions needs no cap; a session's timer stands a time
after its last event and clears what it holds. Events of a batch are taken in order of their time, whatever order they come in; an
event after a longer silence finds its session forgotten even where the timer has not fired yet.

Defined cases: null times are left out; events of equal time go by their file or point, then kind; an event that is later than the
watermark allows is dropped by Spark before it is seen; an empty batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HOUR = 3_600_000
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession):
    """The state store that state with maps and timers needs, for streams that are started within."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


class _Session(StatefulProcessor):
    """The last event of a session, and the timer that stands a time after it."""

    def __init__(self, hours: float) -> None:
        self.silence = int(hours * HOUR)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def forget(self) -> None:
        raise NotImplementedError

    def _seen(self, at: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.last.update((at,))
        self.handle.registerTimer(at + self.silence + 1)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.forget()
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


class _Edits(_Session):
    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.files = handle.getMapState("files", "file_path string", "at long")

    def forget(self) -> None:
        self.files.clear()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(rows)).sort_values(["at", "file_path"], kind="stable")
        last = self.last.get()[0] if self.last.exists() else None
        known = {k[0] for k in self.files.keys()}
        out, new = [], {}
        for at, path in zip(f["at"].tolist(), f["file_path"].tolist(), strict=True):
            if last is not None and at - last > self.silence:
                self.forget()
                known, new = set(), {}
            if path not in known:
                known.add(path)
                new[path] = at
                out.append((key[0], path, at))
            last = at if last is None else max(last, at)
        for path, at in new.items():
            self.files.updateValue((path,), (at,))
        self._seen(int(last))
        yield pd.DataFrame(out, columns=["session_id", "file_path", "at"])


def first_edits(edits: DataFrame, hours: float = 24, late: str = "1 hour") -> DataFrame:
    """session_id, file_path, at (ms): the first edit of each file since the session began or was forgotten. edits: session_id,
    file_path, event_time. A session that is silent for so many hours of event time is forgotten."""
    e = edits.filter("event_time IS NOT NULL").withWatermark("event_time", late).withColumn("at", F.unix_millis("event_time"))
    return e.groupBy("session_id").transformWithStateInPandas(_Edits(hours), "session_id string, file_path string, at long", "Append", "EventTime")


class _Injections(_Session):
    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.ids = handle.getMapState("ids", "point_id string", "at long")
        self.totals = handle.getValueState("totals", "tokens long, turns int, compactions int, drift double")
        self.vector = handle.getValueState("vector", "query array<double>")

    def forget(self) -> None:
        self.ids.clear()
        self.totals.clear()
        self.vector.clear()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(rows)).sort_values(["at", "order"], kind="stable")
        last = self.last.get()[0] if self.last.exists() else None
        ids = {k[0]: None for k in self.ids.keys()}
        tokens, turns, compactions, drift = self.totals.get() if self.totals.exists() else (0, 0, 0, 0.5)
        before = list(self.vector.get()[0]) if self.vector.exists() else None
        new: dict[str, int] = {}
        for r in f.itertuples(index=False):
            if last is not None and r.at - last > self.silence:
                self.forget()
                ids, new, tokens, turns, compactions, drift, before = {}, {}, 0, 0, 0, 0.5, None
            if r.kind == "compact":
                self.ids.clear()
                ids, new, compactions = {}, {}, compactions + 1
            elif r.kind == "query":
                turns, now = turns + 1, None if r.query is None else [float(x) for x in r.query]
                drift, before = parted(before, now), now
            elif r.point_id not in ids:
                ids[r.point_id] = None
                new[r.point_id] = r.at
                tokens += int(r.tokens)
            last = r.at if last is None else max(last, r.at)
        for point, at in new.items():
            self.ids.updateValue((point,), (int(at),))
        self.totals.update((int(tokens), int(turns), int(compactions), float(drift)))
        if before is None:
            self.vector.clear()
        else:
            self.vector.update((before,))
        self._seen(int(last))
        yield pd.DataFrame([(key[0], len(ids), tokens, turns, compactions, drift)], columns=["session_id", "injected", "tokens", "turns", "compactions", "drift"])


def parted(before: list[float] | None, now: list[float] | None) -> float:
    """1 - cosine in 0..1; 0.5 where there is nothing to compare."""
    if before is None or now is None or not (n := float(np.linalg.norm(before) * np.linalg.norm(now))):
        return 0.5
    return min(1.0, max(0.0, 1 - float(np.dot(before, now)) / n))


SESSION = "session_id string, injected int, tokens long, turns int, compactions int, drift double"


def sessions(events: DataFrame, hours: float = 24, late: str = "1 hour") -> DataFrame:
    """The state of each session after each batch that it has events in: points given since the last compaction (each once), tokens
    and turns since it began, compactions, and how far the last question is from the one before.

    events: session_id, event_time, kind (inject: point_id, tokens; query: query, a vector; compact), order (of events of equal time).
    """
    e = events.filter("event_time IS NOT NULL").withWatermark("event_time", late).withColumn("at", F.unix_millis("event_time"))
    return e.groupBy("session_id").transformWithStateInPandas(_Injections(hours), SESSION, "Update", "EventTime")
