"""Injected services called from tasks: embeddings with retries, and a chain of classifiers with breaker, limiter and fallback."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame


class Timeout(Exception):
    """A call that may be tried again."""


def with_retries(call: Callable, retries: int = 3, base: float = 1.0, cap: float = 15.0, sleep: Callable[[float], None] = time.sleep, draw: Callable[[float, float], float] = random.uniform):
    """The result of call; after a timeout it waits between 0 and a bound that doubles up to a cap (full jitter), then tries again.
    Other errors, and the last timeout, are raised."""
    for attempt in range(retries + 1):
        try:
            return call()
        except Timeout:
            if attempt == retries:
                raise
            sleep(draw(0.0, min(cap, base * 2**attempt)))


def embedded(texts: DataFrame, client: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 16, **options) -> DataFrame:
    """Adds embedding to rows with a content, in batches; one client for each task. Rows without content have none."""
    schema = f"{', '.join(f'`{n}` {t}' for n, t in texts.dtypes)}, embedding array<double>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = client()
        for f in frames:
            full = [i for i, c in enumerate(f["content"]) if c and c.strip()]
            vectors: list[list[float] | None] = [None] * len(f)
            for k in range(0, len(full), batch):
                own = full[k : k + batch]
                asked = [f["content"].iloc[i] for i in own]
                for i, v in zip(own, with_retries(lambda asked=asked: embed(asked), **options), strict=True):
                    vectors[i] = v
            yield f.assign(embedding=pd.Series(vectors, index=f.index, dtype=object))

    return texts.mapInPandas(run, schema)


@dataclass
class Guard:
    """What stands before one provider: it opens after failures in a row, tries again after a time, and lets requests through at a rate."""

    failures: int = 5
    seconds: float = 60.0
    rate: float = 1.0
    burst: float = 10.0
    count: int = field(default=0, init=False)
    since: float | None = field(default=None, init=False)
    left: float | None = field(default=None, init=False)
    at: float = field(default=0.0, init=False)

    def available(self, now: float) -> bool:
        return self.since is None or now - self.since > self.seconds

    def allowed(self, now: float) -> bool:
        self.left = self.burst if self.left is None else min(self.burst, self.left + (now - self.at) * self.rate)
        self.at = now
        if self.left < 1:
            return False
        self.left -= 1
        return True

    def done(self, ok: bool, now: float) -> None:
        if ok:
            self.count, self.since = 0, None
        else:
            self.count += 1
            if self.since is not None or self.count >= self.failures:
                self.since = now


#: A provider: (content, type now) to (type, confidence); it raises where it fails.
Provider = Callable[[str, str], tuple[str, float]]


def chain(providers: dict[str, Provider], guards: dict[str, Guard], content: str, kind: str, now: float, least: float = 0.7) -> tuple[str, float, str, list[str]]:
    """type, confidence, provider, and why others were passed over: providers are asked in order until one is confident enough."""
    passed = []
    for name, ask in providers.items():
        g = guards[name]
        if not g.available(now):
            passed.append(f"{name}:circuit_open")
            continue
        if not g.allowed(now):
            passed.append(f"{name}:rate_limited")
            continue
        try:
            got, confidence = ask(content, kind)
        except Exception:  # noqa: BLE001  (whatever an injected provider raises is a failure of it)
            g.done(False, now)
            passed.append(f"{name}:error")
            continue
        g.done(True, now)
        if confidence >= least:
            return got, confidence, name, passed
        passed.append(f"{name}:low_confidence")
    return kind, 1.0, "fallback", passed


def classified(rows: DataFrame, by: str, at: str, key: str, providers: Callable[[], dict[str, Provider]], guard: Callable[[], Guard] = Guard, least: float = 0.7) -> DataFrame:
    """key, type, confidence, provider, passed_over of rows (by, at, key, content, type). Each group is a caller of its own whose rows
    go through the chain in order of time, with guards of its own, so a group's size bounds a task, not the table's."""
    types = dict(rows.dtypes)
    schema = f"`{key}` {types[key]}, type string, confidence double, provider string, passed_over string"

    def run(f: pd.DataFrame) -> pd.DataFrame:
        own = providers()
        guards = {n: guard() for n in own}
        out = []
        for r in f.sort_values([at, key]).to_dict("records"):
            kind, confidence, name, passed = chain(own, guards, r["content"], r["type"], pd.Timestamp(r[at]).timestamp(), least)
            out.append((r[key], kind, confidence, name, ",".join(passed)))
        return pd.DataFrame(out, columns=[key, "type", "confidence", "provider", "passed_over"])

    return rows.groupBy(by).applyInPandas(run, schema)
