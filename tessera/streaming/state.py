"""Stateful operators: micro-batches with Structured Streaming, and the same state machines stepping through ordered events."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import wait as wait_for

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.versions import updated


def stepped(events: DataFrame, by: list[str], at: str, value: str, begin: Callable[[], tuple], step: Callable[[tuple, float, object], tuple[tuple, tuple]], said: str) -> DataFrame:
    """by, n (the place of an event within its key, from 0) and what step says of each event (columns said), by time and then by the
    other columns. step takes the state, the time in seconds and the value, and gives the next state and a row.

    Events stream past in order and only one state is held, so a key may have any number of them, at a cost in proportion.
    """
    rest = [c for c in events.columns if c != at and c not in by]
    ordered = events.repartition(*by).sortWithinPartitions(*by, at, *rest).select(*by, F.col(at).cast("double").alias("_at"), F.col(value).alias("_value"))
    schema = T.StructType([*(T.StructField(c, events.schema[c].dataType) for c in by), T.StructField("n", T.LongType()), *T.StructType.fromDDL(said).fields])
    names, kinds = schema.names, [to_arrow_type(f.dataType) for f in schema.fields[len(by) :]]

    def run(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, n = None, None, 0
        for b in iterator:
            keys, out = [b.column(i) for i in range(len(by))], []
            for key, now, x in zip(zip(*(k.to_pylist() for k in keys), strict=True), b.column(len(by)).to_pylist(), b.column(len(by) + 1).to_pylist(), strict=True):
                if key != last:
                    last, state, n = key, begin(), 0
                state, row = step(state, now, x)
                out.append((n, *row))
                n += 1
            if out:
                yield pa.RecordBatch.from_arrays([*keys, *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names)

    return ordered.mapInArrow(run, schema)


def bucket_steps(requests: DataFrame, by: list[str], at: str, tokens: str, rate: float = 1.0, burst: float = 10.0) -> DataFrame:
    """by, n, allowed, left of each request: refills by time passed, starts full; a request passes if enough tokens are there."""

    def step(state: tuple, now: float, asked: float) -> tuple[tuple, tuple]:
        left, before = state
        have = min(burst, left + (0.0 if now is None or before is None else now - before) * rate)
        ok = None if asked is None else have >= asked
        left = float(have - asked) if ok else have
        return (left, now), (ok, left)

    return stepped(requests, by, at, tokens, lambda: (burst, None), step, "allowed boolean, left double")


def token_bucket(requests: DataFrame, by: list[str], at: str, tokens: str, rate: float = 1.0, burst: float = 10.0) -> DataFrame:
    """by, allowed (flags in order), left in the end, by bucket_steps(), which has no array and so no bound on a key's requests."""
    return _in_order(bucket_steps(requests, by, at, tokens, rate, burst), by, "allowed", "left").withColumnRenamed("_all", "allowed").select(*by, "allowed", "left")


def _in_order(steps: DataFrame, by: list[str], each: str, last: str) -> DataFrame:
    """by, _all (values of each step in order), the last value of another column."""
    grouped = steps.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("n", each))).alias("_steps"), F.max_by(last, "n").alias(last))
    return grouped.withColumn("_all", F.transform("_steps", lambda x: x[each])).drop("_steps")


def circuit_steps(calls: DataFrame, by: list[str], at: str, ok: str, failures: int = 5, seconds: float = 60.0, probes: int = 3) -> DataFrame:
    """by, n, met (the state that a call met), state (the one after it): opens after failures in a row, tries again after a time,
    closes on a success."""

    def step(state: tuple, now: float, good: bool) -> tuple[tuple, tuple]:
        s, n, since, tried = state
        met = s
        if s == "open" and now is not None and now - since > seconds:
            met, tried = "half_open", 0
        if met == "open" or (met == "half_open" and tried >= probes):
            return (met, n, since, tried), (met, met)
        n = 0 if good else n + 1
        after = "closed" if good else "open" if met == "half_open" or n >= failures else "closed"
        if not good and after == "open" and now is not None:
            since = now
        return (after, n, since, tried + 1 if met == "half_open" else tried), (met, after)

    return stepped(calls, by, at, ok, lambda: ("closed", 0, 0.0, 0), step, "met string, state string")


def circuit(calls: DataFrame, by: list[str], at: str, ok: str, failures: int = 5, seconds: float = 60.0, probes: int = 3) -> DataFrame:
    """by, states (the state that each call met, in order), state in the end, by circuit_steps(), which has no array and so no bound on
    a key's calls."""
    return _in_order(circuit_steps(calls, by, at, ok, failures, seconds, probes), by, "met", "state").withColumnRenamed("_all", "states").select(*by, "states", "state")


SESSION_OUT = "session_id string, injected int, tokens long, compactions int"
SESSION_STATE = "ids array<string>, tokens long, compactions int"


def sessions(injections: DataFrame, hours: int = 24, late: str = "1 hour") -> DataFrame:
    """Running state of each session: ids injected so far (each once), tokens, compactions; a compaction clears the ids. A session
    that is silent for some hours of event time is forgotten."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ids, tokens, compactions = state.get if state.exists else ([], 0, 0)
        known, last = dict.fromkeys(ids), state.getCurrentWatermarkMs()
        for f in frames:
            for r in f.sort_values("event_time").itertuples():
                last = max(last, int(r.event_time.timestamp() * 1000))
                if r.kind == "compact":
                    known, compactions = {}, compactions + 1
                elif r.point_id not in known:
                    known[r.point_id] = None
                    tokens += int(r.tokens)
        state.update((list(known), tokens, compactions))
        state.setTimeoutTimestamp(last + hours * 3_600_000)
        yield pd.DataFrame([(key[0], len(known), tokens, compactions)], columns=["session_id", "injected", "tokens", "compactions"])

    return injections.withWatermark("event_time", late).groupBy("session_id").applyInPandasWithState(update, SESSION_OUT, SESSION_STATE, "update", GroupStateTimeout.EventTimeTimeout)


def first_edits(edits: DataFrame, late: str = "24 hours") -> DataFrame:
    """The first edit of each file in each session; state is kept as long as the watermark allows."""
    return edits.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["session_id", "file_path"])


def new_messages(messages: DataFrame, within: str = "5 minutes") -> DataFrame:
    """Messages less repeats of the same text in the same session within a time."""
    return messages.withWatermark("event_time", within).dropDuplicatesWithinWatermark(["session_id", "text"])


def turns(messages: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Messages grouped into sittings by silence between them."""
    w = F.session_window("event_time", gap)
    return messages.withWatermark("event_time", late).groupBy("session_id", w).agg(F.count(F.lit(1)).alias("messages"), F.min("event_time").alias("begin"), F.max("event_time").alias("end"))


def metrics(events: DataFrame, every: str = "60 seconds", late: str = "2 minutes") -> DataFrame:
    """Counts and sums per interval and type."""
    return events.withWatermark("event_time", late).groupBy(F.window("event_time", every), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def process_queue(batch: DataFrame, work: Callable[[DataFrame], DataFrame], done: str, dead: str, retry: str) -> None:
    """One micro-batch of a queue: work gives id and error (null: done); exhausted entries go to the dead letters, others wait."""
    result = batch.join(work(batch).select("id", "error"), "id", "left").persist()
    result.filter("error IS NULL").write.mode("append").parquet(done)
    left = result.filter("error IS NOT NULL").withColumn("retry_count", F.col("retry_count") + 1)
    left.filter("retry_count >= max_retries").write.mode("append").parquet(dead)
    left.filter("retry_count < max_retries").write.mode("append").parquet(retry)
    result.unpersist()


def merge_batches(stream: DataFrame, table: str, key: str, columns: list[str], checkpoint: str):
    """Writes a stream's last value per key into versions of a table; the version is named by the batch, so a retry repeats nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = spark.read.parquet(f"{table}/v{number}" if number else f"{table}/v0")
        last = batch.groupBy(key).agg(*(F.max_by(c, "event_time").alias(c) for c in columns))
        updated(now, last, key, columns).write.mode("overwrite").parquet(f"{table}/v{number + 1}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def flushed(stream: DataFrame, out: str, checkpoint: str, seconds: float | None = None):
    """Writes what has come in at every interval, or all there is and then stops where no interval is given. How much goes into one
    flush is the source's option (maxFilesPerTrigger, maxOffsetsPerTrigger)."""
    w = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).format("parquet")
    return (w.trigger(availableNow=True) if seconds is None else w.trigger(processingTime=f"{seconds} seconds")).start(out)


def captured(frames: dict[str, DataFrame], out: str, wait: float) -> None:
    """Stores several frames at once, each as jobs of its own, in a folder for each name, and waits for all; raises what failed, or
    that the time is over."""
    with ThreadPoolExecutor(len(frames)) as pool:
        jobs = [pool.submit(f.write.mode("append").parquet, f"{out}/capture={n}") for n, f in frames.items()]
        done, open_ = wait_for(jobs, timeout=wait)
        if open_:
            raise TimeoutError(f"{len(open_)} captures are not stored")
        for j in done:
            j.result()
