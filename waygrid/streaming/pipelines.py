"""Structured Streaming forms of the per-device operators.

One processor runs any ``step(state, row)`` machine: rows wait until the watermark passes
them, are then taken in time order, and what comes later than that is dropped and counted.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.diagnostics import failure_stage
from ..operators.ordered import _plain

PACKAGE = __name__.split(".")[0]


def ready_for_state(spark: SparkSession) -> None:
    """What custom state needs in any session: a state store with column families, and code that travels with the query."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for module in {m for n, m in sys.modules.items() if n == PACKAGE or n.startswith(PACKAGE + ".")}:
        cloudpickle.register_pickle_by_value(module)


class OrderedMachine(StatefulProcessor):
    """Buffers rows to the watermark, then folds them in order."""

    def __init__(self, step, names: Sequence[str], order: Sequence[str], ts: str, ttl_ms: float | None = None):
        self.step, self.names, self.order, self.ts, self.ttl_ms = step, list(names), list(order), ts, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("machine", "json string, done_ms long")
        self.waiting = handle.getListState("waiting", "at_ms long, row string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        soonest = None
        for batch in rows:
            for values in batch.itertuples(index=False, name=None):
                row = {c: v for c, v in zip(batch.columns, values)}
                at = int(pd.Timestamp(row.pop(self.ts)).value // 1_000_000)
                row = {c: ([dict(p) for p in v] if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "ndim", 0) else _plain(v)) for c, v in row.items()}
                self.waiting.appendValue((at, json.dumps(row, default=float)))
                soonest = at if soonest is None else min(soonest, at)
        if soonest is not None:
            self.handle.registerTimer(max(soonest, mark) + 1)
        yield pd.DataFrame(columns=self.names, dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        text, done = self.state.get() if self.state.exists() else ("{}", -1)
        state, out, keep, ready = json.loads(text), [], [], []
        if self.waiting.exists():
            for at, row in self.waiting.get():
                (ready if at <= mark else keep).append((at, row))
        items = [(at, json.loads(row)) for at, row in ready]
        items.sort(key=lambda i: (i[0], *[i[1][c] for c in self.order]))
        for at, row in items:
            if at < done:
                continue  # came after its turn
            if self.ttl_ms is not None and done >= 0 and at - done > self.ttl_ms:
                state = {}
            got = self.step(state, row)
            done = at
            if got:
                out.extend([got] if isinstance(got, dict) else got)
        self.state.update((json.dumps(state), done))
        self.waiting.clear()
        if keep:
            self.waiting.put(keep)
            self.handle.registerTimer(min(at for at, _ in keep) + 1)
        yield pd.DataFrame(out, columns=self.names, dtype=object)

    def close(self) -> None:
        pass


def stream_machine(
    rows: DataFrame, step: Callable, schema: str, ts: str = "ts", key: str = "device_id", order: Sequence[str] = ("event_id",),
    delay: str = "10 seconds", ttl_ms: float | None = None,
) -> DataFrame:
    """Run a state machine over a stream keyed by device, in event-time order."""
    out = T._parse_datatype_string(schema)
    ready_for_state(rows.sparkSession)
    marked = rows.withWatermark(ts, delay)
    return marked.groupBy(key).transformWithStateInPandas(
        statefulProcessor=OrderedMachine(step, out.names, order, ts, ttl_ms), outputStructType=out, outputMode="Append", timeMode="EventTime")


class LiveMarker(StatefulProcessor):
    """One row when a device goes live and one when it ends or falls silent."""

    def __init__(self, ttl_s: float, ts: str):
        self.ttl_ms, self.ts = int(ttl_s * 1000), ts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at_ms long, live boolean")

    def handleInputRows(self, key, rows, timerValues):
        at, live = self.last.get() if self.last.exists() else (-1, False)
        out = []
        seen = sorted((int(pd.Timestamp(v[0]).value // 1_000_000), v[1]) for b in rows for v in b[[self.ts, "event"]].itertuples(index=False, name=None))
        for ms, event in seen:
            if live and ms - at > self.ttl_ms:
                out.append((key[0], at + self.ttl_ms, "expired")); live = False
            if event == "end":
                if live:
                    out.append((key[0], ms, "ended"))
                live = False
            elif event in ("fix", "pose") and not live:
                out.append((key[0], ms, "live")); live = True
            at = max(at, ms)
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        if live:
            self.handle.registerTimer(max(at + self.ttl_ms, timerValues.getCurrentWatermarkInMs() + 1))
        self.last.update((at, live))
        yield pd.DataFrame(out, columns=["device_id", "at_ms", "change"], dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        at, live = self.last.get() if self.last.exists() else (-1, False)
        self.last.update((at, False))
        rows = [(key[0], at + self.ttl_ms, "expired")] if live else []
        yield pd.DataFrame(rows, columns=["device_id", "at_ms", "change"], dtype=object)

    def close(self) -> None:
        pass


def live_device_changes(events: DataFrame, ttl_s: float = 300.0, ts: str = "ts", delay: str = "10 seconds") -> DataFrame:
    """``events``: device_id, ts, event. Heartbeats extend, ``end`` clears, silence expires."""
    ready_for_state(events.sparkSession)
    return events.withWatermark(ts, delay).groupBy("device_id").transformWithStateInPandas(
        statefulProcessor=LiveMarker(ttl_s, ts), outputStructType="device_id long, at_ms long, change string",
        outputMode="Append", timeMode="EventTime")


def event_counts(events: DataFrame, ts: str = "ts", size: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, delay).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), "event_type", "n")


def device_sessions(events: DataFrame, gap: str = "300 seconds", ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, delay).groupBy("device_id", F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("events")).select(
        "device_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def dedupe_events(events: DataFrame, keys: Sequence[str], ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Retried uploads arrive more than once: one row per key within the watermark."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def dedupe_batch(events: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    rest = [c for c in events.columns if c not in (*keys, order)]
    first = events.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("r"))
    return first.select(*keys, "r.*")


def classify_miss_stream(misses: DataFrame, records: DataFrame) -> DataFrame:
    """Failure stage of each miss as it arrives (stream joined with the static record table).

    ``misses``: miss_id, truth_location, candidates ARRAY<STRUCT(location_id, x, y)>.
    Positions per place are the distinct surveyed spots, a small list per location.
    """
    spots = records.select(F.col("location_id").alias("truth_location"), "x", "y").distinct().groupBy("truth_location").agg(
        F.collect_list(F.struct("x", "y")).alias("spots"))
    m = misses.join(spots, "truth_location", "left")
    near = lambda c: F.exists(F.coalesce("spots", F.array().cast("array<struct<x:double,y:double>>")), lambda s: F.hypot(s["x"] - c["x"], s["y"] - c["y"]) <= 0.5)
    hit = F.exists("candidates", lambda c: (c["location_id"] == F.col("truth_location")) | near(c))
    return m.select("miss_id", F.size("candidates").alias("candidate_count"), failure_stage(F.size("candidates"), F.col("truth_location"), hit).alias("failure_stage"))
