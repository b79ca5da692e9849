"""Keyed state with lists, time to live and timers: latency rings and leases as streams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RING = 1000


def with_state_store(spark: SparkSession) -> None:
    """Processors below keep their state in RocksDB, which spills to disk and checkpoints changes only."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def texts(values: list[str]) -> pd.Series:
    """A plain column of texts: those that pandas holds in Arrow chunks can't be handed back."""
    return pd.Series(values, dtype=object)


class Ring(StatefulProcessor):
    """The last `size` latencies of a key, those older than `ttl` forgotten, and their nearest-rank percentiles after each batch."""

    def __init__(self, size: int = RING, ttl: timedelta | None = None):
        self.size, self.ttl = size, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", "ms double", None if self.ttl is None else int(self.ttl.total_seconds() * 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["at", "ms"])["ms"].tolist()
        kept = ([r[0] for r in self.last.get()] if self.last.exists() else []) + new
        self.last.put([(float(x),) for x in kept[-self.size :]])
        ordered = sorted(kept[-self.size :])
        rank = lambda p: ordered[max(0, math.ceil(p * len(ordered)) - 1)]
        yield pd.DataFrame({"key": texts([key[0]]), "n": [len(ordered)], "p50": [rank(0.5)], "p95": [rank(0.95)], "p99": [rank(0.99)]})

    def close(self) -> None:
        pass


class Leases(StatefulProcessor):
    """Runs (run, at, event): `start` opens a lease of some seconds that every `beat` renews and `done` ends. A lease that event time passes ends as
    failed, once; so does one that is renewed too late."""

    def __init__(self, seconds: int = 300):
        self.ms = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.until = handle, handle.getValueState("until", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        until = self.until.get()[0] if self.until.exists() else None
        out = []
        for r in pd.concat(list(rows)).sort_values("at").itertuples():
            at = int(r.at.timestamp() * 1000)
            if until is not None and at > until:
                out.append((until, "failed"))
                until = None
            elif until is not None and r.event == "done":
                out.append((at, "validated"))
                until = None
            elif r.event == "start" or until is not None and r.event == "beat":
                until = at + self.ms
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if until is None:
            self.until.clear()
        else:
            self.until.update((until,))
            self.handle.registerTimer(until + 1)
        yield self.told(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = self.until.get()[0]
        self.until.clear()
        yield self.told(key, [(until, "failed")])

    def told(self, key, out: list[tuple[int, str]]) -> pd.DataFrame:
        return pd.DataFrame({"run": texts([key[0]] * len(out)), "at": pd.to_datetime([a for a, _ in out], unit="ms"), "state": texts([s for _, s in out])})

    def close(self) -> None:
        pass


def latency_ring(requests: DataFrame, size: int = RING, ttl: timedelta | None = None) -> DataFrame:
    """(key, n, p50, p95, p99) of a stream (key, at, ms) after each of its batches."""
    rows = requests.select("key", "at", "ms").groupBy("key")
    return rows.transformWithStateInPandas(Ring(size, ttl), "key string, n long, p50 double, p95 double, p99 double", "update", "None" if ttl is None else "processingTime")


def lease_states(runs: DataFrame, seconds: int = 300) -> DataFrame:
    """(run, at, state) of a watermarked stream (run, at, event): how and when each lease ended."""
    rows = runs.select("run", "at", "event").groupBy("run")
    return rows.transformWithStateInPandas(Leases(seconds), "run string, at timestamp, state string", "append", "eventTime")
