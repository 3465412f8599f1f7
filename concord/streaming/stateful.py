"""State with time (ST-03, ST-05): folds that wait for the order of events, and a watchdog with timers.

Both need Spark's RocksDB state store (``use_rocksdb``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from concord.lifecycle import EDGES

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class OrderedFold(StatefulProcessor):
    """Holds each paper's events until the watermark has passed them, then applies them by time and sequence."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "status string, applied long, rejected long")
        self.waiting = handle.getMapState("waiting", "ms long, seq long", "to_status string, override boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for e in batch.itertuples():
                ms = e.ts.value // 1_000_000
                self.waiting.updateValue((ms, e.seq), (e.to_status, bool(e.override)))
                self.handle.registerTimer(ms)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = sorted(k for k in self.waiting.keys() if k[0] <= expiredTimerInfo.getExpiryTimeInMs())
        status, applied, rejected = self.now.get() if self.now.exists() else ("INGESTED", 0, 0)
        for k in due:
            to_status, override = self.waiting.getValue(k)
            if override or f"{status}>{to_status}" in EDGES:
                status, applied = to_status, applied + 1
            else:
                rejected += 1
            self.waiting.removeKey(k)
        if due:
            self.now.update((status, applied, rejected))
            yield pd.DataFrame({"paper_id": [key[0]], "status": [status], "applied": [applied], "rejected": [rejected]})

    def close(self) -> None:
        pass


def fold_status_in_order(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """ST-05: the status fold of events (paper_id, ts, seq, to_status, override) that may come in any order within `late`.

    A row for each paper and time at which events took effect; the last row of a paper agrees with the batch fold. Events behind
    the watermark are dropped, as everywhere in Spark; a repeated event (same time and sequence) counts once.
    """
    grouped = events.withWatermark("ts", late).groupBy("paper_id")
    return grouped.transformWithStateInPandas(OrderedFold(), "paper_id long, status string, applied long, rejected long", "Append", "eventTime")


class Watchdog(StatefulProcessor):
    """Counts each run's events; a run that is silent for too long gives a row, once until it speaks again."""

    def __init__(self, silence_ms: int, forget_ms: int):
        self.silence_ms, self.forget_ms = silence_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "n long, last_ms long", self.forget_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = sum(len(batch) for batch in rows) + (self.seen.get()[0] if self.seen.exists() else 0)
        now = timerValues.getCurrentProcessingTimeInMs()
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(now + self.silence_ms)
        self.seen.update((n, now))
        yield pd.DataFrame({"run_id": [key[0]], "state": ["alive"], "n": [n]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n = self.seen.get()[0] if self.seen.exists() else 0
        yield pd.DataFrame({"run_id": [key[0]], "state": ["silent"], "n": [n]})

    def close(self) -> None:
        pass


def watch_runs(events: DataFrame, silence_ms: int, forget_ms: int = 86_400_000) -> DataFrame:
    """ST-03: `alive` with the events so far whenever a run (run_id) has new ones, `silent` by a timer when it has had none for `silence_ms`; what is known of a run is dropped after `forget_ms`."""
    return events.groupBy("run_id").transformWithStateInPandas(Watchdog(silence_ms, forget_ms), "run_id long, state string, n long", "Append", "processingTime")
