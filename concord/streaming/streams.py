"""Event windows, sessions and the fold in order (ST-02, ST-05, ST-06); `stateful` has state with time, `ledger` the appends."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from concord.lifecycle import EDGES


def event_times(df: DataFrame, late: str = "10 minutes") -> DataFrame:
    """ST-06: `ts` as a timestamp with a watermark; batch frames only get the cast."""
    out = df.withColumn("ts", F.col("ts").cast("timestamp"))
    return out.withWatermark("ts", late) if df.isStreaming else out


def tumbling(df: DataFrame, width: str = "1 hour") -> DataFrame:
    """ST-06."""
    return event_times(df).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(df: DataFrame, width: str = "2 hours", step: str = "1 hour") -> DataFrame:
    return event_times(df).groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(df: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """ST-06."""
    return event_times(df).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_of_key(df: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """ST-02."""
    return event_times(df, late).dropDuplicatesWithinWatermark(keys)


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, applied, rejected = state.get if state.exists else ("INGESTED", 0, 0)
    for e in pd.concat(batches).sort_values("seq").itertuples():
        if e.override or f"{status}>{e.to_status}" in EDGES:
            status, applied = e.to_status, applied + 1
        else:
            rejected += 1
    state.update((status, applied, rejected))
    yield pd.DataFrame({"paper_id": [key[0]], "status": [status], "applied": [applied], "rejected": [rejected]})


def fold_status(events: DataFrame) -> DataFrame:
    """ST-05: the status fold at once, for events that come in order; `stateful.fold_status_in_order` waits for those that do not."""
    return events.groupBy("paper_id").applyInPandasWithState(_fold, "paper_id long, status string, applied long, rejected long", "status string, applied long, rejected long", "update", GroupStateTimeout.NoTimeout)
