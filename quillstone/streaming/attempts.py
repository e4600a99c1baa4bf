"""Streams that keep state by key: retries that fall due, and starts that wait for their end.

`retries` keeps for every key the number of failed attempts since the last success and the time at which the next one is due, with a timer for
it. `runs` joins starts to ends within a time, and starts without an end leave as timed out. Both take the order of events from their
own time, so the rows do not depend on how events fall into batches, as long as none is later than the watermark allows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds to wait after the n-th failed attempt in a row: a step for each of them, up to a limit.
STEP, MOST = 3600, 6 * 3600
RETRY = "key string, failures int, due timestamp"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Retries(StatefulProcessor):
    """Per key: failures in a row and when the next attempt is due; a success or a new attempt before then takes the timer away."""

    def __init__(self, step: int = STEP, most: int = MOST, ttl: int | None = None):
        self.step, self.most, self.ttl = step, most, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("attempts", "failures int, due long", ttlDurationMs=self.ttl)

    def _retry(self, key: tuple, failures: int, due: int) -> dict:
        return {"key": key[0], "failures": failures, "due": pd.Timestamp(due, unit="ms")}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["at", "failed"], kind="stable")
        failures, due = self.state.get() if self.state.exists() else (0, -1)
        before, out = due, []
        for at, failed in zip(events["at"].tolist(), events["failed"].tolist(), strict=True):
            if 0 <= due < at:  # the timer would have fired before this event
                out.append(self._retry(key, failures, due))
            failures = failures + 1 if failed else 0
            due = at + 1000 * min(self.step * failures, self.most) if failed else -1
        if before != due:
            if before >= 0:
                self.handle.deleteTimer(before)
            if due >= 0:
                self.handle.registerTimer(due)
        if due >= 0 or failures:
            self.state.update((failures, due))
        else:
            self.state.clear()
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            failures, due = self.state.get()
            if due == expiredTimerInfo.getExpiryTimeInMs():
                self.state.update((failures, -1))
                yield pd.DataFrame([self._retry(key, failures, due)])

    def close(self) -> None:
        pass


def retries(events: DataFrame, late: str = "1 hour", step: int = STEP, most: int = MOST, ttl: int | None = None) -> DataFrame:
    """key, failures, due of every retry that fell due, from a stream of events(key, ts, failed). Needs the RocksDB state store (`ROCKSDB`)."""
    rows = events.withWatermark("ts", late).select(F.col("key").cast("string").alias("key"), "ts", F.unix_millis("ts").alias("at"), "failed")
    return rows.groupBy("key").transformWithStateInPandas(Retries(step, most, ttl), RETRY, "Append", "EventTime", eventTimeColumnName="")


def retries_of_table(events: DataFrame, step: int = STEP, most: int = MOST) -> DataFrame:
    """The same rows from a table of events, by windows: what the stream has to give once everything is due."""
    from pyspark.sql import Window

    w = Window.partitionBy("key").orderBy("at", "failed")
    rows = events.select(F.col("key").cast("string").alias("key"), F.unix_millis("ts").alias("at"), "failed")
    rows = rows.withColumn("streak", F.count_if(~F.col("failed")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("failures", F.count_if("failed").over(Window.partitionBy("key", "streak").orderBy("at", "failed").rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    rows = rows.withColumn("next", F.lead("at").over(w)).filter("failed")
    due = F.col("at") + 1000 * F.least(F.col("failures") * step, F.lit(most))
    return rows.filter(F.col("next").isNull() | (due < F.col("next"))).select("key", "failures", F.timestamp_millis(due).alias("due"))


def runs(starts: DataFrame, ends: DataFrame, within: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """key, started, ended of every start of starts(key, ts) with each end of ends(key, ts) that comes within the time; null where none came.

    For streams: an unmatched start leaves once no end can come in time any more. For tables it is the same join.
    """
    a = starts.select(F.col("key").alias("key"), F.col("ts").alias("started"))
    b = ends.select(F.col("key").alias("_key"), F.col("ts").alias("ended"))
    if starts.isStreaming:
        a, b = a.withWatermark("started", late), b.withWatermark("ended", late)
    held: Column = (F.col("key") == F.col("_key")) & (F.col("ended") >= F.col("started")) & (F.col("ended") <= F.col("started") + F.expr(f"interval {within}"))
    return a.join(b, held, "left_outer").drop("_key")
