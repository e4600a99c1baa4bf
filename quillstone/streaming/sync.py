"""Incremental maintenance: a landing folder streamed into versioned tables by fingerprint.

`sync_batch` is the unit of work; the streaming query applies it to every micro-batch, so the same code serves polling
(`trigger(availableNow=True)`) and continuous runs. A batch that is replayed after a failure writes nothing new,
because fingerprints already agree.
"""

from __future__ import annotations

import fcntl
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillstone.operators.records import guard_removals
from quillstone.session import written
from quillstone.sources.files import TableStore


def changed(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Rows of new whose fingerprint is not the stored one."""
    stored = old.select(key, F.col("fingerprint").alias("_stored"))
    return new.join(stored, key, "left").filter(~F.col("fingerprint").eqNullSafe(F.col("_stored"))).drop("_stored")


def sync_batch(store: TableStore, table: str, batch: DataFrame, key: str) -> int:
    """Upsert the changed rows of a batch; of rows with the same key the last by fingerprint stays. Returns how many were written."""
    batch = batch.groupBy(key).agg(F.max(F.struct("fingerprint", *[c for c in batch.columns if c not in (key, "fingerprint")])).alias("_r")).select(key, "_r.*")
    todo = changed(batch, store.read(table), key) if store.exists(table) else batch
    n = todo.count()
    if n:
        store.upsert(table, todo, key)
    return n


def sync_full(store: TableStore, table: str, listing: DataFrame, key: str, most_removals: int = 10, allow: bool = False) -> dict[str, int]:
    """Bring a table to a complete listing: changed rows written, rows that left removed, unless they are too many."""
    if not store.exists(table):
        store.write(table, listing)
        return {"written": listing.count(), "removed": 0}
    old = store.read(table)
    gone = old.join(listing.select(key), key, "left_anti").select(key)
    n_gone = gone.count()
    guard_removals(n_gone, most_removals, allow)
    todo = changed(listing, old, key)
    n = todo.count()
    if n or n_gone:
        store.write(table, old.join(gone, key, "left_anti").join(todo.select(key), key, "left_anti").unionByName(todo, allowMissingColumns=True))
    return {"written": n, "removed": n_gone}


def stream_into(spark: SparkSession, landing: str, schema: str, root: str, table: str, key: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df):
    """Start a query that syncs every new file of a landing folder; ends when what is there has been taken."""
    store = TableStore(spark, root)
    source = spark.readStream.schema(schema).json(landing)
    return source.writeStream.foreachBatch(lambda df, _: sync_batch(store, table, prepare(df), key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of events by type in windows of event time, with a watermark for late ones."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def fetch_rounds(pending: list[str], attempt: Callable[[str], str], rounds: int = 3, pause: Callable[[], None] = lambda: None) -> dict[str, str]:
    """Results by name: 'done' and 'failed' are final, 'retry' comes up again in the next round."""
    results: dict[str, str] = {}
    for k in range(rounds):
        todo = [p for p in pending if results.get(p, "retry") == "retry"]
        if not todo:
            break
        if k:
            pause()
        results |= {p: attempt(p) for p in todo}
    return results


def fetch_rounds_table(pending: DataFrame, attempt: Callable[[dict, int], str], rounds: int = 3, pause: Callable[[], None] = lambda: None) -> DataFrame:
    """pending(name, ...) with its result, for lists that do not fit on the driver.

    attempt(row, round) runs on executors; 'retry' comes up again in the next round. Every round is written, so a lost executor repeats
    no finished round, and rows that are done are not read again.
    """
    out, left = [], pending
    for k in range(1, rounds + 1):
        if k > 1:
            pause()

        def run(frames, k=k):
            for f in frames:
                yield f.assign(result=[attempt(r, k) for r in f.to_dict("records")])

        tried = written(left.mapInPandas(run, StructType([*pending.schema.fields, StructField("result", StringType())])), "round")
        final = tried if k == rounds else tried.filter("result <> 'retry'")
        out.append(final)
        left = tried.filter("result = 'retry'").select(*pending.columns)
        if k < rounds and left.isEmpty():
            break
    return reduce(DataFrame.unionByName, out)


@contextmanager
def single_run(path: str) -> Iterator[None]:
    """Only one run at a time: raises BlockingIOError if another holds the lock."""
    with open(path, "w") as f:
        fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        yield
