import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from quillstone.sources.listing import Listing, land_pages
from quillstone.streaming import attempts

KIND = "bib string, n long"


def land(spark, folder, low, high, total=None, page_rows=10):
    rows = spark.range(low, high).select(F.format_string("b%05d", "id").alias("bib"), F.col("id").alias("n"), F.floor(F.col("id") / page_rows).alias("page"))
    land_pages(rows, folder, "bib", "page", high if total is None else total)


@pytest.fixture
def listing(spark, tmp_path):
    spark.dataSource.register(Listing)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    folder = f"file://{tmp_path}/list"
    land(spark, folder, 0, 95)
    return folder, lambda: spark.read.format("listing").schema(KIND).option("key", "bib").load(folder)


def test_listing_reads_a_page_a_task(spark, listing):
    _, read = listing
    assert sorted(tuple(r) for r in read().collect()) == [(f"b{k:05d}", k) for k in range(95)]
    assert read().rdd.getNumPartitions() == 10


def test_keys_choose_pages(spark, listing):
    _, read = listing
    for cond, want in ((F.col("bib") == "b00042", [42]), (F.col("bib").isin("b00001", "b00009", "b00077", "none"), [1, 9, 77]), (F.col("bib") == "x", [])):
        df = read().filter(cond)
        assert sorted(r["n"] for r in df.collect()) == want
        assert df.rdd.getNumPartitions() == max(1, len({n // 10 for n in want}))


def test_a_cut_listing_raises(spark, listing, tmp_path):
    _, read = listing
    folder = f"file://{tmp_path}/cut"
    land(spark, folder, 0, 30, total=31)
    with pytest.raises(Exception, match="the listing is cut: 30 of 31"):
        spark.read.format("listing").schema(KIND).option("key", "bib").load(folder).count()
    page = next((tmp_path / "list" / "pages" / "page=3").glob("part-*"))
    held = json.loads(page.read_text())
    page.write_text(json.dumps(held | {"results": held["results"][1:]}))
    for crc in page.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception, match="page 3 is cut: 9 of 10"):
        read().count()


def test_a_resumed_stream_reads_new_pages_only(spark, listing, tmp_path):
    folder, _ = listing
    seen = []

    def run():
        stream = spark.readStream.format("listing").schema(KIND).option("key", "bib").load(folder)
        took = []
        stream.writeStream.foreachBatch(lambda df, _: took.extend(r["n"] for r in df.collect())).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
        seen.append(sorted(took))

    run()
    run()
    land(spark, folder, 100, 123)
    run()
    assert seen == [list(range(95)), [], list(range(100, 123))]


def events(seed, n=400, users=6):
    rng, at = random.Random(seed), dt.datetime(2024, 1, 1)
    rows = []
    for _ in range(n):
        at += dt.timedelta(seconds=rng.choice([30, 600, 3600, 20_000]))
        rows.append((f"u{rng.randrange(users)}", at, rng.random() < 0.6))
    return rows


def plain_retries(rows):
    """A fold over each key's events in order of time."""
    out, state = [], {}
    for key, at, failed in sorted(rows, key=lambda r: (r[1], r[2])):
        failures, due = state.get(key, (0, None))
        if due and due < at:
            out.append((key, failures, due))
        failures = failures + 1 if failed else 0
        state[key] = (failures, at + dt.timedelta(seconds=min(attempts.STEP * failures, attempts.MOST)) if failed else None)
    return sorted(out + [(k, f, d) for k, (f, d) in state.items() if d])


EVENT = "key string, ts timestamp, failed boolean"


def run_retries(spark, folder, ck, out):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", attempts.ROCKSDB)
    try:
        stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(folder)
        attempts.retries(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_retries_equal_a_fold_and_survive_a_restart(spark, tmp_path):
    rows = events(3)
    closing = ("closing", rows[-1][1] + dt.timedelta(days=30), False)
    frame = lambda part: spark.createDataFrame(part, EVENT).coalesce(1)
    assert sorted(tuple(r) for r in attempts.retries_of_table(frame(rows)).collect()) == plain_retries(rows)
    folder = str(tmp_path / "in")
    for part in (rows[:150], rows[150:151]):
        frame(part).write.mode("append").parquet(folder)
    run_retries(spark, folder, str(tmp_path / "ck"), str(tmp_path / "out"))
    before = spark.read.parquet(str(tmp_path / "out")).count()
    # a new query goes on from the checkpoint
    for part in (rows[151:], [closing]):
        frame(part).write.mode("append").parquet(folder)
    run_retries(spark, folder, str(tmp_path / "ck"), str(tmp_path / "out"))
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == plain_retries(rows) and 0 < before < len(got)


def test_runs_time_out(spark, tmp_path):
    rows = events(5)
    starts, ends = [(k, t) for k, t, f in rows if f], [(k, t) for k, t, f in rows if not f]
    kind = "key string, ts timestamp"
    far = rows[-1][1] + dt.timedelta(days=30)
    for name, part in (("s", starts), ("e", ends)):
        for cut in (part[:60], part[60:], [("closing", far)]):
            spark.createDataFrame(cut, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    read = lambda name: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    attempts.runs(read("s"), read("e")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).filter("key <> 'closing'").collect()), key=str)
    pair = [(k, t, e) for k, t in starts for j, e in ends if j == k and t <= e <= t + dt.timedelta(hours=2)]
    want = sorted(pair + [(k, t, None) for k, t in starts if (k, t) not in {p[:2] for p in pair}], key=str)
    assert got == want and any(r[2] is None for r in got) and any(r[2] for r in got)
