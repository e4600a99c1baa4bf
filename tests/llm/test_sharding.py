import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillstone.llm import sharding

SCHEMA = "doc_id long, text string"


def check(rows, texts, shards=8, slack=None):
    """The law `bytes`, gapless slots, sizes and checksums; returns the shards by text."""
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    slots, load = {}, [0] * shards
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
        load[r["shard"]] += r["size"]
    for s, v in slots.items():
        assert 0 <= s < shards and sorted(v) == list(range(len(v)))
    if texts:
        share = sum(load) / shards
        most = max(len((t or "").encode()) + 1 for _, t in texts)
        assert max(load) - share <= max(0.01 * share, most if slack is None else slack), load
    by_id, where = dict(texts), {}
    for r in rows:
        where.setdefault(by_id[r["doc_id"]] or "", set()).add(r["shard"])
    return where


def test_op11_balances_bytes_and_keeps_groups(spark, sf_dir):
    rows = sharding.op11_sharding(spark, sf_dir).collect()
    texts = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    where = check(rows, texts, slack=0)
    assert all(len(s) == 1 for s in where.values())  # no group is larger than a shard
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}


def test_a_group_of_most_rows_is_subdivided(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LEAST_ROWS", 16)
    texts = [(k, "one text of many copies") for k in range(3000)] + [(k, None if k % 2 else "") for k in range(3000, 5000)] + [(k, f"text {k} " * (k % 40)) for k in range(5000, 9000)]
    df = spark.createDataFrame(texts, SCHEMA).repartition(7)
    where = check(sharding.shard(df).collect(), texts, slack=0)
    assert sum(len(s) > 1 for s in where.values()) <= 2


def test_windows_stay_small(spark, monkeypatch):
    """Ranges and parts bound what is numbered together."""
    monkeypatch.setattr(sharding, "LEAST_ROWS", 64)
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 12_000, "").otherwise(F.col("id").cast("string")).alias("text"))
    rows = sharding.shard(docs, 4).collect()
    check(rows, [(k, "" if k < 12_000 else str(k)) for k in range(20_000)], 4)


@pytest.mark.parametrize("shards", [1, 3])
def test_edge_cases(spark, shards):
    assert sharding.shard(spark.createDataFrame([], SCHEMA), shards).count() == 0
    texts = [(None, "a"), (2, None), (3, ""), (4, "é" * 200_000), (5, "b")]
    df = spark.createDataFrame(texts, SCHEMA).withColumn("shard", F.lit(7)).withColumn("key", F.lit("k")).withColumn("row", F.lit(1))
    check(sharding.shard(df, shards).collect(), texts, shards)
    twice = spark.createDataFrame([(1, "x")] * 50, SCHEMA)
    rows = sharding.shard(twice, shards).collect()
    assert len(rows) == 50 and {(r["shard"], r["slot"]) for r in rows} == {(s, k) for s in range(shards) for k in range(sum(r["shard"] == s for r in rows))}


def test_written_shards_hold_all_columns(spark, tmp_path):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), F.col("id").cast("int")).alias("text"), F.lit("web").alias("source"))
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select("carried.*").exceptAll(docs).isEmpty() and back.count() == 200
    assert back.groupBy("shard").agg(F.max("slot") + 1 == F.count("slot")).select(F.col("((max(slot) + 1) = count(slot))").alias("ok")).filter("not ok").isEmpty()
