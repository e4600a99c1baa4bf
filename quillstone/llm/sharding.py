"""Sharding by sampled splitters (operator 11), in DataFrame functions only.

Records are ordered by a hash of their text, so equal texts (a group) stand side by side. A sample with a chance in proportion to
size gives splitters at quantiles of bytes, `UNITS` ranges a shard. A range that is overfull is subdivided: its heavy groups (more
than twice a range's share of bytes or rows) become ranges of their own, in parts by the hash of the row's number. Ranges are then dealt:
heavy groups first, the largest to the emptiest shard, whole where they fit below an equal share and by parts where they do not;
the other ranges fill the shards up in order of their keys. So a group stays in one shard unless it is too large for any, or
unless its shard's share ends inside a record that cannot be cut.

The law is `bytes`: shards differ by about one range, 1/UNITS of a shard, or by what single records exceed it. The driver holds
statistics only: about SHARDS * UNITS * DRAWS sampled keys, and at most a few times SHARDS * UNITS ranges and parts, whatever the input.
The text is read once; what is sorted, counted and numbered is a written table of id, size, checksum, key and row number. Slots are
prefix sums of the ranges' counts plus the row's number in its range or part, which a bound on rows keeps small.

Defined results: a null text counts as empty (size 1, checksum 0) and belongs to the group of the empty text; a null id is kept; repeated
rows are placed each by itself; ties of key stand by id, then row number; an empty table gives no rows; further columns
are ignored, unless they are asked for by `carry`.
"""

from __future__ import annotations

import json
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm.common import materialise

SHARDS = 8
#: Ranges a shard, and expected sample points a range.
UNITS, DRAWS = 512, 8
#: Rows that a range or part may have at least before it counts as overfull.
LEAST_ROWS = 4096
_BLOCK = 64


def sized(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, key, row (a number of its own for every row) and the columns to carry, in a struct."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key"),
        F.monotonically_increasing_id().alias("row"), *([F.struct(*carry).alias("carried")] if carry else []),
    )
    return materialise(rows, "sized")


def splitters(rows: DataFrame, total: int, ranges: int) -> list[int]:
    """Keys at the quantiles of bytes, from a sample whose rows have chances in proportion to their size."""
    chance = F.pmod(F.xxhash64("row", F.lit(11)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    draws = F.floor(F.col("size") / F.lit(total / (ranges * DRAWS)) + chance)
    sample = rows.select("key", draws.alias("n")).filter("n > 0").groupBy("key").agg(F.sum("n").alias("n")).collect()  # about ranges * DRAWS keys at most
    sample.sort()
    cuts, sums = [], list(accumulate(r["n"] for r in sample))
    for r, upto in zip(sample, sums, strict=True):
        if upto * ranges >= (len(cuts) + 1) * sums[-1]:
            cuts += [r["key"]]
    return cuts


def range_of(key: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts are below the key, so equal keys share a range; by blocks of cuts, then within one."""
    listed = lambda v: F.split(F.lit(",".join(map(str, v))), ",").cast("array<bigint>")
    if not cuts:
        return F.lit(0)
    below = lambda v: F.size(F.filter(v, lambda c: c < key))
    block = F.greatest(below(listed(cuts[::_BLOCK])) - 1, F.lit(0))
    return block * _BLOCK + below(F.slice(listed(cuts), block * _BLOCK + 1, F.lit(_BLOCK)))


def deal(ranges: list[tuple], groups: dict[int, list[tuple]], shards: int, total: int, unit: float) -> dict[tuple, int]:
    """(range, part) -> shard. ranges: (range, bytes) in order of keys; groups: (part, bytes) of the heavy groups by their range."""
    share = total / shards
    load, place = [0] * shards, {}
    emptiest = lambda: min(range(shards), key=lambda s: (load[s], s))
    for r, parts in sorted(groups.items(), key=lambda g: (-sum(b for _, b in g[1]), g[0])):
        s = emptiest()
        fits = load[s] + sum(b for _, b in parts) <= share + unit
        for part, size in parts:
            to = s if fits else emptiest()  # a group that is too large for the emptiest shard goes out part by part
            place[r, part] = to
            load[to] += size
    s = 0
    for r, size in ranges:
        while s < shards - 1 and load[s] + size / 2 > share:
            s += 1
        place[r, 0] = s
        load[s] += size
    return place


def shard(docs: DataFrame, shards: int = SHARDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row, and the struct `carried` if columns are to be carried."""
    spark, rows = docs.sparkSession, sized(docs, carry)
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    count = shards * UNITS
    unit, most_rows = max(1.0, total / count), max(LEAST_ROWS, -(-n // count))
    cuts = splitters(rows, total, count) if total else []
    ranged = rows.withColumn("range", range_of(F.col("key"), cuts).cast("long"))
    by_range = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()  # one row a range
    overfull = [r["range"] for r in by_range if r["bytes"] > 2 * unit or r["n"] > 2 * most_rows]
    # of overfull ranges the groups that are heavy themselves: at most `count`
    heavy = ranged.filter(F.col("range").isin(overfull) if len(overfull) < len(by_range) / 2 else F.lit(True)).groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    heavy = sorted(heavy.filter((F.col("bytes") > 2 * unit) | (F.col("n") > 2 * most_rows)).collect())
    first = len(cuts) + 1
    parts = [{"key": h["key"], "own": first + k, "parts": max(1, min(h["n"], int(max(h["bytes"] / unit, h["n"] / most_rows))))} for k, h in enumerate(heavy)]
    local = lambda v, kind: spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(v)), f"array<struct<{kind}>>")))
    known = F.broadcast(local(parts, "key:bigint,own:bigint,parts:int"))
    ranged = ranged.join(known, "key", "left").withColumns({"range": F.coalesce("own", "range"), "part": F.when(F.col("own").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("row"), F.col("parts"))).cast("long")})
    stats = ranged.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()  # one row a range or part
    stats.sort(key=lambda r: (r["range"], r["part"]))
    groups: dict[int, list[tuple]] = {}
    for r in stats:
        if r["range"] >= first:
            groups.setdefault(r["range"], []).append((r["part"], r["bytes"]))
    place = deal([(r["range"], r["bytes"]) for r in stats if r["range"] < first], groups, shards, total, unit)
    filled, places = [0] * shards, []
    for r in stats:
        to = place[r["range"], r["part"]]
        places.append({"range": r["range"], "part": r["part"], "shard": to, "base": filled[to]})
        filled[to] += r["n"]
    placed = ranged.withColumn("at", F.row_number().over(Window.partitionBy("range", "part").orderBy("key", "doc_id", "row")) - 1)
    placed = placed.join(F.broadcast(local(places, "range:bigint,part:bigint,shard:int,base:bigint")), ["range", "part"])
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("at")).cast("long").alias("slot"), *(["carried"] if carry else []))


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS) -> None:
    """The rows of docs as one folder of Parquet files a shard, each with its slot."""
    shard(docs, shards, tuple(docs.columns)).select("shard", "slot", "carried").write.partitionBy("shard").parquet(folder)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
