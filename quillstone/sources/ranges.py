"""A table kept by ranges of its key, so that a change rewrites the ranges it touches and no others.

Rows lie in folders `range=<n>`; the ranges' bounds are quantiles of the keys at the time of creation, stored beside the rows. An upsert,
a deletion, a replacement of groups or a patch of keyed rows works out the ranges of its keys, reads these alone (a partition
filter), writes the new state of them elsewhere, and then overwrites their folders dynamically. What was written elsewhere first
survives a failure, and a change that is repeated gives the same rows. Within a range, rows are sorted by key, so row groups can be skipped.

Bounds are fixed; `rebalance` takes new ones and rewrites everything, for tables whose keys have drifted. One writer at a time.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.session import written

#: Rows that a range has at creation, about, and ranges at most, so that their bounds and numbers stay small on the driver.
RANGE_ROWS, MOST_RANGES = 1_000_000, 4096
#: Keys that the quantiles are taken from, about, for each range.
SAMPLED = 32


class RangeTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def create(self, df: DataFrame, key: str, range_rows: int = RANGE_ROWS) -> RangeTable:
        """Write df; keys should be distinct, null keys have the first range."""
        if "range" in df.columns:
            raise ValueError("a column named range is the table's own")
        n = df.count()
        ranges = max(1, min(MOST_RANGES, -(-n // range_rows)))
        share = min(1.0, SAMPLED * ranges / max(1, n))
        picked = df.select(key).filter(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(1_000_003)) < int(1_000_003 * share) + 1))
        sample = sorted(r[0] for r in picked.collect())  # about SAMPLED keys a range
        bounds = sorted({sample[len(sample) * k // ranges] for k in range(1, ranges)}) if sample else []
        kept = self.spark.createDataFrame([(key, json.dumps(bounds), df.schema.json())], "key string, bounds string, schema string")
        kept.coalesce(1).write.parquet(f"{self.root}/settings")
        self._write(df, "errorifexists")
        return self

    def _settings(self) -> tuple[str, list, str]:
        r = self.spark.read.parquet(f"{self.root}/settings").first()
        return r["key"], json.loads(r["bounds"]), r["schema"]

    def _range_of(self, value: Column) -> Column:
        """The number of bounds that are not above the value."""
        _, bounds, _ = self._settings()
        if not bounds:
            return F.lit(0)
        kind = "string" if isinstance(bounds[0], str) else "bigint"
        listed = F.from_json(F.lit(json.dumps(bounds)), f"array<{kind}>")
        step = 64
        heads = F.from_json(F.lit(json.dumps(bounds[::step])), f"array<{kind}>")
        block = F.greatest(F.size(F.filter(heads, lambda b: b <= value)) - 1, F.lit(0))
        inside = F.size(F.filter(F.slice(listed, block * step + 1, F.lit(step)), lambda b: b <= value))
        return F.coalesce(block * step + inside, F.lit(0))

    def _write(self, df: DataFrame, mode: str) -> None:
        key, *_ = self._settings()
        rows = df.withColumn("range", self._range_of(F.col(key)).cast("int"))
        # a range is one task's: its size is bounded when the table is made
        out = rows.repartition("range").sortWithinPartitions("range", key).write.mode(mode).option("partitionOverwriteMode", "dynamic")
        out.partitionBy("range").parquet(f"{self.root}/rows")

    def read(self, ranges: list[int] | None = None) -> DataFrame:
        """All rows, or those of some ranges."""
        from pyspark.sql.types import IntegerType, StructType

        schema = StructType.fromJson(json.loads(self._settings()[2]))
        rows = self.spark.read.schema(schema.add("range", IntegerType())).parquet(f"{self.root}/rows")
        return (rows if ranges is None else rows.filter(F.col("range").isin(ranges))).drop("range")

    def touched(self, keys: DataFrame, key: str) -> list[int]:
        """Numbers of the ranges that keys(key) fall into; at most as many as there are ranges."""
        return sorted(r[0] for r in keys.select(self._range_of(F.col(key)).cast("int")).distinct().collect())

    def _replace(self, ranges: list[int], rows: DataFrame) -> None:
        rows = written(rows, "range_rows")
        key, *_ = self._settings()
        left = {r[0] for r in rows.select(self._range_of(F.col(key)).cast("int")).distinct().collect()}
        self._write(rows, "overwrite")
        for k in set(ranges) - left:  # a range without rows is not overwritten by a dynamic overwrite
            self._fs.delete(self._path(f"{self.root}/rows/range={k}"), True)

    def upsert(self, new: DataFrame) -> list[int]:
        """Put new rows in the place of those with their keys; columns that they lack are null. Returns the ranges that were written."""
        key, *_ = self._settings()
        new = written(new, "new_rows")
        ranges = self.touched(new, key)
        if ranges:
            held = self.read(ranges)
            lacking = {f.name: F.lit(None).cast(f.dataType) for f in held.schema if f.name not in new.columns}
            rows = new.withColumns(lacking).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in held.schema])
            self._replace(ranges, held.join(new.select(key).distinct(), key, "left_anti").select(*held.columns).unionByName(rows))
        return ranges

    def delete(self, keys: DataFrame) -> list[int]:
        key, *_ = self._settings()
        keys = written(keys.select(key).distinct(), "keys")
        ranges = self.touched(keys, key)
        if ranges:
            held = self.read(ranges)
            self._replace(ranges, held.join(keys, key, "left_anti").select(*held.columns))
        return ranges

    def patch(self, keys: DataFrame, changes: dict[str, Column]) -> list[int]:
        """Change columns of the rows with the given keys; a change may read the row's columns."""
        key, *_ = self._settings()
        keys = written(keys.select(key).distinct(), "keys")
        ranges = self.touched(keys, key)
        if ranges:
            held = self.read(ranges)
            hit = held.join(keys.withColumn("_hit", F.lit(True)), key, "left")
            cols = [F.when(F.col("_hit"), changes[c]).otherwise(F.col(c)).cast(held.schema[c].dataType).alias(c) if c in changes else F.col(c) for c in held.columns]
            self._replace(ranges, hit.select(*cols))
        return ranges

    def replace_groups(self, new: DataFrame, group: str) -> list[int]:
        """Replace whole groups of rows by new's. The ranges of the groups' old rows are found by the group's own filter, which Parquet statistics can help."""
        key, *_ = self._settings()
        new = written(new, "new_rows")
        groups = new.select(group).distinct()
        old = written(self.read().join(groups, group, "left_semi").select(key), "old_keys")
        ranges = sorted({*self.touched(old, key), *self.touched(new, key)})
        if ranges:
            held = self.read(ranges)
            self._replace(ranges, held.join(groups, group, "left_anti").select(*held.columns).unionByName(new.select(*held.columns)))
        return ranges

    def rebalance(self, range_rows: int = RANGE_ROWS) -> RangeTable:
        """New bounds from the rows as they are now; the table is written anew at a new root, which is returned."""
        key, *_ = self._settings()
        return RangeTable(self.spark, f"{self.root}-{self.spark.range(1).select(F.expr('uuid()')).first()[0]}").create(self.read(), key, range_rows)
