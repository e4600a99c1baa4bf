import os

import pytest
from pyspark.sql import functions as F

from quillstone.sources.ranges import RangeTable


def files(folder):
    return {os.path.relpath(os.path.join(at, f), folder): os.stat(os.path.join(at, f)).st_mtime_ns for at, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


@pytest.fixture
def made(spark, tmp_path):
    rows = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") % 7).cast("int").alias("g"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"))
    return RangeTable(spark, f"file://{tmp_path}/t").create(rows, "k", 100), tmp_path / "t"


def state(table):
    rows = [tuple(r) for r in table.read().collect()]
    assert len(rows) == len({r[0] for r in rows})
    return {r[0]: r[1:] for r in rows}


def test_upsert_of_a_hundredth_leaves_other_files(spark, made):
    table, folder = made
    before = files(folder)
    assert sum("range=" in f for f in before) == 20
    new = spark.range(500, 520).selectExpr("id AS k", "'new' AS v").unionAll(spark.sql("SELECT 505L AS k, 'twice' AS v WHERE false"))
    ranges = table.upsert(new)
    after = files(folder)
    own = lambda f: any(f"range={r}/" in f for r in ranges)
    assert len(ranges) <= 2 and {f: t for f, t in before.items() if not own(f)} == {f: t for f, t in after.items() if not own(f)}
    want = {k: (k % 7, f"v{k}") for k in range(2000)} | {k: (None, "new") for k in range(500, 520)}
    assert state(table) == want
    table.upsert(new)  # repeated after a failure: nothing changes
    assert state(table) == want


def test_delete_can_empty_a_range(spark, made):
    table, folder = made
    table.delete(spark.range(0, 300).selectExpr("id AS k").unionAll(spark.sql("SELECT CAST(NULL AS LONG)")))
    assert state(table) == {k: (k % 7, f"v{k}") for k in range(300, 2000)}
    table.upsert(spark.sql("SELECT 10L AS k, 1 AS g, 'back' AS v"))
    assert state(table)[10] == (1, "back")


def test_patch_groups_and_bounds(spark, made):
    table, _ = made
    ranges = table.patch(spark.range(0, 5).selectExpr("id AS k"), {"v": F.concat(F.col("v"), F.lit("!"))})
    assert len(ranges) == 1 and state(table)[3] == (3, "v3!") and state(table)[5] == (5, "v5")
    table.replace_groups(spark.sql("SELECT 7000L AS k, 6 AS g, 'g' AS v"), "g")
    now = state(table)
    assert now[7000] == (6, "g") and not any(g == 6 and k != 7000 for k, (g, _) in now.items()) and len(now) == 2000 - 285 + 1
    assert state(table.rebalance(200)) == now


def test_string_keys_nulls_and_empty(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i:03d}", i) for i in range(50)] + [(None, -1)], "k string, n int")
    table = RangeTable(spark, f"file://{tmp_path}/s").create(rows, "k", 10)
    table.upsert(spark.createDataFrame([("k000", 9), ("a", 1), ("zz", 2)], "k string, n int"))
    assert state(table) == {f"k{i:03d}": (i,) for i in range(1, 50)} | {"k000": (9,), "a": (1,), "zz": (2,), None: (-1,)}
    none = RangeTable(spark, f"file://{tmp_path}/e").create(rows.limit(0), "k")
    assert state(none) == {} and none.upsert(rows.limit(0)) == [] and none.delete(rows.limit(0)) == []
    none.upsert(rows)
    assert len(state(none)) == 51
    with pytest.raises(ValueError, match="range"):
        RangeTable(spark, f"file://{tmp_path}/x").create(rows.withColumn("range", F.lit(1)), "k")
