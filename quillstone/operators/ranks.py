"""Numbers and prefix sums along an order, without a window over all rows or over a group that may hold most of them.

Rows are range-partitioned by group and order and written; a row's number within its partition is known then, and so is a small table of
what every partition holds of every group. Sums over that table, which has at most one row a partition and group, carry on what the
partitions before hold. So a group of any size spreads over partitions, and only its few partial sums meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.search import small
from quillstone.session import written


def _ordered(df: DataFrame, group: list[str], order: list[Column | str]) -> DataFrame:
    """df in order, with _part and _row: the number of the partition and, within it, of the row."""
    keys = [*group, *order]
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    rows = written(rows, "ordered")
    return rows.withColumns({"_part": F.shiftright("_id", 33), "_row": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id")


def _carried(rows: DataFrame, group: list[str], weight: Column) -> DataFrame:
    """_part, the group's columns (as g0, g1 ...), _first (its first row there) and _before (the weights of the group in earlier partitions)."""
    own = rows.groupBy("_part", *group).agg(F.min("_row").alias("_first"), F.sum(weight).alias("_held"))
    before = F.coalesce(F.sum("_held").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)], "_first", before.cast("long").alias("_before"))


def _joined(rows: DataFrame, carried: DataFrame, group: list[str]) -> DataFrame:
    side = small(written(carried, "carried"))
    on = F.col("_part") == F.col("_p")
    for k, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    return rows.join(side, on).drop("_p", *[f"_g{k}" for k in range(len(group))])


def numbered(df: DataFrame, group: list[str], order: list[Column | str], name: str = "number") -> DataFrame:
    """df with the number (from 1) of each row within its group, in the given order; rows that the order does not tell apart are numbered in some order."""
    rows = _ordered(df, group, order)
    out = _joined(rows, _carried(rows, group, F.lit(1)), group)
    return out.withColumn(name, (F.col("_before") + F.col("_row") - F.col("_first") + 1).cast("long")).drop("_part", "_row", "_first", "_before")


def prefix_sums(df: DataFrame, group: list[str], order: list[Column | str], weight: str, name: str = "before") -> DataFrame:
    """df with the sum of a long column over the rows before each one in its group."""
    rows = _ordered(df, group, order)
    out = _joined(rows, _carried(rows, group, F.col(weight)), group)
    # within a partition and group, so no more than a partition's rows
    inside = F.sum(weight).over(Window.partitionBy("_part", *group).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn(name, (F.col("_before") + F.coalesce(inside, F.lit(0))).cast("long")).drop("_part", "_row", "_first", "_before")


def ranked(df: DataFrame, column: str, name: str = "place") -> DataFrame:
    """df with the rank of each row by a column (ascending, nulls last), equal values sharing the first place; by counts of distinct values."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    places = prefix_sums(counts, [], [F.col(column).asc_nulls_last()], "_n", "_before_it").select(F.col(column).alias("_value"), (F.col("_before_it") + 1).alias(name))
    return df.join(small(places), F.col(column).eqNullSafe(F.col("_value"))).drop("_value")


def length_batches(df: DataFrame, text: str, order: list[Column | str], size: int) -> DataFrame:
    """df with `place` (its number in the given order, from 1) and `batch`: batches of `size` rows of about equal length, the shortest first, ties by place.

    A scorer that pads a batch to its longest text takes the rows batch by batch; `place` brings the results back into the order of the input.
    """
    rows = numbered(df, [], order, "place").withColumn("_chars", F.coalesce(F.char_length(text), F.lit(0)))
    return numbered(rows, [], ["_chars", "place"], "_k").withColumn("batch", F.floor((F.col("_k") - 1) / size)).drop("_k", "_chars")


def scored_in_batches(df: DataFrame, text: str, order: list[Column | str], score, size: int = 4) -> DataFrame:
    """df with `score`, in the order of the input. score maps a list of texts, a batch of like lengths, to as many floats; it runs on executors."""
    import pandas as pd
    from pyspark.sql.types import DoubleType, StructField, StructType

    rows = length_batches(df, text, order, size)

    def run(frames):
        held = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            last = held["batch"].iloc[-1] if len(held) else None
            yield from _scored(held[held["batch"] != last])
            held = held[held["batch"] == last]
        if held is not None:
            yield from _scored(held)

    def _scored(frame):
        for _, own in frame.groupby("batch", sort=True):
            yield own.assign(score=[float(x) for x in score(own[text].fillna("").tolist())])

    schema = StructType([*rows.schema.fields, StructField("score", DoubleType())])
    dealt = rows.repartitionByRange("batch").sortWithinPartitions("batch", "place")
    return dealt.mapInPandas(run, schema).orderBy("place")
