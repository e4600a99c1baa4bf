"""Connected components of a graph given by edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import discard, materialise


def _minimum(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(v, root) for every node of edges(u, v), both long: root is the smallest id of v's component.

    Every round is written to the shared folder, so lineage stays short; rounds grow with the logarithm of the
    longest path. Raises if the rounds do not suffice, so a result is always whole.
    """
    e = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_minimum(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        small = large.join(_minimum(large), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v")))
        old, e = e, materialise(small.filter("u <> v").distinct(), "edges")
        discard(old)
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            roots = e.select(F.col("u").alias("v"), F.col("v").alias("root"))
            return roots.unionAll(roots.select(F.col("root").alias("v"), "root").distinct())
        before = now
    raise RuntimeError(f"components: not settled after {most_rounds} rounds")
