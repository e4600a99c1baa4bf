"""Trees of spans: depth, time along the path, time with everything below, and the critical path of every trace.

The tree is walked by a recursive query over parent ids, all traces at once and a level a step; no loop runs on the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.session import written

#: Levels that a tree may have; the walk raises beyond it.
MOST_DEPTH = 1000


def span_tree(spans: DataFrame) -> DataFrame:
    """trace, span, depth, path_time, total, critical of spans(trace, span, parent, own); a root's parent is null.

    path_time adds own times from the root, total is a span's own time and that of all below it, and critical marks the path of the
    largest path_time in a trace (the smaller span on ties). Spans that no root leads to are left out.
    """
    spark, name = spans.sparkSession, f"spans_{uuid.uuid4().hex}"
    written(spans.select("trace", "span", "parent", F.col("own").cast("long").alias("own")), "spans").createOrReplaceTempView(name)
    limits = {"spark.sql.cteRecursionRowLimit": "-1", "spark.sql.cteRecursionLevelLimit": str(MOST_DEPTH)}
    before = {k: spark.conf.get(k) for k in limits}
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        walked = spark.sql(f"""WITH RECURSIVE walk(trace, span, own, depth, path_time, path) AS (
            SELECT trace, span, own, 0, own, array(span) FROM {name} WHERE parent IS NULL
            UNION ALL SELECT s.trace, s.span, s.own, w.depth + 1, w.path_time + s.own, array_append(w.path, s.span) FROM walk w JOIN {name} s ON s.trace = w.trace AND s.parent = w.span)
            SELECT * FROM walk""")
        walked = written(walked, "walked")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.catalog.dropTempView(name)
    total = walked.select("trace", F.explode("path").alias("span"), "own").groupBy("trace", "span").agg(F.sum("own").alias("total"))
    last = walked.groupBy("trace").agg(F.max_by("path", F.struct("path_time", (-F.col("span")).alias("first"))).alias("longest"))
    return walked.join(total, ["trace", "span"]).join(last, "trace").select("trace", "span", "depth", "path_time", "total", F.array_contains("longest", F.col("span")).alias("critical"))

