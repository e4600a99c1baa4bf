"""Bounded samples of labelled documents for the models that are trained."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import materialise


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fold that no model learns from: crc32 of the id's text, mod 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, bound: int, features: Callable, name: str) -> DataFrame:
    """doc_id, y (label 0/1), f (features) of about `bound` labelled documents outside the held-out fold.

    Labels of one id are averaged and rounded; rows without an id or a label are left out. If there are more
    labelled ids than the bound, those with the smallest hashes of the id are taken. features maps an iterator of
    Arrow batches (doc_id, text, y) to batches (doc_id, y, f binary); of rows with the same id one is kept.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", F.col(label).cast("double").alias("y"))
    known = known.filter(~held_out()).groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    n = max(1, known.count())
    if n > bound:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(label)), F.lit(1_000_003)) < int(1_000_003 * bound / n))
    known = materialise(known.coalesce(1), name)
    picked = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    rows = picked.select("doc_id", "text", "y").mapInArrow(features, "doc_id long, y int, f binary")
    return rows.groupBy("doc_id").agg(F.min(F.struct("y", "f")).alias("r")).select("doc_id", "r.*")


def labelled_features(docs: DataFrame, labels: DataFrame, label: str, bound: int, features: Callable, name: str) -> tuple[list[bytes], np.ndarray]:
    """(features, label 0/1) of `labelled_rows` in order of id, on the driver: for features of a few numbers only."""
    rows = labelled_rows(docs, labels, label, bound, features, name).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return [bytes(r["f"]) for r in rows], np.array([r["y"] for r in rows], np.int64)
