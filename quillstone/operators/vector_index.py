"""Approximate vector search: k-means cells, product-quantised residuals, exact scores for the best of them.

Every vector belongs to the cell of its nearest centroid; what is left of it after the centroid is taken off is cut into parts, and each
part is replaced by the number of the nearest of at most 256 codewords. The index is a table partitioned by cell (key, code, embedding). A
search looks into the `probes` cells whose centroids are nearest to the query: the scan's partition filter names just
these cells, codes give a first score by table look-ups, and the `deep` best of a query are scored again on their vectors.

Centroids and codewords are learnt on the driver from at most `SAMPLE` vectors, those with the smallest hashes of their key; all rows
are indexed. How many cells a search looks into unless told is measured then: as many as the nearest neighbours of sampled vectors within
the sample need for a share of AIM to lie in them, so few where vectors form clouds, and many where they do not. Cells grow with the root of the number of rows, up to MOST_CELLS, and are dealt in parts of about PART_ROWS rows, so a large
cell spreads over tasks; queries that meet in a cell are scored in blocks. Vectors of any length are allowed: scores are dot products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.values import dot
from quillstone.operators.search import PER_RETRIEVER, small, top_k

#: Vectors that the quantisers learn from at most.
SAMPLE = 65_536
MOST_CELLS = 65_536
PART_ROWS = 131_072
QUERY_BLOCK = 256
#: Share of neighbours that the cells looked into should hold, and sampled vectors that this is measured with at most.
AIM, MEASURED = 0.97, 256
#: Distinct cells up to which a search names them in its partition filter; more are found by the join alone.
MOST_NAMED = 4096


def lloyd(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k centroids of rows (at least one), starting from rows spread evenly over the sample; an empty cluster takes the row that is worst served."""
    k = min(k, len(rows))
    centres = rows[np.linspace(0, len(rows) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near, gap = closest(rows, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        n = np.bincount(near, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        empty = np.flatnonzero(n == 0)
        centres[empty] = rows[np.argsort(-gap, kind="stable")[: len(empty)]]
    return centres


def closest(rows: np.ndarray, centres: np.ndarray, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centre of every row."""
    near, gap, norm = np.empty(len(rows), np.int64), np.empty(len(rows)), (centres**2).sum(1)
    for a in range(0, len(rows), block):
        d = norm - 2 * rows[a : a + block] @ centres.T
        near[a : a + block] = d.argmin(1)
        gap[a : a + block] = d.min(1) + (rows[a : a + block] ** 2).sum(1)
    return near, gap


class Quantiser:
    """Centroids (cells, dims), codewords (parts, words, dims of a part) and the number of cells to look into, as they are stored."""

    def __init__(self, centroids: np.ndarray, words: list[np.ndarray], probes: int = 8):
        self.centroids, self.words, self.probes = centroids, words, probes

    @classmethod
    def learn(cls, rows: np.ndarray, cells: int, parts: int, words: int = 256) -> Quantiser:
        centroids = lloyd(rows, cells)
        left = rows - centroids[closest(rows, centroids)[0]]
        out = cls(centroids, [lloyd(piece, words) for piece in np.array_split(left, parts, axis=1)])
        out.probes = out.needed(rows)
        return out

    def needed(self, rows: np.ndarray, k: int = PER_RETRIEVER, aim: float = AIM) -> int:
        """Cells that have to be looked into for a share of `aim` of the k nearest rows of some of the rows."""
        asked, cell = rows[:MEASURED], closest(rows, self.centroids)[0]
        order = self.probed(asked, len(self.centroids))
        place = np.argsort(order, axis=1)
        best = np.argsort(-(asked @ rows.T), axis=1, kind="stable")[:, :k]
        return int(np.quantile(np.take_along_axis(place, cell[best], 1), aim, method="higher")) + 1

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, code as bytes) of every row."""
        cell, _ = closest(rows, self.centroids)
        pieces = np.array_split(rows - self.centroids[cell], len(self.words), axis=1)
        return cell, np.stack([closest(p, w)[0] for p, w in zip(pieces, self.words, strict=True)], 1).astype(np.uint8)

    def probed(self, queries: np.ndarray, probes: int) -> np.ndarray:
        """Numbers of the cells to look into, the nearest first; (queries, probes)."""
        d = (self.centroids**2).sum(1) - 2 * queries @ self.centroids.T
        return np.argsort(d, axis=1, kind="stable")[:, :probes]

    def scores(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Dot products of queries with the vectors that the codes stand for; (queries, codes)."""
        out = np.repeat((queries @ self.centroids[cell])[:, None], len(codes), 1)
        for k, (q, w) in enumerate(zip(np.array_split(queries, len(self.words), axis=1), self.words, strict=True)):
            out += (q @ w.T)[:, codes[:, k]]
        return out


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class VectorIndex:
    """An index in a folder: `cells` (partitioned by cell), `quantiser` (centroids and codewords), each as Parquet."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def build(self, vectors: DataFrame, key: str = "doc_key", cells: int | None = None, parts: int = 16, sample: int = SAMPLE) -> VectorIndex:
        """Learn from a sample of vectors(key, embedding) and index all of them; rows without an embedding are left out."""
        rows = vectors.select(F.col(key).alias("key"), F.col("embedding").cast("array<double>").alias("embedding")).filter("key IS NOT NULL AND embedding IS NOT NULL")
        n = rows.count()
        if not n:
            raise ValueError("an index needs a vector")
        share = F.pmod(F.xxhash64("key"), F.lit(1_000_003)) < int(1_000_003 * min(1.0, sample / n))
        learnt = rows.filter(share).orderBy(F.xxhash64("key")).limit(sample).select("embedding").toArrow()
        if not learnt.num_rows:
            learnt = rows.limit(1).select("embedding").toArrow()
        matrix = _matrix(learnt["embedding"])
        cells = cells or max(1, min(MOST_CELLS, round(n**0.5)))
        q = Quantiser.learn(matrix, min(cells, len(matrix)), min(parts, matrix.shape[1]))
        kept = [("centroid", k, v) for k, v in enumerate(q.centroids.tolist())] + [(f"word{p:04d}", k, v) for p, w in enumerate(q.words) for k, v in enumerate(w.tolist())]
        kept.append(("probes", q.probes, []))
        self.spark.createDataFrame(pd.DataFrame(kept, columns=["kind", "number", "vector"]), "kind string, number int, vector array<double>").coalesce(1).write.parquet(f"{self.folder}/quantiser")
        self.add(vectors, key)
        return self

    def quantiser(self) -> Quantiser:
        rows = self.spark.read.parquet(f"{self.folder}/quantiser").orderBy("kind", "number").toPandas()  # bounded by the sample
        probes = int(rows.loc[rows["kind"] == "probes", "number"].iloc[0])
        by = {k: np.array(g["vector"].tolist()) for k, g in rows[rows["kind"] != "probes"].groupby("kind")}
        return Quantiser(by.pop("centroid"), [by[k] for k in sorted(by)], probes)

    def add(self, vectors: DataFrame, key: str = "doc_key") -> None:
        """Index further vectors with the quantiser as it is; a key must not be in the index yet."""
        q = self.spark.sparkContext.broadcast(self.quantiser())

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    cell, codes = q.value.encode(_matrix(b.column(1)))
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], names=["key", "embedding", "cell", "code"])

        rows = vectors.select(F.col(key).alias("key"), F.col("embedding").cast("array<double>").alias("embedding")).filter("key IS NOT NULL AND embedding IS NOT NULL")
        kind = dict(rows.dtypes)["key"]
        coded = rows.mapInArrow(encode, f"key {kind}, embedding array<double>, cell int, code binary")
        # one file a cell, or several where it is large; codes first, so a scan of codes reads no embedding
        coded.select("key", "code", "embedding", "cell").repartition("cell").sortWithinPartitions("cell").write.mode("append").partitionBy("cell").parquet(f"{self.folder}/cells")

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        """The index's rows, of the given cells only: a partition filter."""
        rows = self.spark.read.parquet(f"{self.folder}/cells")
        return rows if cells is None else rows.filter(F.col("cell").isin(cells))

    def probe(self, queries: DataFrame, probes: int | None = None) -> DataFrame:
        """query_id, q, cell: the cells that each query looks into."""
        q = self.spark.sparkContext.broadcast(self.quantiser())
        kind = dict(queries.dtypes)["query_id"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    cells = q.value.probed(_matrix(b.column(1)), probes or q.value.probes)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cells.tolist(), pa.list_(pa.int32()))], names=["query_id", "q", "cells"])

        asked = queries.select("query_id", F.col("q").cast("array<double>").alias("q")).filter("q IS NOT NULL")
        return asked.mapInArrow(run, f"query_id {kind}, q array<double>, cells array<int>").select("query_id", "q", F.explode("cells").alias("cell"))

    def search(self, queries: DataFrame, k: int = PER_RETRIEVER, probes: int | None = None, deep: int = 10) -> DataFrame:
        """query_id, key, score, pos: the k best of the probed cells for each of queries(query_id, q); deep * k of them are scored exactly."""
        from quillstone.session import written

        asked = written(self.probe(queries, probes), "probes")
        named = [r["cell"] for r in asked.select("cell").distinct().limit(MOST_NAMED + 1).collect()]
        rows = self.rows(named if len(named) <= MOST_NAMED else None)
        q = self.spark.sparkContext.broadcast(self.quantiser())
        kinds = dict(rows.dtypes)["key"], dict(asked.dtypes)["query_id"]
        most = deep * k

        def score(codes: pa.Table, wanted: pa.Table) -> pa.Table:
            """The best of a part of a cell for the queries that look into it, a block of queries at a time."""
            out = []
            if codes.num_rows and wanted.num_rows:
                cell = codes["cell"][0].as_py()
                coded = np.frombuffer(b"".join(codes["code"].to_pylist()), np.uint8).reshape(codes.num_rows, -1)
                for a in range(0, wanted.num_rows, QUERY_BLOCK):
                    block = wanted.slice(a, QUERY_BLOCK)
                    s = q.value.scores(_matrix(block["q"]), cell, coded)
                    best = np.argpartition(-s, min(most, s.shape[1]) - 1, axis=1)[:, :most]
                    ids, n = block["query_id"].combine_chunks(), best.shape[1]
                    out.append(pa.table({"query_id": ids.take(pa.array(np.repeat(np.arange(len(best)), n))), "key": codes["key"].combine_chunks().take(pa.array(best.ravel())), "score": np.take_along_axis(s, best, 1).ravel()}))
            empty = pa.table({"query_id": wanted["query_id"][:0], "key": codes["key"][:0], "score": pa.array([], pa.float64())})
            return pa.concat_tables(out) if out else empty

        sizes = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts"))
        sizes = written(sizes, "cell_parts")  # one row a cell, at most MOST_CELLS
        dealt = rows.select("cell", "key", "code").join(F.broadcast(sizes), "cell").select("cell", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"), "key", "code")
        wanted = asked.join(F.broadcast(sizes), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "query_id", "q")
        first = dealt.groupBy("cell", "part").cogroup(wanted.groupBy("cell", "part")).applyInArrow(score, f"query_id {kinds[1]}, key {kinds[0]}, score double")
        candidates = top_k(first, most, "key").select("query_id", "key")
        exact = rows.select("key", "embedding").join(small(written(candidates, "candidates")), "key").join(small(queries.select("query_id", "q")), "query_id")
        return top_k(exact.select("query_id", "key", F.round(dot(F.col("embedding"), F.col("q")), 6).alias("score")), k, "key")


def recall(found: DataFrame, exact: DataFrame, key: str = "doc_key") -> float:
    """The share of the rows of exact(query_id, key) that found(query_id, key) holds; 1 where there are none."""
    n = exact.count()
    return exact.select("query_id", F.col(key).alias("key")).join(found.select("query_id", "key"), ["query_id", "key"], "left_semi").count() / n if n else 1.0
