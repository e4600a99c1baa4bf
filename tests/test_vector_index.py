import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import search
from quillstone.operators.vector_index import Quantiser, VectorIndex, closest, lloyd, recall
from quillstone.plans import retrieval


def clouds(n, dims=24, centres=40, seed=1):
    """Unit vectors around common centres."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims))
    x = middle[rng.integers(0, centres, n)] + 0.5 * rng.normal(size=(n, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x, name="doc_key"):
    return spark.createDataFrame([(f"k{i:05d}", v) for i, v in enumerate(x.tolist())], f"{name} string, embedding array<double>")


def asked_of(spark, x):
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "query_id long, q array<double>")


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    x = clouds(4000)
    rows = frame(spark, x)
    return x, rows, VectorIndex(spark, f"file://{tmp_path_factory.mktemp('ivf')}/v").build(rows, cells=60, parts=8, sample=1500)


def test_recall_and_exact_scores(spark, built):
    x, rows, index = built
    asked = asked_of(spark, clouds(30, seed=1)[:30] + 0.05)
    exact = search.nearest(rows, asked)
    found = index.search(asked, probes=12)
    assert index.rows().count() == len(x)
    assert recall(found, exact) >= 0.9
    scores = {(r["query_id"], r["doc_key"]): r["score"] for r in search.nearest(rows, asked, 4000).collect()}
    got = found.collect()
    assert len(got) == 30 * search.PER_RETRIEVER and all(abs(scores[r["query_id"], r["key"]] - r["score"]) < 1e-6 for r in got)
    # all cells, scored deep: nothing is lost
    assert recall(index.search(asked, probes=60, deep=300), exact) == 1.0


def test_only_probed_cells_are_read(spark, built):
    _, _, index = built
    asked = asked_of(spark, clouds(1, seed=5))
    cells = sorted({r["cell"] for r in index.probe(asked, 3).collect()})
    assert len(cells) == 3
    plan = index.rows(cells)._jdf.queryExecution().executedPlan().toString()
    named = re.search(r"PartitionFilters: \[(.*?)\], Push", plan.replace("\n", " "))[1]
    assert all(str(c) in named for c in cells) and "cell" in named
    assert {r["cell"] for r in index.rows(cells).select("cell").distinct().collect()} <= set(cells)
    hits = index.search(asked, probes=3).select("key").collect()
    held = {r["key"] for r in index.rows(cells).select("key").collect()}
    assert hits and {r["key"] for r in hits} <= held


def test_rows_are_added_without_learning_again(spark, tmp_path):
    x = clouds(600, seed=3)
    rows = frame(spark, x)
    index = VectorIndex(spark, f"file://{tmp_path}/v").build(rows.filter("doc_key < 'k00500'"), cells=10)
    before = index.quantiser().centroids
    index.add(rows.filter("doc_key >= 'k00500'"))
    assert (index.quantiser().centroids == before).all() and index.rows().count() == 600
    asked = asked_of(spark, x[590:])
    top = index.search(asked, 1, probes=10, deep=600).collect()
    assert {(r["query_id"], r["key"]) for r in top} == {(i, f"k{590 + i:05d}") for i in range(10)}


def test_edge_cases(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", None), (None, [1.0, 1.0]), ("d", [1.0, 0.0])], "doc_key string, embedding array<double>").withColumn("cell", F.lit(9))
    index = VectorIndex(spark, f"file://{tmp_path}/v").build(rows)
    got = index.search(asked_of(spark, np.array([[1.0, 0.0]])), 5, probes=9).collect()
    assert [(r["key"], r["score"], r["pos"]) for r in sorted(got, key=lambda r: r["pos"])] == [("a", 1.0, 1), ("d", 1.0, 2), ("b", 0.0, 3)]
    assert index.search(asked_of(spark, np.array([[1.0, 0.0]])).limit(0), 5).count() == 0
    with pytest.raises(ValueError, match="needs a vector"):
        VectorIndex(spark, f"file://{tmp_path}/w").build(rows.limit(0))


def test_quantiser():
    x = clouds(500)
    centres = lloyd(x, 12)
    near, gap = closest(x, centres)
    want = ((x[:, None] - centres[None]) ** 2).sum(2)
    assert (near == want.argmin(1)).all() and np.allclose(gap, want.min(1))
    q = Quantiser.learn(x, 12, 8)
    cell, codes = q.encode(x)
    again = q.centroids[cell] + np.concatenate([w[codes[:, k]] for k, w in enumerate(q.words)], 1)
    assert ((again - x) ** 2).sum(1).mean() < 0.5 * gap.mean()
    own = np.flatnonzero(cell == cell[0])
    assert np.allclose(q.scores(x[:3], cell[0], codes[own]), x[:3] @ again[own].T)


def test_probes_are_measured():
    near = Quantiser.learn(clouds(2000), 40, 4)
    rng = np.random.default_rng(2)
    noise = rng.normal(size=(2000, 24))
    far = Quantiser.learn(noise / np.linalg.norm(noise, axis=1, keepdims=True), 40, 4)
    assert near.probes <= 12 < far.probes <= 40


def test_registered_recall(spark, sf_dir):
    found = retrieval.rt01_index(spark, sf_dir).withColumnRenamed("doc_key", "key")
    assert recall(found, retrieval.rt01(spark, sf_dir)) >= 0.9


def plain_nearest(rows, asked, k):
    """The definition, by Spark's own expressions over all pairs."""
    from pyspark.sql import functions as F

    from quillstone.functions.values import dot

    pairs = rows.crossJoin(asked).select("query_id", "doc_key", F.round(dot(F.col("embedding"), F.col("q")), 6).alias("score"))
    return search.top_k(pairs, k)


def test_nearest_is_the_plain_search(spark, monkeypatch):
    """Groups of rows and queries, many copies, ties of rounded scores, nulls, NaN and other lengths: equal to the plain search, without a plan of all pairs."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(60, 3)), np.tile([[0.5, 0.25, 1.0]], (90, 1)), np.round(rng.normal(size=(60, 3)), 1), 0.5 + rng.normal(size=(60, 3)) * 1e-7])
    odd = [("a", None), ("b", [1.0]), ("c", [1.0, None, 2.0]), ("d", [float("nan"), 0.0, 1.0]), ("e", []), (None, [9.0, 9.0, 9.0])]
    rows = frame(spark, x).unionByName(spark.createDataFrame(odd, "doc_key string, embedding array<double>"))
    q = [(i, v) for i, v in enumerate(np.round(rng.normal(size=(12, 3)), 2).tolist())] + [(50, None), (51, [2.0]), (52, []), (53, [1e9, 1.0, 1.0]), (None, [0.0, 0.0, 0.0])]
    asked = spark.createDataFrame(q, "query_id long, q array<double>")
    for k in (4, 400):
        want = sorted(map(str, plain_nearest(rows, asked, k).collect()))
        for per_part, per_block in ((32_768, 16_384), (40, 5)):
            monkeypatch.setattr(search, "VECTOR_ROWS", per_part)
            monkeypatch.setattr(search, "QUERY_ROWS", per_block)
            found = search.nearest(rows, asked, k)
            assert sorted(map(str, found.collect())) == want
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "NestedLoop" not in plan and "Cartesian" not in plan
    monkeypatch.setattr(search, "SCORES", 64)
    assert sorted(map(str, search.nearest(rows, asked, 400).collect())) == want
    assert search.nearest(rows.filter("doc_key = 'none'"), asked).count() == 0
