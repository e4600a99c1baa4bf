import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from quillstone.llm import ngram_join
from quillstone.llm.components import components


def brute(rows, t=0.8, n=5):
    """{doc_id: (class_id, n_links)} for unique ids."""
    sets, where = {}, defaultdict(list)
    for i, text in rows:
        w = (text or "").lower().encode().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
        for f in sets[i]:
            where[f].append(i)
    links = defaultdict(set)
    for i, s in sets.items():
        for j in {j for f in s for j in where[f] if j < i}:
            both = len(s & sets[j])
            if 5 * both >= 4 * (len(s) + len(sets[j]) - both):
                links[i].add(j)
                links[j].add(i)
    out = {}
    for i in sorted(sets):
        if i not in out:
            todo, seen = [i], {i}
            while todo:
                for j in links[todo.pop()] - seen:
                    seen.add(j)
                    todo.append(j)
            out |= {j: (i, len(links[j])) for j in seen}
    return out


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.op8_ngram_jaccard_join(spark, sf_dir).collect()}
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_dense_group_in_blocks(spark):
    rnd = random.Random(5)
    base = [f"w{rnd.randint(0, 400)}" for _ in range(150)]
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(rnd.randint(0, 6)):
            w[rnd.randrange(len(w))] = f"x{rnd.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, rows[i % 3][1]) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (1024, 16):
        got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.near_classes(docs, block=block).collect()}
        assert got == brute(rows)
    assert sorted(r["doc_id"] for r in ngram_join.one_of_each(docs).collect()) == sorted({c for c, _ in brute(rows).values()})


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "two words"), (4, "Two  words"), (4, "Two  words"), (None, "two words"), (None, "alone here"), (None, "and there"), (7, "a " * 50000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("group", F.lit(1)).withColumn("th", F.lit("x"))
    got = sorted(map(str, map(tuple, ngram_join.jaccard_join(docs).collect())))
    want = [(1, 1, 0), (2, 2, 0), (3, 3, 3), (4, 3, 3), (4, 3, 3), (None, 3, 3), (None, None, 0), (None, None, 0), (7, 7, 0)]
    assert got == sorted(map(str, want))
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == 6
    assert ngram_join.jaccard_join(docs.filter(F.lit(False))).count() == 0


def test_pruning_keeps_true_pairs():
    least = ngram_join.least_matches(0.8)
    rnd = np.random.default_rng(1)
    m = np.cumsum(rnd.random((20000, 160)) < 0.8, axis=1)[:, 15::16]
    assert (m >= least[1:]).all(1).mean() > 0.999


def test_components_of_a_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).unionAll(spark.createDataFrame([(900, 901)], "u long, v long"))
    got = {r["v"]: r["root"] for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 900: 900, 901: 900}


def test_blocks_are_bounded_by_bytes_and_links_by_ranges(spark, monkeypatch):
    """A group of few but long texts is cut into blocks too; the answers are those of one block and of one range."""
    rnd = random.Random(6)
    base = [f"w{rnd.randint(0, 900)}" for _ in range(400)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rnd.randint(0, 14)):
            w[rnd.randrange(len(w))] = f"x{rnd.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.near_classes(docs, block_bytes=20_000).collect()}
    assert got == brute(rows)
    sets = [np.unique(np.array([hash(x) % 2**64 for x in zip(t.split(), t.split()[1:])], np.uint64)) for _, t in rows]
    a, b = (x.astype(np.int64) for x in np.triu_indices(len(sets), 1))
    exact = [len(np.intersect1d(sets[i], sets[j])) >= 0.9 * len(np.union1d(sets[i], sets[j])) - 1e-9 for i, j in zip(a, b)]
    taken, unique = [], np.unique
    monkeypatch.setattr(np, "unique", lambda x, **k: (taken.append(len(x)), unique(x, **k))[1])
    assert 0 < sum(exact) < len(exact) and ngram_join.exact_links(a, b, sets, 0.9, at_once=1000).tolist() == exact
    assert max(taken[1:]) <= 2000


def test_whole_runs():
    import pyarrow as pa

    for cuts in ([0, 9], [0, 1, 2, 3, 4, 5, 6, 7, 8, 9], [0, 2, 4, 9], [0, 3, 3, 8, 9]):
        key, x = [1, 1, 1, 1, 2, 2, 3, 4, 4], list(range(9))
        batches = [pa.RecordBatch.from_pydict({"key": pa.array(key[i:j], pa.int64()), "x": pa.array(x[i:j], pa.int64())}) for i, j in zip(cuts, cuts[1:])]
        got = [(t.column("x").to_pylist()[i:j]) for t, s in ngram_join._whole_runs(batches, ["key"]) for i, j in zip(s, [*s[1:], t.num_rows])]
        assert got == [[0, 1, 2, 3], [4, 5], [6], [7, 8]]
