import os
import random

from pyspark.sql import functions as F

from quillstone.operators import search
from quillstone.operators.postings import PostingsIndex

FIELDS = {"content": 1.0, "title": 2.0, "section_headers": 1.0}
SCHEMA = "doc_key string, title string, content string, section_headers string"


def docs(spark, n, seed=1):
    """Random texts of skewed words; some fields empty or null, some documents alike."""
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(5000)]
    text = lambda most: " ".join(rng.choice(words) for _ in range(rng.randint(0, most)))
    rows = [(f"d{i:05d}", rng.choice([None, "", text(6)]), text(60) if i % 9 else "same text w1 w2", rng.choice(["w1 methods", "results", None])) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def asked(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")


def rows_of(df):
    return sorted((r["query_id"], r["doc_key"], round(r["score"], 6), r["pos"]) for r in df.collect())


QUERIES = ("w1 w2 w3", "w1", "nothing here", "", "w900 results w7 w7", "methods W1", "same text")


def test_equal_to_a_full_search(spark, tmp_path):
    d, q = docs(spark, 900), asked(spark, *QUERIES)
    index = PostingsIndex(spark, f"file://{tmp_path}/p").build(d, FIELDS, block_docs=16, group_docs=200)
    for k in (1, 5, 15, 2000):
        assert rows_of(index.search(q, k, first=2)) == rows_of(search.bm25(d, q, FIELDS, k=k))


def test_blocks_that_cannot_matter_are_not_read(spark, tmp_path):
    """Rare words stand in few blocks, and a common one adds blocks whose bound stays below the best scores."""
    rows = [(f"d{i:05d}", None, "common " * (1 + i % 3) + "filler " * 20 + ("rare " * 5 if i % 200 == 0 else ""), None) for i in range(2000)]
    d, q = spark.createDataFrame(rows, SCHEMA), asked(spark, "common rare")
    index = PostingsIndex(spark, f"file://{tmp_path}/p").build(d, FIELDS, block_docs=20, group_docs=500)
    found, blocks = index.traced(q, 5)
    assert rows_of(found) == rows_of(search.bm25(d, q, FIELDS, k=5))
    n, read = blocks.count(), blocks.filter("read").count()
    assert n > 60 and read <= 20
    plan = index._postings(asked(spark, "rare").select(F.lit("rare").alias("term")))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,rare)]" in plan or "In(term, [rare])" in plan


def _files(folder):
    return {os.path.relpath(os.path.join(at, f), folder): os.stat(os.path.join(at, f)).st_mtime_ns for at, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_update_rewrites_only_its_groups(spark, tmp_path):
    d, q = docs(spark, 800), asked(spark, *QUERIES)
    index = PostingsIndex(spark, f"file://{tmp_path}/p").build(d, FIELDS, block_docs=16, group_docs=50)
    before = _files(tmp_path / "p")
    changed = spark.createDataFrame([("d00003", "w1 w1", "w3 new words", None), ("new", "w2", "w900 results", "w1")], SCHEMA)
    removed = spark.createDataFrame([("d00010",), ("not there",)], "doc_key string")
    touched = index.update(changed, removed=removed)
    after = _files(tmp_path / "p")
    assert 0 < len(touched) <= 4
    own = lambda f: any(f"group={g}/" in f for g in touched)
    assert {f: t for f, t in before.items() if not own(f)} == {f: t for f, t in after.items() if not own(f)}
    now = d.filter("doc_key NOT IN ('d00003', 'd00010')").unionByName(changed)
    assert rows_of(index.search(q)) == rows_of(search.bm25(now, q, FIELDS))
    assert index.update(changed.limit(0)) == []


def test_edge_cases(spark, tmp_path):
    q = asked(spark, *QUERIES)
    empty = PostingsIndex(spark, f"file://{tmp_path}/e").build(docs(spark, 5).limit(0), FIELDS)
    assert empty.search(q).count() == 0
    one = spark.createDataFrame([("a", None, None, None), ("b", "w1", "w1 " * 100_000, "")], SCHEMA).withColumn("term", F.lit("w1")).withColumn("block", F.lit(3))
    index = PostingsIndex(spark, f"file://{tmp_path}/o").build(one, FIELDS)
    assert rows_of(index.search(q)) == rows_of(search.bm25(one, q, FIELDS))
    index.update(one.limit(0), removed=one.select("doc_key"))
    assert index.search(q).count() == 0


def test_postings_are_built_without_shuffling_them(spark, tmp_path, monkeypatch):
    """Documents meet once, as texts; what they are counted and listed into is written where it arises."""
    from quillstone.operators import postings

    monkeypatch.setattr(postings, "STRIP_DOCS", 64)
    d, q = docs(spark, 900), asked(spark, *QUERIES)
    plans = []
    write = PostingsIndex._write
    monkeypatch.setattr(PostingsIndex, "_write", lambda self, rows, lengths, mode: plans.append(rows._jdf.queryExecution().executedPlan().toString().count("Exchange")) or write(self, rows, lengths, mode))
    index = PostingsIndex(spark, f"file://{tmp_path}/p").build(d, FIELDS, block_docs=16, group_docs=300)
    assert plans == [1]
    assert rows_of(index.search(q, 15, first=2)) == rows_of(search.bm25(d, q, FIELDS, k=15))
    # of a term, a field and a block there is one row, and a group has several files
    rows = index._read("postings")
    assert rows.count() == rows.select("group", "term", "field", "block").distinct().count()
    assert all(1 < len(os.listdir(tmp_path / "p" / "postings" / g)) for g in os.listdir(tmp_path / "p" / "postings") if g.startswith("group="))
