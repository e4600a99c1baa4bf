import time

import pytest
from pyspark.sql import functions as F

from quillstone.llm import fingerprints, url_filters
from quillstone.llm.registry import ORACLES, QUERIES
from tests.oracle import compare, duck


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir), ORACLES[name], duck(sf_dir)) > 0


@pytest.mark.parametrize("max_bits", [url_filters.MAX_BITS, 64])
def test_cascade_is_exact(spark, max_bits):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    cascade = url_filters.build_cascade(keys, 0.3, max_bits, 512)
    assert len(cascade.levels) > 2 and (cascade.shards > 1) == (max_bits == 64)
    rows = url_filters.with_membership(keys, cascade, "key", "got")
    assert rows.count() == 5000 and rows.filter("got <> listed").count() == 0
    for condition in ("true", "false"):
        same = keys.withColumn("listed", F.expr(condition))
        cascade = url_filters.build_cascade(same, 0.3, max_bits, 512)
        assert url_filters.with_membership(same, cascade, "key", "got").filter("got <> listed").count() == 0


def test_listed_domains(spark):
    hosts = spark.createDataFrame([(h,) for h in ("a.b.c", "b.c", "xb.c", "c", "", "spam-farm.net")], "key string")
    domains = spark.createDataFrame([(" B.c",), (None,), ("",), ("b.c",), ("zz",)], "domain string")
    assert {r["key"]: r["listed"] for r in url_filters.host_universe(hosts, domains).collect()} == {"a.b.c": True, "b.c": True, "xb.c": False, "c": False, "": False, "spam-farm.net": False}


def test_url_edges(spark):
    rows = [(1, None), (2, "no scheme"), (3, "HTTP://WWW.Spam-Farm.net?x"), (3, "HTTP://WWW.Spam-Farm.net?x"), (4, "https://a.example.org/en/12"), (5, "x://org"), (None, "x://org/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("key", F.lit(1)).withColumn("host", F.lit(1))
    want = [(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "www.spam-farm.net", "", None, "block"), (3, "www.spam-farm.net", "", None, "block"), (4, "a.example.org", "/en/12", "example.org/en/1", "block"), (5, "org", "", None, "allow"), (None, "org", "/", "org/", "allow")]
    for bits in (url_filters.MAX_BITS, 1):
        assert sorted(map(str, map(tuple, url_filters.filter_urls(pages, max_bits=bits).collect()))) == sorted(map(str, want))
    assert url_filters.filter_urls(pages.filter(F.lit(False))).count() == 0


def test_fingerprint_edges(spark):
    rows = [(3, "a" * 200 + "\nb"), (3, None), (2, "x é " * 3000), (None, ""), (None, "z"), (1, "same"), (0, "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bucket", F.lit(9)).withColumn("n_chars", F.lit(None))
    got = fingerprints.fingerprints(docs).collect()
    assert len(got) == len(rows)
    same = [r for r in got if r["doc_id"] in (0, 1)]
    assert same[0]["fingerprint"] == same[1]["fingerprint"]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert fingerprints.fingerprints(docs.filter(F.lit(False))).count() == 0
    one = fingerprints.fingerprints(docs.filter("doc_id = 2")).first()
    assert one["near_next"] == 1.0 and one["n_chars"] == 12000


def test_order_across_runs(spark):
    docs = spark.range(1, 5000, 3).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    got = {r["doc_id"]: r["next_text"] for r in fingerprints.with_next(docs).collect()}
    ids = sorted(got, reverse=True)
    assert all(got[a] == f"t{b}" for a, b in zip(ids, ids[1:] + ids[:1]))


def test_order_with_a_hot_id(spark):
    ids = [(i, f"t{i}") for i in range(600)] + [(300, f"hot {i}") for i in range(5000)] + [(301, f"warm {i}") for i in range(3000)]
    docs = spark.createDataFrame(ids, "doc_id long, text string")
    got = fingerprints.with_next(docs)
    tie = F.conv(F.hex(F.xxhash64("text")), 16, 10).cast("decimal(20,0)")
    want = [r["text"] for r in docs.orderBy(F.desc("doc_id"), tie, "text").collect()]
    assert {r["text"]: r["next_text"] for r in got.collect()} == dict(zip(want, want[1:] + want[:1]))


def test_order_with_outliers_and_extreme_ids(spark):
    ids = [*range(20000), 10**15, -(2**63), 2**63 - 1, None]
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    rows = fingerprints.with_next(docs)
    want = sorted((i for i in ids if i is not None), reverse=True) + [None]
    assert {r["doc_id"]: r["next_text"] for r in rows.collect()} == {a: f"t{b}" for a, b in zip(want, want[1:] + want[:1])}
    assert fingerprints.fingerprints(docs.filter("doc_id IS NULL OR doc_id NOT BETWEEN 0 AND 10000000000")).count() == 4


def test_runs_follow_the_rows(spark):
    ids = [*range(20000), 10**15]
    docs = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", [k / 40 for k in range(1, 40)], 800).alias("q")).first()["q"]))
    sizes = [r["count"] for r in docs.groupBy(fingerprints._run_of(cuts).alias("run")).count().collect()]
    assert len(sizes) == 40 and max(sizes) < 700
    want = {i: sum(c >= i for c in cuts) for i in ids}
    assert {r["doc_id"]: r["run"] for r in docs.select("doc_id", fingerprints._run_of(cuts).alias("run")).collect()} == want


def prints(spark, a, b):
    rows = fingerprints.tree(fingerprints.tree(spark.createDataFrame([(a, b)], "a string, b string"), "a", "x"), "b", "y")
    rows = fingerprints.with_likeness(rows, "x_leaves", "y_leaves", "near").withColumns({k: fingerprints.fingerprint(k) for k in "xy"})
    return rows.select("near", fingerprints.edited_paragraphs(F.col("x"), F.col("y")).alias("places")).first()


def test_edit_located_from_two_fingerprints(spark):
    lines = [f"line {i} of the text" for i in range(40)]
    changed = lines[:20] + ["other"] + lines[21:]
    row = prints(spark, "\n".join(lines), "\n".join(changed))
    assert row["places"] == [20] and 0.9 < row["near"] < 1
    assert prints(spark, "\n".join(lines), "\n".join(lines))["places"] == []
    assert prints(spark, "\n".join(lines), "\n".join([*lines, "more", "and more"]))["places"] == [40, 41]
    moved = prints(spark, "\n".join(lines), "\n".join(["first", *lines]))
    assert moved["near"] > 0.95 and len(moved["places"]) == 41
    assert prints(spark, "a", "b")["near"] == 0.0


def test_many_lines_take_linear_time(spark):
    lines = [f"{i} word" for i in range(100_000)]
    start = time.time()
    row = prints(spark, "\n".join(lines), "\n".join(lines[:50_000] + ["new"] + lines[50_001:]))
    assert row["places"] == [50_000] and time.time() - start < 30


def test_next_document_over_many_runs(spark, monkeypatch):
    """Rows are cut into runs at quantiles of the ids; the next document is the same however many runs there are."""
    monkeypatch.setattr(fingerprints, "ROWS_A_BUCKET", 40)
    docs = spark.createDataFrame([(3 * i, f"t{i}") for i in range(4000)], "doc_id long, text string")
    got = {r["doc_id"]: r["next_text"] for r in fingerprints.with_next(docs).collect()}
    assert got == {3 * i: f"t{i - 1 if i else 3999}" for i in range(4000)}
