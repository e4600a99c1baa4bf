import gzip

from pyspark.sql import functions as F

from quillstone.llm.warc import audit, digests, read_warc, write_record


def test_round_trip_and_audit(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    blocks = [f"body {i} ".encode() * (i % 7) for i in range(300)]
    (tmp_path / "a" / "x.warc").write_bytes(b"".join(write_record(f"http://h/{i}", b) for i, b in enumerate(blocks)))
    wrong = list(blocks)
    wrong[123] = wrong[123][:-1] + b"!"
    (tmp_path / "b" / "x.warc").write_bytes(gzip.compress(b"".join(write_record(f"http://h/{i}", b) for i, b in enumerate(wrong))))
    a, b = read_warc(spark, f"{tmp_path}/a"), read_warc(spark, f"{tmp_path}/b")
    assert [bytes(r["content"]) for r in a.orderBy("offset").collect()] == blocks
    roots, bad = audit(a, b, span=256)
    assert roots.filter("primary_root <> replica_root").count() == 1
    got = bad.collect()
    assert [(r["status"], r["offset"]) for r in got] == [("corrupt", a.filter("uri = 'http://h/123'").first()["offset"])]


def test_descent_equals_brute_force(spark):
    one = spark.range(3000).select(F.concat(F.lit("f"), F.col("id") % 3).alias("file"), F.col("id").alias("offset"), F.sha1(F.col("id").cast("string")).alias("content"))
    two = one.filter("offset % 97 <> 0").withColumn("content", F.when(F.col("offset") % 131 == 1, F.lit("bad")).otherwise(F.col("content")))
    two = two.unionAll(spark.createDataFrame([("f9", 9000, "new")], two.schema))
    _, bad = audit(one, two)
    got = {(r["file"], r["offset"]): r["status"] for r in bad.collect()}
    want = {(f"f{i % 3}", i): "missing" for i in range(0, 3000, 97)} | {(f"f{i % 3}", i): "corrupt" for i in range(1, 3000, 131) if i % 97} | {("f9", 9000): "extra"}
    assert got == want


def test_edges(spark):
    rows = [(None, None, None), ("a", 1, ""), ("a", 1, ""), ("a", 1, "x"), ("b", 5, "y" * 100000)]
    one = spark.createDataFrame(rows, "file string, offset long, content string").withColumn("node", F.lit(1)).withColumn("hash", F.lit("h"))
    roots, bad = audit(one, one)
    assert bad.count() == 0 and roots.filter("primary_root = replica_root").count() == 3
    _, bad = audit(one, one.dropDuplicates(["file", "offset", "content"]))
    assert [(r["file"], r["status"]) for r in bad.collect()] == [("a", "corrupt")]
    none = one.filter(F.lit(False))
    roots, bad = audit(none, none)
    assert roots.count() == bad.count() == 0
    assert audit(one, none)[1].filter("status = 'missing'").count() == 3
    assert len(digests(one)[1]) >= 1
