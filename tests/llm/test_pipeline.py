from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from quillstone.llm.common import materialise
from quillstone.llm.ngram_join import jaccard_join
from tests.llm.test_ngram_join import brute
from tests.llm.test_packing import whole
from tests.llm.test_quality import counted


def test_stage_by_stage(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, held = docs.columns, [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialise(stage(spark, docs, d), "test")
        if k < 4:
            assert docs.columns == columns
        held.append(docs.collect())
    raw, ruled, scored, single, mixed, packed = held
    ids = lambda rows: {r["doc_id"] for r in rows}
    assert not any(counted(r["text"])[5] for r in ruled)
    assert ids(scored) <= ids(ruled) <= ids(raw)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    good = {r["doc_id"] for r in raw if labels.get(r["doc_id"]) == 1 and not counted(r["text"])[5]}
    assert len(good & ids(scored)) >= 0.95 * len(good)
    want = brute([(r["doc_id"], r["text"]) for r in scored])
    assert sorted(r["doc_id"] for r in single) == sorted({c for c, _ in want.values()})
    assert ids(mixed) <= ids(single) and ids(packed) == ids(mixed)
    whole(packed)
    assert sum(r["piece"] == 0 for r in packed) == len(mixed)
    assert sorted(map(str, corpus_pipeline.run(spark, d).select("doc_id", "piece", "ids_crc32").collect())) == sorted(str(r) for r in docs.select("doc_id", "piece", "ids_crc32").collect())


def test_stages_on_odd_rows(spark, sf_dir):
    plain = " ".join(f"word{i}" for i in range(80))
    rows = [(1, plain, "en", "a", 1), (2, plain.upper(), None, None, None), (2, plain.upper(), None, None, None), (None, plain + " more", "en", "a", 1), (3, None, "en", "a", 0), (4, "", "en", "a", 0), (None, None, None, None, None), (5, "x y " * 40000, "en", "a", 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        empty = docs.isEmpty()
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = materialise(stage(spark, docs, sf_dir), "odd")
            n = out.count()
            assert (n == 0) == empty or k in (0, 1, 3)
            if k == 2 and not empty:
                # the three texts with the same or nearly the same words are one group; the texts without words stay
                assert n == 5
            if k == 4:
                whole(out.collect())


def test_mix_holds_toxic_share_down_only(spark, tmp_path):
    """A corpus under the toxic ceiling stays as it is; above it, every clean document stays and no toxic one is copied."""
    for n_toxic, bound in ((8, False), (120, True)):
        rows = [(i, f"slur{i % 3} insult{i % 5} " * 20 if i < n_toxic else f"paper{i % 7} result{i % 5} " * 20) for i in range(400)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        spark.createDataFrame([(i, int(i < n_toxic), 1) for i, _ in rows], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/{n_toxic}/labels.parquet")
        got = Counter(r["doc_id"] for r in corpus_pipeline.mix(spark, docs, f"{tmp_path}/{n_toxic}").collect())
        assert all(got[i] >= 1 for i in range(n_toxic, 400)) and all(got[i] <= 1 for i in range(n_toxic))
        kept = sum(got[i] for i in range(n_toxic))
        assert kept < n_toxic / 4 if bound else got == Counter(range(400))


def test_classifier_removes_what_the_rules_kept(spark):
    """The stage learns from the original documents, so it tells poor ones among survivors of one label too."""
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    poor, good = (docs.join(labels.filter(f"quality = {q}").select("doc_id"), "doc_id", "left_semi").select(docs.columns) for q in (0, 1))
    n_poor, n_good = poor.count(), good.count()
    assert corpus_pipeline.classifier(spark, poor, d).count() <= 0.1 * n_poor
    assert corpus_pipeline.classifier(spark, good, d).count() >= 0.95 * n_good
    both = corpus_pipeline.classifier(spark, poor.unionAll(good), d)
    assert both.join(labels, "doc_id").filter("quality = 0").count() <= 0.1 * n_poor


def test_stages_on_bytes_that_are_not_utf8(spark, sf_dir):
    """They count as U+FFFD from the third stage on; no stage fails, and the row keeps its bytes."""
    plain = " ".join(f"word{i}" for i in range(80))
    rows = [(1, plain, False), (2, plain + " É \ufffd", False), (3, plain + " É ", True), (4, " ".join(f"other{i}" for i in range(80)), True)]
    text = F.when(F.col("bad"), F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF"))).cast("string")).otherwise(F.col("text"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, bad boolean").withColumn("text", text).withColumns({"lang": F.lit("en"), "source": F.lit("a"), "n_chars": F.lit(9)})
    near = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join(docs).collect()}
    assert near == {1: (1, 2), 2: (1, 2), 3: (1, 2), 4: (4, 0)}
    single = materialise(corpus_pipeline.near_duplicates(spark, docs, sf_dir), "bytes")
    assert sorted((r["doc_id"], r["x"][-2:]) for r in single.select("doc_id", F.hex("text").alias("x")).collect()) == [(1, "39"), (4, "FF")]
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "bytes")
    whole(docs.collect())


def test_near_duplicates_keep_columns_of_any_name(spark, sf_dir):
    docs = spark.createDataFrame([(1, "a b c", "x", "y", "v"), (2, "d e f", None, "z", "w")], "doc_id long, text string, d string, H string, z string")
    got = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert got.columns == docs.columns and sorted(got.collect()) == sorted(docs.collect())
