import numpy as np
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillstone.llm.quality_gam import op2_quality_classifier, score_quality
from quillstone.llm.quality_rules import keep_good, op5_quality_rules, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counted(text):
    words = WORD.findall(text or "")
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside), failed


def test_rules_against_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op5_quality_rules(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert tuple(r[1:7]) == counted(docs[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = [r for r in rows if labels.get(r["doc_id"]) == 1 and not r["base_failed"]]
    bad = [r for r in rows if labels.get(r["doc_id"]) == 0 and not r["base_failed"]]
    assert sum(r["kept"] for r in good) >= 0.99 * len(good)
    assert sum(r["kept"] for r in bad) <= 0.2 * len(bad)


def test_classifier_held_out(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = op2_quality_classifier(spark, sf_dir).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)


ODD = [(1, None, 1), (1, None, 1), (2, "", 1), (None, "a b c " * 40, 1), (3, "x", 1), (4, "word " * 30000, 2), (5, "\n \n", 1)]


@pytest.mark.parametrize("with_labels", [False, True])
def test_edges(spark, sf_dir, with_labels):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, score int")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", F.lit("x").alias("text"))
    labels = labels.unionAll(spark.createDataFrame([(None, 1, "x"), (5, None, "x")], labels.schema))
    if not with_labels:
        labels = labels.filter("doc_id < 0")
    rows = quality_rules(docs, labels).collect()
    assert sorted(map(str, (r[1:7] for r in rows))) == sorted(str(counted(t)) for _, t, _ in ODD)
    assert score_quality(docs, labels).filter("score between 0 and 1").count() == len(ODD)
    assert keep_good(docs, labels).columns == docs.columns
    none = docs.filter(F.lit(False))
    assert quality_rules(none, labels).count() == score_quality(none, labels).count() == 0


def test_gam_is_the_sum_of_its_tables():
    """Vectorised scores against a plain sum of table entries, row by row."""
    import bisect
    import math

    from quillstone.llm.quality_gam import FEATURES, fit_gam

    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, len(FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3) | (x[:, 2] > 1)).astype(np.int64)
    gam = fit_gam(x, y, rounds=20, pair_rounds=15)
    for row, score in zip(x.tolist(), gam.score(x)):
        b = [bisect.bisect_right(c.tolist(), v) for c, v in zip(gam.cuts, row)]
        z = gam.bias + sum(t[k] for t, k in zip(gam.tables, b)) + sum(t[b[i], b[j]] for (i, j), t in zip(gam.pairs, gam.pair_tables))
        assert abs(score - 1 / (1 + math.exp(-z))) < 1e-9
    assert ((gam.score(x) > 0.5) == y).mean() > 0.9 and (0, 1) in {tuple(sorted(p)) for p in gam.pairs}


def test_the_rules_model_is_trained_off_the_driver(spark, sf_dir, monkeypatch):
    """The n-grams of the sample never come to the driver, and the model is that of the sample in order of id."""
    from pyspark.sql.classic.dataframe import DataFrame

    from quillstone.llm import quality_rules as rules
    from quillstone.llm.labelled import labelled_features

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    want = rules.fit_ngram_model(*labelled_features(docs, labels, "quality", 100, rules._features, "want"))
    calls = []
    collect = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda df: calls.append(df.columns) or collect(df))
    rules.quality_rules(docs, labels, sample=100)
    rules.keep_good(docs, labels, sample=100)
    assert not any("f" in c for c in calls)
    monkeypatch.undo()
    weights, a, b = rules.train(docs, labels, 100)
    assert np.array_equal(weights, want[0]) and weights.any() and (a, b) == want[1:]
