import random
import re

import pytest
from pyspark.sql import functions as F

from quillstone.llm.licences import BASE, TEMPLATES, LicenceAutomaton, op1_license_scans, scan_licences, words_of_text

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    words = WORD.findall((text or "").translate(UP))
    places = []
    for phrase, label in BASE:
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_against_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op1_license_scans(spark, sf_dir).collect()
    assert len(rows) == len(docs) and any(r["n_base"] for r in rows)
    for r in rows:
        assert tuple(r[1:6]) == brute(docs[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1


def test_automaton_on_random_words():
    rnd = random.Random(2)
    a = LicenceAutomaton()
    vocabulary = "gnu general public license apache mit cc by the x under licensed".split()
    for _ in range(300):
        text = " ".join(rnd.choice(vocabulary) for _ in range(60))
        base, _ = a.scan(words_of_text(text))
        want = [(i, k) for k, (p, _) in enumerate(BASE) for i in range(60) if text.split()[i : i + len(p.split())] == p.split()]
        assert sorted(base) == sorted(want)


@pytest.mark.parametrize("number", range(len(TEMPLATES)))
def test_template_spans(number):
    label, text = TEMPLATES[number]
    a = LicenceAutomaton()
    words = text.split()
    changed = words[: len(words) // 2] + ["odd"] + words[len(words) // 2 + 1 :] if len(words) > 12 else words
    doc = "before and after".split() + changed + "the end".split()
    _, spans = a.scan([w.encode() for w in doc])
    mine = [s for s in spans if s.template == number]
    assert mine and mine[0].label == label and mine[0].first == 3 and mine[0].last == 2 + len(words)


def test_edges(spark):
    rows = [(1, None), (1, ""), (None, "MIT   License"), (2, "x " * 50000 + "cc by"), (2, "é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit(1))
    got = scan_licences(docs).collect()
    assert sorted(str(tuple(r[1:6])) for r in got) == sorted(str(brute(t)) for _, t in rows)
    assert scan_licences(docs.filter(F.lit(False))).count() == 0
