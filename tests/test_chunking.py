import datetime as dt
from itertools import pairwise

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.functions.text import abstract_share
from quillstone.operators.chunking import PROPERTIES, ChunkSettings, boundaries, chunks, coalesce_small, estimate, images, is_table, joined, later_than, pack, paper_objects, renumber_documents, sections, split_table, split_words, strip_false_dates, text_problem

MD = """intro

# Title
## 1 One
para

```
# not a heading
```
### 1.1 Deep ##
text
## References
[1] x
"""


def test_sections_open_headers_and_fences():
    got = list(sections(MD))
    assert [h for h, _ in got] == [[], ["Title", "1 One"], ["Title", "1 One", "1.1 Deep"], ["Title", "References"]]
    assert "# not a heading" in got[1][1]


def test_dropped_sections():
    assert [h for h, *_ in chunks(MD)] == [[], ["Title", "1 One"], ["Title", "1 One", "1.1 Deep"]]
    keep = ["Reference frames", "9.3 The list of references", "Keyword search"]
    gone = ["9. References and notes", "VIII Acknowledgments", "Key Words:", "Bibliography"]
    assert [h[0] for h, *_ in chunks("".join(f"# {h}\nx\n" for h in keep + gone))] == keep


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=40))
def test_budget_and_coverage(sizes):
    s = ChunkSettings(max=40, overlap=8, min=6)
    paras = [f"p{i} " + "word " * n for i, n in enumerate(sizes)]
    got = pack("\n\n".join(paras), s)
    assert all(estimate(t) <= s.max * 1.3 + 4 for t, _ in got)
    text = " ".join(t for t, _ in got)
    assert all(f"p{i} " in text + " " for i in range(len(paras)))


def test_tables_stay_whole_with_caption_and_split_with_header():
    table = "| a | b | c |\n|---|---|---|\n" + "\n".join(f"| {i} | {i} | {i} |" for i in range(50))
    assert is_table(table)
    got = pack("long text " * 20 + "\n\nTable 3: what it holds\n\n" + table, ChunkSettings(max=60))
    assert got[-1][0].startswith("Table 3: what it holds\n\n| a | b")
    pieces = split_table(table, 60, estimate)
    assert len(pieces) > 1 and all(p.startswith("| a | b | c |\n|---|---|---|\n") and estimate(p) <= 60 for p in pieces)
    assert sum(p.count("\n") - 1 for p in pieces) == 50


def test_coalesce():
    s = ChunkSettings(max=10, min=3)
    assert coalesce_small([("a", 2), ("b", 5), ("c", 9), ("d", 2)], s) == [("a\n\nb", 7), ("c", 9), ("d", 2)]
    assert coalesce_small([("a", 6), ("b", 2), ("c", 9)], s) == [("a\n\nb", 8), ("c", 9)]


def test_renumber(spark):
    md = "# **My title**\n# 2.1Planets\n# Notes\n# Abstract\n# 1. Intro:\n# A1 More\n# 28.02.2014\n### Refer\n# 31 Late\n# 1.2.3.4.5 Deep\n#\nplain"
    docs = spark.createDataFrame([(1, md), (1, md), (2, None), (3, "no heading")], "doc_id long, markdown string")
    rows = sorted(renumber_documents(docs).collect(), key=lambda r: r["doc_id"])
    want = ["# My title", "### 2.1 Planets", "#### Notes", "## Abstract", "**1. Intro:**", "## A1 More", "**28.02.2014**", "### Refer", "### 31 Late", "### 1.2.3.4.5 Deep", "#", "plain"]
    assert [r["doc_id"] for r in rows] == [1, 1, 2, 3]
    assert rows[0]["markdown"].split("\n") == rows[1]["markdown"].split("\n") == want
    assert rows[2]["markdown"] == "" and rows[3]["markdown"] == "no heading"
    assert {k: rows[0][k] for k in ("title", "numbered", "front_back", "inherited", "demoted")} == {"title": 1, "numbered": 2, "front_back": 1, "inherited": 4, "demoted": 2}


def test_fences_close_by_their_own_character():
    md = "# T\n```\n~~~\n# not a heading\n```\n# C#\nbody\n~~~~ x\n```\n## nor this\n![no](n.png)\n~~~\n## S ##\n![yes](y.png)"
    assert list(sections(md)) == [(["T"], "```\n~~~\n# not a heading\n```"), (["C"], "body\n~~~~ x\n```\n## nor this\n![no](n.png)\n~~~"), (["C", "S"], "![yes](y.png)")]
    assert images(md) == [{"path": "y.png", "caption": "yes", "section": ["C", "S"]}]


def test_boundaries_by_hand():
    s = ChunkSettings(max=10, overlap=4, min=3)
    text = ["text"] * 6
    assert boundaries([4, 4, 4, 4, 2, 9], text, s) == [(0, 2), (1, 3), (2, 5), (5, 6)]
    assert boundaries([2, 50, 5], ["text", "table", "text"], s) == [(0, 2), (2, 3)]
    assert boundaries([5, 4, 50], ["text", "caption", "table"], s) == [(0, 1), (1, 3)]
    assert boundaries([5, 4, 50], ["text", "text", "table"], s) == [(0, 2), (2, 3)]
    assert boundaries([4, 11, 4], ["text", "long", "text"], s) == [(0, 1), (1, 2), (2, 3)]
    assert boundaries([], [], s) == []
    assert joined([2, 1, 9, 2, 9, 2], 3, 10) == [(0, 2), (2, 3), (3, 4), (4, 5), (5, 6)]
    assert joined([5, 2, 9, 1, 9], 3, 10) == [(0, 2), (2, 3), (3, 5)]


def test_expected_chunks():
    """Sections, packing, coalescing and numbering of one document, as a fixed table."""
    md = "# Paper\n\nshort lead\n\n## 1 Data\n\n" + "\n\n".join(f"para {k} " + "w " * 20 for k in range(4)) + "\n\nTable 1. Stars\n\n| a | b | c |\n|---|---|---|\n| 1 | 2 | 3 |\n\n## References\n\n[1] x"
    got = chunks(md, ChunkSettings(max=50, overlap=20, min=8))
    assert [(h, text.split("\n\n")[0].split(" w")[0], part, parts) for h, text, part, parts, _ in got] == [
        (["Paper"], "short lead", 1, 1),
        (["Paper", "1 Data"], "para 0", 1, 4),
        (["Paper", "1 Data"], "para 1", 2, 4),
        (["Paper", "1 Data"], "para 2", 3, 4),
        (["Paper", "1 Data"], "Table 1. Stars", 4, 4),
    ]


def test_false_dates_and_images():
    md = "# T\n(June 21, 2026)\n21 June 2010\n## S\n1 July 2026\n![cap](a.png)"
    assert strip_false_dates(md, later_than(dt.date(2010, 6, 1))) == "# T\n21 June 2010\n## S\n1 July 2026\n![cap](a.png)"
    assert images(md) == [{"path": "a.png", "caption": "cap", "section": ["T", "S"]}]


def test_chunks_are_counted_as_texts():
    """A chunk's size is that of its text, not the sum of its paragraphs' sizes; a table's rule needs a bar."""
    text = "a b c\n\nd e f\n\nd e f"
    assert pack(text, ChunkSettings(min=0)) == [(text, estimate(text))]
    for chunk, n in pack("\n\n".join(f"w{k} " * (k % 40) for k in range(200)), ChunkSettings(max=80, overlap=10, min=20)):
        assert n == estimate(chunk)
    table = "| a | b | c |\n---\n" + "\n".join(f"| {k} | x | y |" for k in range(30))
    assert all(p.startswith("| a | b | c |\n") and not p.startswith("| a | b | c |\n---\n| 0 | x | y |\n---") for p in split_table(table, 60, estimate))
    assert split_table(table, 60, estimate)[1].startswith("| a | b | c |\n| ")


def test_paper_objects(spark):
    """Abstract-only papers are one object, full texts their chunks, with an abstract that the text lacks; all carry the paper's fingerprint."""
    body = " ".join(f"word{k}" for k in range(120))
    said = " ".join(f"said{k}" for k in range(12))
    md = f"# T\n\n(June 21, 2026)\n\n## S\n\n{body}\n\n## References\n\n[1] x"
    held = md.replace(body, f"{said} {body}")
    rows = [(1, "a", "T", said, md, True), (2, "b", "T", said, held, True), (3, "c", "T", said, md, False), (4, "d", "T", "", None, True), (5, "e", "T", None, md, None), (6, "f", "T", "", md, True), (6, "f", "T", "", md, True)]
    papers = spark.createDataFrame(rows, "doc_id long, bib string, title string, abstract string, markdown string, full boolean").withColumn("published", F.lit("2020-01-01").cast("date"))
    papers = papers.withColumns({c: F.lit("x") for c in PROPERTIES if c != "title"})
    got = paper_objects(papers).collect()
    assert sorted((r["chunk_id"], r["chunk_index"], r["section_headers"], r["content"], r["coverage"]) for r in got) == sorted([
        ("a#abstract", 0, ["Abstract"], said, "full text"), ("a#0001", 1, ["T", "S"], body, "full text"), ("b#0001", 1, ["T", "S"], f"{said} {body}", "full text"),
        ("c#abstract", 0, ["Abstract"], said, "abstract only"), ("d#abstract", 0, ["Abstract"], "T", "abstract only"), ("e#abstract", 0, ["Abstract"], "T", "abstract only"),
        ("f#0001", 1, ["T", "S"], body, "full text"), ("f#0001", 1, ["T", "S"], body, "full text"),
    ])
    marks = {r["bib"]: r["fingerprint"] for r in got}
    assert len(set(marks.values())) == 6 and all(r["fingerprint"] == marks[r["bib"]] and len(r["fingerprint"]) == 20 for r in got)
    assert {r["chunk_id"]: r["embed"] for r in got}["f#0001"] == f"T\nT > S\n\n{body}"
    assert not {r["fingerprint"] for r in paper_objects(papers, ChunkSettings(max=100)).collect()} & set(marks.values())


def test_corpus_build_counts(spark):
    from quillstone.plans import catalogue, views
    from quillstone.plans.relational import arxiv

    sf = "/root/testdata/sf0.001"
    rows = views.papers(spark, sf).withColumn("arxiv", arxiv()).withColumn("held", abstract_share(F.col("abstract"), F.col("markdown"))).withColumn("problem", text_problem(F.col("title"), F.col("text"))).collect()
    allowed = [r for r in rows if r["arxiv"] or {"PUB_OPENACCESS", "EPRINT_OPENACCESS"} & set(r["property"])]
    full = [r for r in allowed if r["problem"] is None]
    n = len(rows) - len(full) + sum(len(chunks(r["markdown"])) + (r["held"] < 0.4) for r in full)
    got = catalogue.QUERIES["chk08_corpus_build"](spark, sf).first()
    assert got[:6] == (len(rows), len(full), len(rows) - len(full), n, len(rows) - len(allowed), len(allowed) - len(full))
    assert 0 < len(full) < len(allowed) < len(rows)


def test_hard_splits_and_table_pieces_fill_their_limit():
    text = "a " * 300 + "bbbbbbbbbbbbbbbbbbbb " * 300
    pieces = split_words(text, 64, estimate)
    step = int(600 * 64 / estimate(text) * 0.9)
    for piece, after in pairwise(pieces):
        taken = len(piece.split())
        assert taken == step or estimate(f"{piece} {after.split()[0]}") > 64
    table = "| a | b | c |\n|---|---|---|\n" + "\n".join(f"| {k:03} | x | y |" for k in range(60))
    s = ChunkSettings(max=60, overlap=8, min=6, atomic_max=100)
    assert [t for t, _ in pack(table, s)] == split_table(table, 100 - estimate(""), estimate)
