import re

from quillstone.operators import search
from quillstone.plans import retrieval


def exchanges(df):
    return re.findall(r"hashpartitioning\(([^)]*)\)", re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString()))


def test_text_search_ships_postings_by_document(spark, monkeypatch):
    """A frequent term is no key of a shuffle, pairs of documents and queries are none either; the hits do not depend on the parts."""
    docs = [(f"d{i % 90:03d}", "the " * (i % 4 + 1) + f"w{i % 13} x{i % 7}", None if i % 5 == 0 else f"w{i % 3} the") for i in range(100)] + [("none", None, "")]
    rows = spark.createDataFrame(docs, "doc_key string, content string, title string")
    asked = spark.createDataFrame([(i, f"the w{i} x{i % 8} w{i}") for i in range(9)] + [(90, ""), (91, None), (92, "qqqq")], "query_id long, query string")
    fields = {"content": 1.0, "title": 2.0}
    results = []
    for n in (1 << 16, 20):
        monkeypatch.setattr(search, "POSTING_ROWS", n)
        found = search.bm25(rows, asked, fields, k=4)
        results.append(sorted(map(str, found.collect())))
        by = exchanges(found)
        assert not [x for x in by if "term" in x or "query_id, doc_key" in x], by
    monkeypatch.setattr(search, "SCORES", 8)
    results.append(sorted(map(str, search.bm25(rows, asked, fields, k=4).collect())))
    assert results[0] == results[1] == results[2] and len(results[0]) == 9 * 4
    whole = search.top_k(search.bm25(rows, asked, fields, k=None), 4)
    assert sorted(map(str, whole.collect())) == results[0]


def test_texts_stay_where_they_are(spark, sf_dir):
    """The candidates go to the texts: no shuffle holds a text."""
    found = spark.createDataFrame([(i, f"doc:{7 * i:08d}", i, "bm25") for i in range(30)], "query_id long, doc_key string, place int, found_by string")
    df = retrieval.with_texts(spark, sf_dir, found)
    assert df.count() == 30
    assert not [x for x in exchanges(df) if "doc_key" in x]
