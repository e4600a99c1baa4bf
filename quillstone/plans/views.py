"""Views over the driver's tables that stand in for papers, index state, website pages, golden questions and runs.

Each view exists as a DataFrame function and as SQL (`cte`), so that queries and their SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.search import small
from quillstone.plans.registry import table


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document as a paper record with its Markdown."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        "concat('doc:', lpad(cast(doc_id as string), 8, '0')) AS bib",
        "substring(split(text, '\\n')[0], 1, 120) AS title",
        "substring(text, 1, 1500) AS abstract",
        "cast(2000 + doc_id % 25 as string) AS year",
        "concat(cast(2000 + doc_id % 25 as string), '-', lpad(cast(doc_id % 13 as string), 2, '0'), '-00') AS pubdate",
        "concat(cast(2000 + doc_id % 25 as string), '-', lpad(cast(1 + doc_id % 12 as string), 2, '0'), '-', lpad(cast(1 + doc_id % 28 as string), 2, '0'), 'T00:00:00Z') AS date",
        "transform(sequence(0, cast(doc_id % 9 as int)), i -> concat(CASE WHEN doc_id % 5 = 0 AND i = 0 THEN 'van der ' ELSE '' END, 'Nation ', cast((doc_id * 7 + i) % 25 as string), ', ', char(65 + i))) AS author",
        "filter(array(CASE WHEN doc_id % 3 <> 0 THEN concat('10.1000/J', cast(doc_id as string)) END, CASE WHEN doc_id % 6 = 1 THEN concat('10.48550/arXiv.', cast(doc_id as string)) END), x -> x IS NOT NULL) AS doi",
        "filter(array(concat('doc:', lpad(cast(doc_id as string), 8, '0')), CASE WHEN doc_id % 2 = 0 THEN concat('arXiv:', cast(2000 + doc_id % 25 as string), '.', cast(doc_id as string)) END), x -> x IS NOT NULL) AS identifier",
        "filter(array(concat('doc:', lpad(cast(doc_id as string), 8, '0')), CASE WHEN doc_id % 11 = 0 THEN concat('old:', lpad(cast(doc_id as string), 8, '0')) END), x -> x IS NOT NULL) AS aliases",
        "filter(array(CASE WHEN doc_id % 5 = 0 THEN 'PUB_OPENACCESS' END, CASE WHEN doc_id % 7 = 0 THEN 'EPRINT_OPENACCESS' END, 'ARTICLE'), x -> x IS NOT NULL) AS property",
        "filter(array(CASE WHEN doc_id % 2 = 0 THEN 'EPRINT_PDF' END, CASE WHEN doc_id % 5 = 0 THEN 'PUB_PDF' END, CASE WHEN doc_id % 4 = 0 THEN 'AUTHOR_PDF' END), x -> x IS NOT NULL) AS esources",
        "array(lang, source) AS keyword",
        "source AS pub",
        "lang AS doctype",
        "text",
        "concat('# ', substring(split(text, '\\n')[0], 1, 120), '\\n\\n## ', source, '\\n\\n', replace(text, '\\n', '\\n\\n')) AS markdown",
    )


PAPERS = """papers AS (SELECT doc_id, 'doc:' || lpad(doc_id::VARCHAR, 8, '0') AS bib, substr(string_split(text, chr(10))[1], 1, 120) AS title, substr(text, 1, 1500) AS abstract,
 (2000 + doc_id % 25)::VARCHAR AS year,
 (2000 + doc_id % 25)::VARCHAR || '-' || lpad((doc_id % 13)::VARCHAR, 2, '0') || '-00' AS pubdate,
 (2000 + doc_id % 25)::VARCHAR || '-' || lpad((1 + doc_id % 12)::VARCHAR, 2, '0') || '-' || lpad((1 + doc_id % 28)::VARCHAR, 2, '0') || 'T00:00:00Z' AS date,
 list_transform(range(0, doc_id % 9 + 1), lambda i: (CASE WHEN doc_id % 5 = 0 AND i = 0 THEN 'van der ' ELSE '' END) || 'Nation ' || ((doc_id * 7 + i) % 25)::VARCHAR || ', ' || chr((65 + i)::INTEGER)) AS author,
 list_filter([CASE WHEN doc_id % 3 <> 0 THEN '10.1000/J' || doc_id END, CASE WHEN doc_id % 6 = 1 THEN '10.48550/arXiv.' || doc_id END], lambda x: x IS NOT NULL) AS doi,
 list_filter(['doc:' || lpad(doc_id::VARCHAR, 8, '0'), CASE WHEN doc_id % 2 = 0 THEN 'arXiv:' || (2000 + doc_id % 25) || '.' || doc_id END], lambda x: x IS NOT NULL) AS identifier,
 list_filter(['doc:' || lpad(doc_id::VARCHAR, 8, '0'), CASE WHEN doc_id % 11 = 0 THEN 'old:' || lpad(doc_id::VARCHAR, 8, '0') END], lambda x: x IS NOT NULL) AS aliases,
 list_filter([CASE WHEN doc_id % 5 = 0 THEN 'PUB_OPENACCESS' END, CASE WHEN doc_id % 7 = 0 THEN 'EPRINT_OPENACCESS' END, 'ARTICLE'], lambda x: x IS NOT NULL) AS property,
 list_filter([CASE WHEN doc_id % 2 = 0 THEN 'EPRINT_PDF' END, CASE WHEN doc_id % 5 = 0 THEN 'PUB_PDF' END, CASE WHEN doc_id % 4 = 0 THEN 'AUTHOR_PDF' END], lambda x: x IS NOT NULL) AS esources,
 [lang, source] AS keyword, source AS pub, lang AS doctype, text,
 '# ' || substr(string_split(text, chr(10))[1], 1, 120) || chr(10) || chr(10) || '## ' || source || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10)) AS markdown FROM documents)"""


def index_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored objects: papers without every tenth, some with an outdated fingerprint, and five orphans."""
    own = papers(spark, sf_dir).filter("doc_id % 10 <> 3").selectExpr(
        "CASE WHEN doc_id % 22 = 0 THEN aliases[1] ELSE bib END AS parent_doc",
        "concat(bib, '#0001') AS chunk_id",
        "CASE WHEN doc_id % 10 = 7 THEN 'stale' ELSE substring(sha2(markdown, 256), 1, 20) END AS fingerprint",
        "CASE WHEN doc_id % 4 = 1 THEN 'abstract only' WHEN doc_id % 4 = 2 THEN NULL ELSE 'full text' END AS coverage",
    )
    gone = spark.range(5).selectExpr("concat('gone:', id) AS parent_doc", "concat('gone:', id, '#0001') AS chunk_id", "'x' AS fingerprint", "'full text' AS coverage")
    return own.unionAll(gone)


STATE = (
    PAPERS
    + """, state AS (SELECT CASE WHEN doc_id % 22 = 0 THEN aliases[2] ELSE bib END AS parent_doc, bib || '#0001' AS chunk_id,
 CASE WHEN doc_id % 10 = 7 THEN 'stale' ELSE substr(sha256(markdown), 1, 20) END AS fingerprint,
 CASE WHEN doc_id % 4 = 1 THEN 'abstract only' WHEN doc_id % 4 = 2 THEN NULL ELSE 'full text' END AS coverage FROM papers WHERE doc_id % 10 <> 3
 UNION ALL SELECT 'gone:' || i, 'gone:' || i || '#0001', 'x', 'full text' FROM range(5) t(i))"""
)


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence evidence in long form: doc_id, source, url or id, applies_to, valid_from."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        """explode(filter(array(
          CASE WHEN doc_id % 6 = 0 THEN named_struct('source', 'crossref', 'value', 'https://creativecommons.org/licenses/by/4.0/', 'applies_to', 'vor', 'valid_from', '2020-01-01') END,
          CASE WHEN doc_id % 6 = 1 THEN named_struct('source', 'crossref', 'value', 'http://www.publisher.example/terms', 'applies_to', 'unspecified', 'valid_from', CASE WHEN doc_id % 12 = 1 THEN '2999-01-01' ELSE '' END) END,
          CASE WHEN doc_id % 6 = 2 THEN named_struct('source', 'datacite', 'value', 'https://creativecommons.org/publicdomain/zero/1.0/', 'applies_to', '', 'valid_from', '') END,
          CASE WHEN doc_id % 6 IN (1, 3) THEN named_struct('source', 'openalex', 'value', 'cc-by-nc', 'applies_to', '', 'valid_from', '') END,
          CASE WHEN doc_id % 6 = 4 THEN named_struct('source', 'arxiv', 'value', 'http://arxiv.org/licenses/nonexclusive-distrib/1.0/', 'applies_to', '', 'valid_from', '') END,
          CASE WHEN doc_id % 9 = 0 THEN named_struct('source', 'crossref', 'value', 'https://creativecommons.org/licenses/by-nc-nd/4.0/', 'applies_to', CASE WHEN doc_id % 18 = 0 THEN 'tdm' ELSE 'vor' END, 'valid_from', '2019-05-01') END
        ), x -> x IS NOT NULL)) AS e""",
    ).select("doc_id", "e.*")


EVIDENCE = """evidence AS (SELECT doc_id, 'crossref' AS source, 'https://creativecommons.org/licenses/by/4.0/' AS value, 'vor' AS applies_to, '2020-01-01' AS valid_from FROM documents WHERE doc_id % 6 = 0
 UNION ALL SELECT doc_id, 'crossref', 'http://www.publisher.example/terms', 'unspecified', CASE WHEN doc_id % 12 = 1 THEN '2999-01-01' ELSE '' END FROM documents WHERE doc_id % 6 = 1
 UNION ALL SELECT doc_id, 'datacite', 'https://creativecommons.org/publicdomain/zero/1.0/', '', '' FROM documents WHERE doc_id % 6 = 2
 UNION ALL SELECT doc_id, 'openalex', 'cc-by-nc', '', '' FROM documents WHERE doc_id % 6 IN (1, 3)
 UNION ALL SELECT doc_id, 'arxiv', 'http://arxiv.org/licenses/nonexclusive-distrib/1.0/', '', '' FROM documents WHERE doc_id % 6 = 4
 UNION ALL SELECT doc_id, 'crossref', 'https://creativecommons.org/licenses/by-nc-nd/4.0/', CASE WHEN doc_id % 18 = 0 THEN 'tdm' ELSE 'vor' END, '2019-05-01' FROM documents WHERE doc_id % 9 = 0)"""


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their address, title, raw blocks and links."""
    return table(spark, sf_dir, "pages").selectExpr(
        "page_id", "url", "html", "regexp_extract(html, '<title>([^<]*)</title>', 1) AS title",
        "regexp_extract_all(html, '<p>([^<]*)</p>', 1) AS blocks", "regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS links",
    )


SITE = """site AS (SELECT page_id, url, html, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract_all(html, '<p>([^<]*)</p>', 1) AS blocks, regexp_extract_all(html, 'href="([^"]*)"', 1) AS links FROM pages)"""


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns with citation tags, some of them bogus."""
    return table(spark, sf_dir, "conversations").filter("role = 'assistant'").selectExpr(
        "conv_id", "turn",
        "concat(text, ' <cite>', turn, '</cite> and <cite> ', turn + 1, '</cite>, <cite>99</cite>; <cite>', turn, '</cite> [1] [', cast(turn % 4 as string), '] <cite>x</cite>') AS reply",
    )


REPLIES = """replies AS (SELECT conv_id, turn, text || ' <cite>' || turn || '</cite> and <cite> ' || (turn + 1) || '</cite>, <cite>99</cite>; <cite>' || turn || '</cite> [1] [' || (turn % 4) || '] <cite>x</cite>' AS reply FROM conversations WHERE role = 'assistant')"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation rows: config, question, check, passed, seconds, rounds."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "concat('m', cast(user_id % 2 as string), ' -> a on c') AS config", "concat('q', cast(user_id % 40 as string)) AS question", "event_type AS check",
        "event_id % 3 <> 0 AS passed", "round(value, 2) AS seconds", "event_id % 4 AS rounds", "CASE WHEN event_id % 50 = 0 THEN 'failed' END AS error",
    )


RUNS = """runs AS (SELECT event_id, 'm' || (user_id % 2) || ' -> a on c' AS config, 'q' || (user_id % 40) AS question, event_type AS "check", event_id % 3 <> 0 AS passed, round(value, 2) AS seconds, event_id % 4 AS rounds, CASE WHEN event_id % 50 = 0 THEN 'failed' END AS error FROM events)"""


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden questions: benchmark passages and the papers that hold them.

    Where a passage stands in a text, its inner words stand there whole: texts are looked up by a passage's second to fourth word, and
    only those found are searched for all of it. Passages of fewer than five words, if there are any, are searched for in every text.
    """
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "text AS doc_text")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text", F.split("text", " ").alias("w"))
    three = ["w1", "w2", "w3"]
    long = items.filter(F.size("w") >= 5)
    anchors = long.select("item_id", *[F.col("w")[k].alias(c) for k, c in enumerate(three, 1)])
    rows = docs.select("doc_id", F.split("doc_text", " ").alias("w"))
    shifted = rows.select("doc_id", *[F.slice("w", k, F.size("w")).alias(c) for k, c in enumerate(three, 1)])
    runs = shifted.select("doc_id", F.explode(F.arrays_zip(*three)).alias("r")).select("doc_id", "r.*")
    found = runs.join(small(anchors), three).select("doc_id", "item_id").distinct()
    pairs = docs.join(found, "doc_id").join(small(long.select("item_id", "text")), "item_id").filter(F.col("doc_text").contains(F.col("text")))
    short = items.filter(F.size("w") < 5).select("item_id", "text")
    if not short.isEmpty():
        pairs = pairs.select("item_id", "doc_id").unionByName(docs.join(small(short), F.col("doc_text").contains(F.col("text"))).select("item_id", "doc_id"))
    return pairs.groupBy("item_id").agg(F.array_sort(F.collect_list(F.concat(F.lit("doc:"), F.lpad(F.col("doc_id").cast("string"), 8, "0")))).alias("expected"))


GOLDEN = """golden AS (SELECT item_id, list('doc:' || lpad(doc_id::VARCHAR, 8, '0') ORDER BY doc_id) AS expected FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id)"""
