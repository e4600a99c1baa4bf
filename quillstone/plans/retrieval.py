"""Queries of retrieval, ranking, chunking and evaluation, with their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.functions import values as V
from quillstone.operators import answers, chunking, records, search
from quillstone.operators.postings import PostingsIndex
from quillstone.operators.vector_index import VectorIndex, recall
from quillstone.plans import views
from quillstone.plans.registry import query, table
from quillstone.plans.relational import arxiv, paper_index
from quillstone.plans.scalar import with_papers
from quillstone.session import shared_folder, written

FIELDS = {"content": 1.0, "title": 2.0, "section_headers": 1.0}


def corpus(spark, sf):
    return views.papers(spark, sf).select(F.col("bib").alias("doc_key"), "title", F.col("text").alias("content"), F.col("pub").alias("section_headers"))


def questions(spark, sf):
    """The first words of the benchmark's passages as questions."""
    words = F.slice(F.split("text", " "), 1, 6)
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(words, " ").alias("query"))


def _tok(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def _bm25(rows: str, fields: dict[str, float], key: str, q: str, k: int, hits: str) -> str:
    """CTEs that end in {hits}: the best k rows of the table `rows` for each query of the table `q` (query_id, term)."""
    parts = [f"SELECT {key}, '{f}' AS field, {boost} AS boost, {_tok(f)} AS t FROM {rows}" for f, boost in fields.items()]
    return f"""toks AS ({' UNION ALL '.join(parts)}), stats AS (SELECT field, count(*) AS n, avg(len(t)) AS avg_len FROM toks GROUP BY field),
 tf AS (SELECT {key}, field, boost, len, term, count(*) AS tf FROM (SELECT {key}, field, boost, len(t) AS len, unnest(t) AS term FROM toks) WHERE term IN (SELECT term FROM {q}) GROUP BY ALL),
 df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL),
 scored AS (SELECT query_id, {key}, round(sum(boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM tf JOIN df USING (field, term) JOIN stats USING (field) JOIN {q} USING (term) GROUP BY ALL),
 {hits} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {key}) AS pos FROM scored) WHERE pos <= {k})"""


def bm25_ctes() -> str:
    return views.PAPERS + f""", corpus AS (SELECT bib AS doc_key, title, text AS content, pub AS section_headers FROM papers),
 q AS (SELECT DISTINCT item_id AS query_id, unnest({_tok("array_to_string(string_split(text, ' ')[1:6], ' ')")}) AS term FROM benchmark),
 {_bm25("corpus", FIELDS, "doc_key", "q", 15, "text_hits")}"""


def embedded_sql(x: str) -> str:
    """`search.embed_checksums` of a text."""
    at = f"list_transform({_tok(x)}, lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % 64)"
    return f"(SELECT CASE WHEN n = 0 THEN v ELSE list_transform(v, lambda c: c / n) END FROM (SELECT v, sqrt(list_sum(list_transform(v, lambda c: c * c))) AS n FROM (SELECT list_transform(range(64), lambda i: len(list_filter(b, lambda a: a = i))::DOUBLE) AS v FROM (SELECT {at} AS b))))"


def topic_sql(asked: str, limit: int) -> str:
    """Paper search by a topic: both retrievers' candidates, reranked, weak ones if none is good."""
    return with_papers(f""", asked AS (SELECT {asked} AS query), ask AS (SELECT DISTINCT 1 AS query_id, unnest({_tok('query')}) AS term FROM asked),
 p AS (SELECT bib, title, abstract, array_to_string(keyword, ' ') AS keywords, title || chr(10) || chr(10) || abstract AS body FROM papers), {_bm25("p", search.PAPER_FIELDS, "bib", "ask", search.PAPER_CANDIDATES, "text_hits")},
 v AS (SELECT bib, {embedded_sql('body')} AS e FROM p), w AS (SELECT {embedded_sql('query')} AS q FROM asked),
 near AS (SELECT bib, row_number() OVER (ORDER BY s DESC, bib) AS pos FROM (SELECT bib, round(list_sum(list_transform(list_zip(e, q), lambda x: x[1] * x[2])), 6) AS s FROM v, w) QUALIFY pos <= {search.PAPER_CANDIDATES}),
 c AS (SELECT bib, min(place) AS place FROM (SELECT bib, pos AS place FROM near UNION ALL SELECT bib, pos + 1000000 FROM text_hits) GROUP BY bib),
 ranked AS (SELECT bib, score, row_number() OVER (ORDER BY score DESC, place) AS rank, count(*) FILTER (score > 0.5) OVER () AS n_over FROM (SELECT bib, place, len(list_intersect(list_distinct({_tok('query')}), {_tok('body')})) / len(list_distinct({_tok('query')})) AS score FROM c JOIN p USING (bib), asked))
 SELECT bib, (SELECT count(*) FROM papers) AS total, '' AS author_key, n_over = 0 AS weak FROM ranked WHERE CASE WHEN n_over > 0 THEN score > 0.5 AND rank <= {limit} ELSE rank <= {search.PAPER_FALLBACK} END""").replace(") , asked", "), asked")


def text_hits(spark, sf):
    return search.bm25(corpus(spark, sf), questions(spark, sf), FIELDS)


@query("rt02_bm25", f"WITH {bm25_ctes()} SELECT query_id, doc_key, score FROM text_hits")
def rt02(spark, sf):
    return text_hits(spark, sf).select("query_id", "doc_key", "score")


@query("rt02_postings_index", f"WITH {bm25_ctes()} SELECT query_id, doc_key, score FROM text_hits")
def rt02_index(spark, sf):
    """The same search over a kept index: bounds of blocks first, and only the blocks that can matter."""
    index = PostingsIndex(spark, shared_folder(spark, "postings")).build(corpus(spark, sf), FIELDS)
    return index.search(questions(spark, sf)).select("query_id", "doc_key", "score")


@query("top02_bm25_topk", f"WITH {bm25_ctes()} SELECT query_id, doc_key, pos FROM text_hits WHERE pos <= 5")
def top02(spark, sf):
    return text_hits(spark, sf).filter("pos <= 5").select("query_id", "doc_key", F.col("pos").cast("long").alias("pos"))


# the stated set of queries: every vector whose id is divisible by 100, numbered from 0
VECTORS = """vq AS (SELECT vec_id // 100 AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
 vscored AS (SELECT query_id, 'doc:' || lpad(vec_id::VARCHAR, 8, '0') AS doc_key, round(list_sum(list_transform(list_zip(embedding, q), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 6) AS score FROM embeddings, vq),
 vector_hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_key) AS pos FROM vscored) WHERE pos <= 15)"""


def vector_hits(spark, sf):
    e = table(spark, sf, "embeddings")
    rows = e.select(F.concat(F.lit("doc:"), F.lpad(F.col("vec_id").cast("string"), 8, "0")).alias("doc_key"), "embedding")
    return search.nearest(rows, e.filter("vec_id % 100 = 0").select(F.expr("vec_id div 100").alias("query_id"), F.col("embedding").alias("q")))


@query("rt01_vector_search", f"WITH {VECTORS} SELECT query_id, doc_key, score FROM vector_hits")
def rt01(spark, sf):
    return vector_hits(spark, sf).select("query_id", "doc_key", "score")


@query("top01_vector_topk", f"WITH {VECTORS} SELECT query_id, doc_key, pos FROM vector_hits")
def top01(spark, sf):
    return vector_hits(spark, sf).select("query_id", "doc_key", F.col("pos").cast("long").alias("pos"))


def vector_index(spark, sf):
    """The vectors' index in a folder of its own, and the stated queries."""
    e = table(spark, sf, "embeddings")
    rows = e.select(F.concat(F.lit("doc:"), F.lpad(F.col("vec_id").cast("string"), 8, "0")).alias("doc_key"), "embedding")
    asked = e.filter("vec_id % 100 = 0").select(F.expr("vec_id div 100").alias("query_id"), F.col("embedding").alias("q"))
    return VectorIndex(spark, shared_folder(spark, "vectors")).build(rows), asked


@query("rt01_vector_index")
def rt01_index(spark, sf):
    """Approximate search over the index; tests hold its recall against rt01_vector_search."""
    index, asked = vector_index(spark, sf)
    return index.search(asked).select("query_id", F.col("key").alias("doc_key"), "score")


@query("rt01_index_recall", f"WITH {VECTORS} SELECT count(DISTINCT query_id) AS queries, (SELECT count(*) FROM embeddings) AS indexed, true AS nine_in_ten FROM vector_hits")
def rt01_recall(spark, sf):
    """All rows are in the index, and nine in ten of the exact hits are found."""
    index, asked = vector_index(spark, sf)
    exact = written(vector_hits(spark, sf).select("query_id", "doc_key"), "exact")
    share = recall(index.search(asked), exact)
    return exact.agg(F.count_distinct("query_id").alias("queries")).select("queries", F.lit(index.rows().count()).alias("indexed"), F.lit(share >= 0.9).alias("nine_in_ten"))


UNION = f"{bm25_ctes()}, {VECTORS}, candidates AS (SELECT query_id, doc_key, min(place) AS place, array_to_string(list_sort(list(DISTINCT label)), '+') AS found_by FROM (SELECT query_id, doc_key, pos AS place, 'vector' AS label FROM vector_hits UNION ALL SELECT query_id, doc_key, pos + 1000000, 'bm25' FROM text_hits) GROUP BY query_id, doc_key)"


def candidates(spark, sf, near=None):
    return search.union_candidates(vector_hits(spark, sf) if near is None else near, text_hits(spark, sf)).withColumn("found_by", F.array_join("found_by", "+"))


@query("set01_candidate_union", f"WITH {UNION} SELECT query_id, doc_key, place, found_by FROM candidates")
def set01(spark, sf):
    return candidates(spark, sf).select("query_id", "doc_key", F.col("place").cast("long").alias("place"), "found_by")


@query("rt03_candidate_union", f"WITH {UNION} SELECT query_id, count(*) AS pool FROM candidates GROUP BY query_id")
def rt03(spark, sf):
    return candidates(spark, sf).groupBy("query_id").agg(F.count(F.lit(1)).alias("pool"))


@query("agg18_retriever_overlap", f"WITH {UNION} SELECT query_id, count(*) FILTER (contains(found_by, 'vector')) AS n_vector, count(*) FILTER (contains(found_by, 'bm25')) AS n_bm25, count(*) FILTER (contains(found_by, '+')) AS n_overlap FROM candidates GROUP BY query_id")
def agg18(spark, sf):
    c = candidates(spark, sf)
    return c.groupBy("query_id").agg(*[F.count_if(F.col("found_by").contains(x)).alias(n) for x, n in (("vector", "n_vector"), ("bm25", "n_bm25"), ("+", "n_overlap"))])


RERANKED = f"""{UNION}, qs AS (SELECT item_id AS query_id, list_distinct({_tok("array_to_string(string_split(text, ' ')[1:6], ' ')")}) AS qt FROM benchmark),
 pairs AS (SELECT c.query_id, c.doc_key, c.place, len(list_intersect(qt, {_tok('content')})) / len(qt) AS score FROM candidates c JOIN qs USING (query_id) JOIN corpus USING (doc_key)),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place) AS rank, count(*) FILTER (score > 0.5) OVER (PARTITION BY query_id) AS n_over FROM pairs),
 final AS (SELECT *, n_over = 0 AS weak FROM ranked WHERE CASE WHEN n_over > 0 THEN score > 0.5 AND rank <= 7 ELSE rank <= 2 END)"""


def with_texts(spark, sf, found=None):
    """The questions' candidates with their texts: these few are counted and sent to the texts, which are not shuffled."""
    c = written((candidates(spark, sf) if found is None else found).join(search.small(questions(spark, sf)), "query_id"), "asked")
    return search.small(c).join(corpus(spark, sf), "doc_key")


def final(spark, sf, found=None):
    c = with_texts(spark, sf, found)
    return search.rerank(c.select("query_id", "doc_key", "place", "found_by", search.lexical_score(F.col("query"), F.col("content")).alias("score")))


@query("rt04_rerank", f"WITH {RERANKED} SELECT query_id, doc_key, rank, round(score, 6) AS score FROM final")
def rt04(spark, sf):
    return final(spark, sf).select("query_id", "doc_key", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("top03_rerank_fallback", f"WITH {RERANKED} SELECT query_id, weak, count(*) AS kept FROM final GROUP BY query_id, weak")
def top03(spark, sf):
    return final(spark, sf).groupBy("query_id", "weak").agg(F.count(F.lit(1)).alias("kept"))


@query("rt05_passages", f"WITH {RERANKED} SELECT query_id, doc_key, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS passage FROM final")
def rt05(spark, sf):
    return final(spark, sf).select("query_id", "doc_key", F.col("rank").cast("long").alias("passage"))


def _found(result):
    rows, total, key = result
    return rows.select("bib", F.lit(total).cast("long").alias("total"), F.lit(key or "").alias("author_key"), "weak")


_author = "len(list_filter(author, lambda a: ends_with(lower(string_split(a, ',')[1]), '{k}'))) > 0"
_listed = "SELECT bib, (SELECT count(*) FROM hit) AS total, '{k}' AS author_key, false AS weak FROM hit ORDER BY date[1:10] DESC, bib LIMIT {n}"


@query("rt06_find_papers_listed", with_papers(", hit AS (SELECT * FROM papers WHERE year::INTEGER BETWEEN 2005 AND 2006) ".replace(", hit", ", hit", 1) + _listed.format(k="", n=10)).replace(") , hit", "), hit"))
def rt06_listed(spark, sf):
    return _found(search.find_papers(paper_index(spark, sf), year_from=2005, year_to=2006))


@query("rt06_find_papers_author", with_papers(", hit AS (SELECT * FROM papers WHERE " + _author.format(k="nation 7") + ") " + _listed.format(k="nation 7", n=25)))
def rt06_author(spark, sf):
    return _found(search.find_papers(paper_index(spark, sf), author_key="nation 7", limit=99))


@query("rt07_author_retry", with_papers(", hit AS (SELECT * FROM papers WHERE doc_id % 5 = 0) " + _listed.format(k="der", n=10)))
def rt07(spark, sf):
    # 'of nowhere der' matches nothing, its last word would be a particle; compound surnames are found by their own run
    p = paper_index(spark, sf).withColumn("author_keys", F.when(F.exists("author_keys", lambda k: k.startswith("van der")), F.array(F.lit("der"))).otherwise(F.col("author_keys")))
    return _found(search.find_papers(p, author_key="of nowhere der"))


@query("rt06_find_papers_topic", topic_sql("(SELECT array_to_string(string_split(text, ' ')[1:8], ' ') FROM benchmark ORDER BY item_id LIMIT 1)", 5))
def rt06_topic(spark, sf):
    first = table(spark, sf, "benchmark").orderBy("item_id").first()["text"]
    return _found(search.find_papers(paper_index(spark, sf), query=" ".join(first.split()[:8]), limit=5))


@query("top04_weak_papers", topic_sql("'the qqqq wwww xxxx zzzz'", 10))
def top04(spark, sf):
    return _found(search.find_papers(paper_index(spark, sf), query="the qqqq wwww xxxx zzzz"))


@query("rt08_fresh_only", f"WITH {UNION} SELECT query_id, doc_key FROM candidates WHERE doc_key NOT IN (SELECT doc_key FROM vector_hits)")
def rt08(spark, sf):
    near = written(vector_hits(spark, sf), "vector_hits")
    return search.fresh_only(candidates(spark, sf, near).select("query_id", "doc_key"), near)


@query("rt09_document_identity", with_papers("SELECT CASE WHEN doc_id % 2 = 0 THEN bib || '#0001' ELSE 'paper:' || bib END AS doc_key FROM papers"))
def rt09(spark, sf):
    c = F.when(F.col("doc_id") % 2 == 0, T.chunk_id(F.col("bib"), F.lit(1)))
    return views.papers(spark, sf).select(F.coalesce(c, F.concat(F.lit("paper:"), "bib")).alias("doc_key"))


@query("rt10_embedding_text", with_papers("SELECT bib, title || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '' ELSE pub END || chr(10) || chr(10) || abstract AS t FROM papers"))
def rt10(spark, sf):
    path = V.header_path(F.array(F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("pub"))))
    return views.papers(spark, sf).select("bib", F.concat_ws("\n", "title", path, F.lit(""), "abstract").alias("t"))


@query("rt11_abstract_object", with_papers("SELECT bib || '#abstract' AS chunk_id, 0 AS chunk_index, CASE WHEN doc_id % 4 = 0 THEN title ELSE abstract END AS content FROM papers"))
def rt11(spark, sf):
    a = F.when(F.col("doc_id") % 4 == 0, F.lit("")).otherwise(F.col("abstract"))
    return views.papers(spark, sf).select(F.concat("bib", F.lit("#abstract")).alias("chunk_id"), F.lit(0).alias("chunk_index"), F.coalesce(F.nullif(a, F.lit("")), F.col("title")).alias("content"))


@query("rt12_paper_objects")
def rt12(spark, sf):
    """Chunks of every paper, and its abstract where the text does not hold it."""
    p = views.papers(spark, sf)
    cut = chunking.chunk_documents(p.select("doc_id", "markdown"))
    chunks = cut.join(p.select("doc_id", "bib"), "doc_id").select(T.chunk_id(F.col("bib"), F.col("chunk_index")).alias("chunk_id"), "bib", "chunk_index", "content")
    lost = p.filter(T.abstract_share(F.col("abstract"), F.col("text")) < 0.4)
    return chunks.unionByName(lost.select(F.concat("bib", F.lit("#abstract")).alias("chunk_id"), "bib", F.lit(0).alias("chunk_index"), F.col("abstract").alias("content")))


# chunking ------------------------------------------------------------------------------------------------------------


def markdown(spark, sf):
    return views.papers(spark, sf).select("doc_id", "markdown")


@query("chk01_sections")
def chk01(spark, sf):
    def cut(frames):
        import pandas as pd

        for f in frames:
            rows = [(d, k, " > ".join(h), len(b)) for d, m in zip(f["doc_id"], f["markdown"]) for k, (h, b) in enumerate(chunking.sections(m or ""))]
            yield pd.DataFrame(rows, columns=["doc_id", "pos", "headers", "n_chars"])

    return markdown(spark, sf).mapInPandas(cut, "doc_id long, pos int, headers string, n_chars int")


@query("chk02_packed_paragraphs")
def chk02(spark, sf):
    return chunking.chunk_documents(markdown(spark, sf)).select("doc_id", "chunk_index", "tokens")


@query("chk03_hard_split", "SELECT doc_id, len(w)::BIGINT AS words, sha256(array_to_string(w, ' ')) AS digest, true AS whole FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS w FROM documents)")
def chk03(spark, sf):
    """Hard splits lose no word, and no piece of several words is over the limit: the pieces, joined, are the text's words."""

    def cut(frames):
        import hashlib

        for f in frames:
            out = []
            for d, t in zip(f["doc_id"], f["text"], strict=True):
                pieces = chunking.split_words(t or "", 64, chunking.estimate)
                words = " ".join(pieces)
                out.append((d, len(words.split()), hashlib.sha256(words.encode()).hexdigest(), all(" " not in p or chunking.estimate(p) <= 64 for p in pieces)))
            yield pd.DataFrame(out, columns=["doc_id", "words", "digest", "whole"])

    return table(spark, sf, "documents").select("doc_id", "text").mapInPandas(cut, "doc_id long, words long, digest string, whole boolean")


@query("chk04_table_split", "SELECT source, count(*) AS rows, sum(doc_id)::BIGINT AS ids, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source")
def chk04(spark, sf):
    """A pipe table of each source's documents, split by rows under its header; all rows come back with their cells."""
    head = "| id | n | s |\n|---|---|---|\n"

    def cut(frames):
        for f in frames:
            out = []
            for s, rows in zip(f["source"], f["rows"], strict=True):
                pieces = chunking.split_table(head + "\n".join(rows), 200, chunking.estimate)
                if not all(p.startswith(head) for p in pieces):
                    raise ValueError("a piece without the table's header")
                cells = [line.split("|") for p in pieces for line in p[len(head) :].split("\n")]
                out.append((s, len(cells), sum(int(c[1]) for c in cells), sum(int(c[2]) for c in cells)))
            yield pd.DataFrame(out, columns=["source", "rows", "ids", "chars"])

    d = table(spark, sf, "documents").select("source", "doc_id", F.concat(F.lit("| "), F.col("doc_id").cast("string"), F.lit(" | "), F.col("n_chars").cast("string"), F.lit(" | x |")).alias("row"))
    # a part holds the rows of 4,096 ids at most, however many a source has
    parts = d.groupBy("source", F.floor(F.col("doc_id") / 4096)).agg(F.collect_list("row").alias("rows"))
    counted = parts.select("source", "rows").mapInPandas(cut, "source string, rows long, ids long, chars long")
    return counted.groupBy("source").agg(*[F.sum(c).alias(c) for c in ("rows", "ids", "chars")])


@query("chk05_coalesced")
def chk05(spark, sf):
    c = chunking.chunk_documents(markdown(spark, sf), chunking.ChunkSettings(max=128, overlap=16, min=48))
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("tokens") < 48).alias("small"))


@query("chk06_chunks")
def chk06(spark, sf):
    return chunking.chunk_documents(markdown(spark, sf)).select("doc_id", "chunk_index", F.array_join("headers", " > ").alias("headers"), "content", "part", "n_parts")


@query("chk07_settings", "SELECT 512 AS max, 64 AS overlap, 48 AS min, 8192 AS atomic_max")
def chk07(spark, sf):
    s = chunking.ChunkSettings()
    return spark.createDataFrame([(s.max, s.overlap, s.min, s.atomic_max)], "max int, overlap int, min int, atomic_max int")


@query("chk08_corpus_build")
def chk08(spark, sf):
    """All papers: licence and quality gate, fingerprint and objects, with four counts, what was left out, and a checksum of all objects."""
    allowed = records.access_class(arxiv(), F.col("property")) != "paywalled"
    named = {
        "authors": F.array_join("author", "; "), "short_ref": T.short_ref(F.col("author"), F.col("year")), "journal": F.col("pub"),
        "pub_date": F.substring("date", 1, 10), "published": F.substring("date", 1, 10).try_cast("date"), "link": F.lit(""), "doi": F.coalesce(F.get("doi", F.lit(0)), F.lit("")), "arxiv_id": F.coalesce(arxiv(), F.lit("")),
    }
    p = views.papers(spark, sf).withColumns({"allowed": allowed, "problem": chunking.text_problem(F.col("title"), F.col("text"))}).withColumns(named)
    p = p.withColumn("full", F.col("allowed") & F.col("problem").isNull())
    left_out = [F.count_if(~F.col("allowed")).alias("not_allowed"), F.count_if(F.col("allowed") & F.col("problem").isNotNull()).alias("wrong_content")]
    papers = p.agg(F.count(F.lit(1)).alias("papers"), F.count_if("full").alias("full_text"), F.count_if(~F.col("full")).alias("abstract_only"), *left_out)
    objects = chunking.paper_objects(p)
    made = objects.agg(F.count(F.lit(1)).alias("objects"), F.bit_xor(F.xxhash64(*objects.columns)).alias("checksum"))
    return papers.crossJoin(made).select("papers", "full_text", "abstract_only", "objects", "not_allowed", "wrong_content", "checksum")


@query("chk11_page_assembly", f"WITH {views.SITE}, e AS (SELECT page_id, url, unnest(list_concat(blocks, links)) AS b, unnest(range(0, len(blocks) + len(links))) AS pos FROM site), furniture AS (SELECT b FROM (SELECT DISTINCT page_id, b FROM e) GROUP BY b HAVING count(*) > 0.01 * (SELECT count(*) FROM site)), md AS (SELECT page_id, string_agg(b, chr(10) || chr(10) ORDER BY pos) AS md FROM e WHERE b NOT IN (SELECT b FROM furniture) GROUP BY page_id) SELECT min(page_id) AS page_id, count(*) - 1 AS aliases, sha256(md) AS digest FROM md WHERE len(list_filter(regexp_split_to_array(md, '[ \\t\\n\\r\\f]+'), lambda x: x <> '')) >= 5 GROUP BY md")
def chk11(spark, sf):
    from quillstone.sources.site import assemble_pages

    s = views.site_pages(spark, sf).select("page_id", "url", F.concat("blocks", "links").alias("blocks"))
    return assemble_pages(s, 0.01).select("page_id", "aliases", F.sha2("markdown", 256).alias("digest"))


_said = ("This website was last updated on 14 September 2026.", "Last updated on 3 Oct 2025")
_site_build = (
    f"WITH {views.SITE}, s AS (SELECT page_id, list_append(blocks, CASE WHEN page_id % 2 = 0 THEN '{_said[0]}' ELSE '{_said[1]}' END) AS blocks, CASE WHEN page_id % 3 = 0 THEN links[1:2] ELSE [] END AS news FROM site), "
    "e AS (SELECT page_id, unnest(blocks) AS b, unnest(range(0, len(blocks))) AS pos FROM s), furniture AS (SELECT b FROM (SELECT DISTINCT page_id, b FROM e) GROUP BY b HAVING count(*) > 0.3 * (SELECT count(*) FROM s)), "
    "kept AS (SELECT page_id, b, pos FROM e WHERE b NOT IN (SELECT b FROM furniture) UNION ALL SELECT page_id, '## News items' || chr(10) || chr(10) || array_to_string(list_transform(news, lambda x: '- 2024-01-05: [' || x || '](' || x || ')'), chr(10)), 2147483647 FROM s WHERE len(news) > 0), "
    "md AS (SELECT page_id, string_agg(b, chr(10) || chr(10) ORDER BY pos) AS md FROM kept WHERE regexp_matches(b, '[^ \\t\\n\\r\\f]') GROUP BY page_id) "
    "SELECT min(page_id) AS page_id, count(*) - 1 AS aliases, sha256(md) AS digest, DATE '2026-09-14' AS updated FROM md WHERE len(list_filter(regexp_split_to_array(md, '[ \\t\\n\\r\\f]+'), lambda x: x <> '')) >= 5 GROUP BY md"
)


@query("chk11_site_build", _site_build)
def chk11_build(spark, sf):
    """Pages with their news cards, without furniture, and the date that the furniture gives."""
    from quillstone.sources.site import assemble_pages, site_updated

    said = F.when(F.col("page_id") % 2 == 0, _said[0]).otherwise(_said[1])
    card = lambda x: F.struct(x.alias("title"), x.alias("link"), F.lit("2024-01-05").alias("date"))
    news = F.transform(F.when(F.col("page_id") % 3 == 0, F.slice("links", 1, 2)).otherwise(F.array()), card)
    s = views.site_pages(spark, sf).select("page_id", "url", F.array_append("blocks", said).alias("blocks"), news.alias("news"))
    pages = assemble_pages(s, 0.3).select("page_id", "aliases", F.sha2("markdown", 256).alias("digest"))
    return pages.join(F.broadcast(site_updated(s, 0.3)))


@query("chk09_html_to_markdown")
def chk09(spark, sf):
    from quillstone.sources.site import html_to_markdown_udf

    return table(spark, sf, "pages").select("page_id", html_to_markdown_udf()(F.col("html")).alias("markdown"))


@query("str26_renumber", with_papers("SELECT doc_id, 1 AS title, CASE WHEN trim(title) = '' THEN 0 ELSE 1 END AS inherited FROM papers"))
def str26(spark, sf):
    return chunking.renumber_documents(views.papers(spark, sf)).select("doc_id", "title", "inherited")


@query("str28_image_inventory", with_papers("SELECT doc_id, pos::INTEGER AS pos, 'fig' || pos || '.png' AS path, pub AS section FROM papers, range(0, 3) t(pos) WHERE pos <= doc_id % 3"))
def str28(spark, sf):
    figures = F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int")), lambda i: F.concat(F.lit("![c"), i.cast("string"), F.lit("](fig"), i.cast("string"), F.lit(".png)")))
    md = F.concat(F.lit("# "), "pub", F.lit("\n\n"), F.array_join(figures, "\n"))
    return chunking.image_inventory(views.papers(spark, sf).select("doc_id", md.alias("markdown"))).select("doc_id", "pos", "path", "section")


@query("str33_tex_title", "SELECT doc_id, lang || ' {' || source || '} study' AS title FROM documents")
def str33(spark, sf):
    from quillstone.sources.files import tex_title_udf

    tex = F.concat(F.lit("\\documentclass{x}\n\\title{"), "lang", F.lit(" {"), "source", F.lit("} study}\n\\begin{document}"))
    return table(spark, sf, "documents").select("doc_id", tex_title_udf()(tex).alias("title"))


@query("dt05_false_dates", with_papers("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '# T' || chr(10) || 'body' ELSE '# T' || chr(10) || '21 June 2010' || chr(10) || 'body' END AS markdown FROM papers"))
def dt05(spark, sf):
    line = F.when(F.col("doc_id") % 2 == 0, F.lit("(June 21, 2026)")).otherwise(F.lit("21 June 2010"))
    d = views.papers(spark, sf).select("doc_id", F.concat(F.lit("# T\n"), line, F.lit("\nbody")).alias("markdown"), F.lit("2010-06-01").cast("date").alias("published"))
    return chunking.drop_false_dates(d)


@query("win07_header_stack", "SELECT doc_id, pos, CASE WHEN pos >= 0 THEN 'T' END AS h1, CASE WHEN pos = 0 THEN NULL WHEN pos < 3 THEN 'A' ELSE 'B' END AS h2, CASE WHEN pos = 2 THEN 'a' END AS h3 FROM documents, range(0, 5) t(pos)")
def win07(spark, sf):
    lines = "from_json('[{\"level\":1,\"text\":\"T\"},{\"level\":2,\"text\":\"A\"},{\"level\":3,\"text\":\"a\"},{\"level\":2,\"text\":\"B\"},{\"text\":\"x\"}]', 'array<struct<level: int, text: string>>')"
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.expr(lines)).alias("pos", "l")).select("doc_id", F.col("pos").cast("long").alias("pos"), "l.level", "l.text")
    return chunking.header_stack(d).select("doc_id", "pos", "h1", "h2", "h3")


# evaluation ----------------------------------------------------------------------------------------------------------

EVAL = f"""{RERANKED}, {views.GOLDEN}, hits AS (SELECT g.item_id, count(c.doc_key) AS in_pool, min(f.rank) AS final_rank, array_to_string(list_sort(list(DISTINCT c.found_by)), ',') AS found_via
 FROM (SELECT item_id, unnest(expected) AS doc_key FROM golden) g LEFT JOIN candidates c ON c.query_id = g.item_id AND c.doc_key = g.doc_key LEFT JOIN final f ON f.query_id = g.item_id AND f.doc_key = g.doc_key GROUP BY g.item_id)"""


def eval_items(spark, sf):
    g = views.golden(spark, sf).select(F.col("item_id").alias("query_id"), F.explode("expected").alias("doc_key"))
    c = written(candidates(spark, sf), "candidates")
    out = g.join(c.select("query_id", "doc_key", "found_by"), ["query_id", "doc_key"], "left").join(final(spark, sf, c).select("query_id", "doc_key", "rank"), ["query_id", "doc_key"], "left")
    return out.groupBy(F.col("query_id").alias("item_id")).agg(F.count("found_by").alias("in_pool"), F.min("rank").cast("long").alias("final_rank"), F.array_join(F.array_sort(F.collect_set("found_by")), ",").alias("found_via"))


@query("evl01_retrieval_items", f"WITH {EVAL} SELECT item_id, in_pool > 0 AS in_pool, final_rank, coalesce(found_via, '') AS found_via FROM hits")
def evl01(spark, sf):
    return eval_items(spark, sf).withColumn("in_pool", F.col("in_pool") > 0)


@query("evl02_all_listed", f"WITH {EVAL} SELECT item_id, in_pool = (SELECT len(expected) FROM golden g WHERE g.item_id = hits.item_id) AS all_listed FROM hits")
def evl02(spark, sf):
    got = candidates(spark, sf).groupBy(F.col("query_id").alias("item_id")).agg(F.collect_set("doc_key").alias("got"))
    g = views.golden(spark, sf).join(got, "item_id", "left")
    return g.select("item_id", (F.size(F.array_except("expected", F.coalesce("got", F.array().cast("array<string>")))) == 0).alias("all_listed"))


@query("evl03_full_items", f"WITH {views.REPLIES} SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN contains(reply, 'er') END AS matches, CASE WHEN turn % 5 = 1 THEN contains(reply, '[1]') END AS cites, conv_id % 7 <> 0 AND length(reply) > 200 AS long_enough FROM replies")
def evl03(spark, sf):
    r = views.replies(spark, sf)
    ok = F.col("conv_id") % 7 != 0
    return r.select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.col("reply").rlike("er")).alias("matches"), F.when(F.col("turn") % 5 == 1, F.col("reply").contains("[1]")).alias("cites"), (ok & (F.length("reply") > 200)).alias("long_enough"))


@query("evl04_bogus_citations", f"WITH {views.REPLIES} SELECT conv_id, turn, len(list_filter(list_distinct(list_transform(regexp_extract_all(reply, '(?s)<cite>(.*?)</cite>', 1), lambda x: trim(x))), lambda m: NOT (regexp_full_match(m, '[0-9]{{1,9}}') AND try_cast(m AS INTEGER) BETWEEN 1 AND 5)))::BIGINT AS bogus FROM replies")
def evl04(spark, sf):
    n = T.cited_numbers(T.cited(F.col("reply")), F.lit(5))
    return views.replies(spark, sf).select("conv_id", "turn", F.size(F.filter(n, lambda x: x.isNull())).cast("long").alias("bogus"))


@query("evl05_flag_check", f"WITH {views.REPLIES} SELECT conv_id, turn, contains(lower(reply), 'general knowledge') AS flagged FROM replies")
def evl05(spark, sf):
    return views.replies(spark, sf).select("conv_id", "turn", F.lower("reply").contains("general knowledge").alias("flagged"))


@query("evl06_against_earlier", f"WITH {views.RUNS}, a AS (SELECT question, count(*) FILTER (passed) AS n FROM runs WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT question, count(*) FILTER (passed) AS n FROM runs WHERE event_id % 2 = 1 GROUP BY 1) SELECT question, a.n AS before, b.n AS after FROM a JOIN b USING (question) WHERE a.n IS DISTINCT FROM b.n")
def evl06(spark, sf):
    r = views.runs(spark, sf)
    a, b = (r.filter(F.col("event_id") % 2 == k).groupBy("question").agg(F.count_if("passed").alias(n)) for k, n in ((0, "before"), (1, "after")))
    return a.join(b, "question").filter(~F.col("before").eqNullSafe(F.col("after"))).select("question", "before", "after")


@query("evl07_source_identity", with_papers("SELECT a AS given, bib AS source FROM (SELECT bib, unnest(aliases) AS a FROM papers)"))
def evl07(spark, sf):
    from quillstone.operators.records import alias_map, resolve

    a = alias_map(views.papers(spark, sf))
    return resolve(a.select(F.col("alias").alias("given")), a, "given").select("given", F.col("bib").alias("source"))


@query("udf01_token_counter", "SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> ''))::BIGINT AS tokens FROM documents")
def udf01(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(search.tokens(F.col("text"))).cast("long").alias("tokens"))


@query("udf02_atomic_predicate", "SELECT doc_id, len(l) >= 3 AND len(list_filter(l, lambda x: length(x) - length(replace(x, '|', '')) >= 3)) >= 0.8 * len(l) AS atomic FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents)")
def udf02(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", chunking.table_lines(F.col("text")).alias("l"))
    return lines.select("doc_id", chunking.table_of_lines(F.col("l")).alias("atomic"))


def _rounded(e):
    return F.transform(e, lambda x: F.round(x, 6)).alias("embedding")


@query("udf03_document_embedder")
def udf03(spark, sf):
    return table(spark, sf, "documents").select("doc_id", _rounded(search.embed_hashing(F.col("text"))))


@query("udf04_query_embedder")
def udf04(spark, sf):
    return questions(spark, sf).select("query_id", _rounded(search.embed_hashing(F.col("query"))))


@query("udf03_document_checksums", f"SELECT doc_id, list_transform({embedded_sql('text')}, lambda x: round(x, 6)) AS embedding FROM documents")
def udf03_checksums(spark, sf):
    return table(spark, sf, "documents").select("doc_id", _rounded(search.embed_checksums(F.col("text"))))


@query("udf04_query_checksums", f"SELECT query_id, list_transform({embedded_sql('query')}, lambda x: round(x, 6)) AS embedding FROM (SELECT item_id AS query_id, array_to_string(string_split(text, ' ')[1:6], ' ') AS query FROM benchmark)")
def udf04_checksums(spark, sf):
    return questions(spark, sf).select("query_id", _rounded(search.embed_checksums(F.col("query"))))


@query("udf05_pair_scores", f"WITH {RERANKED} SELECT query_id, doc_key, round(score, 6) AS score FROM pairs")
def udf05(spark, sf):
    return with_texts(spark, sf).select("query_id", "doc_key", F.round(search.lexical_score(F.col("query"), F.col("content")), 6).alias("score"))


@query("udf06_router", "SELECT item_id AS query_id, item_id % 6 = 4 AS about_service, CASE WHEN item_id % 3 = 0 THEN text ELSE 'q ' || item_id END AS search_query FROM benchmark")
def udf06(spark, sf):
    """The router over all questions with a stand-in model: one that never answers, one that does at the second try, one that always does."""

    def run(frames):
        for f in frames:
            out = []
            for n, text in zip(f["item_id"], f["text"], strict=True):
                left = iter(["no JSON"] * (9 if n % 3 == 0 else n % 3 - 1))
                ready = '{"about_service": %s, "search_query": " q %d "}' % ("true" if n % 6 == 4 else "false", n)
                out.append((n, *answers.route(lambda question: next(left, ready), text).values()))  # noqa: B023
            yield pd.DataFrame(out, columns=["query_id", "about_service", "search_query"])

    return table(spark, sf, "benchmark").select("item_id", "text").mapInPandas(run, "query_id long, about_service boolean, search_query string")


def answered(spark, sf):
    """Answers of the stand-in model to all golden questions, driven by the loop on executors."""
    found = final(spark, sf).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_key"))).alias("found"))
    rows = questions(spark, sf).join(found, "query_id", "left").select("query_id", "query", F.col("found.doc_key").alias("keys"))

    def run(batches):
        for b in batches:
            out = []
            for query_id, query, keys in zip(b["query_id"], b["query"], b["keys"], strict=True):
                docs = [{"key": k} for k in (() if keys is None else keys)]
                a = answers.answer_loop(answers.RuleModel(), query, docs[:2], {"search_papers": lambda args, d=docs: d}, 1)
                out.append((query_id, a.reply, len(a.docs), len(a.calls)))
            yield pd.DataFrame(out, columns=["query_id", "reply", "docs", "calls"])

    return rows.mapInPandas(run, "query_id long, reply string, docs int, calls int")


@query("udf07_answer_loop")
def udf07(spark, sf):
    return answered(spark, sf)


@query("udf08_tool_dispatch", "SELECT * FROM (VALUES ('nothing', 'There is no tool named nothing.'), ('bad', 'The arguments are not JSON.'), ('list', 'The arguments are not an object.'), ('empty', 'The arguments hold no query.'), ('old', 'Everything this search found was given before.'), ('none', 'Nothing was found.')) t(kind, message)")
def udf08(spark, sf):
    tools = {"t": lambda a: [{"key": "k"}] if a["query"] == "old" else []}
    calls = [("nothing", {"name": "nothing"}), ("bad", {"name": "t", "arguments": "{"}), ("list", {"name": "t", "arguments": "[]"}), ("empty", {"name": "t", "arguments": "{}"}), ("old", {"name": "t", "arguments": '{"query": "old"}'}), ("none", {"name": "t", "arguments": '{"query": "x"}'})]
    return spark.createDataFrame([(k, answers.dispatch(c, tools, {"k"})[1]) for k, c in calls], "kind string, message string")


@query("udf10_prompt", "SELECT item_id, 'S' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'B' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'User message: ' || text AS prompt FROM benchmark")
def udf10(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.concat_ws("\n\n---\n\n", F.lit("S"), F.lit("B"), F.concat(F.lit("User message: "), "text")).alias("prompt"))


@query("udf12_tool_schemas", "SELECT * FROM (VALUES ('find_papers', 6), ('search_papers', 1), ('search_site', 1)) t(tool, parameters)")
def udf12(spark, sf):
    return spark.createDataFrame([(t, len(s["properties"])) for t, s in answers.TOOLS.items()], "tool string, parameters int")


