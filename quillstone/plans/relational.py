"""Queries of the filters, joins, aggregates, windows, top-k and set operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone.functions import licences as L
from quillstone.functions import text as T
from quillstone.functions import values as V
from quillstone.operators import answers, chunking, ranks, records, search
from quillstone.operators.aliases import transitive_aliases
from quillstone.operators.facets import facet_bitmaps, facet_totals
from quillstone.plans import views
from quillstone.plans.registry import query, table
from quillstone.plans.scalar import class_sql, label_sql, openalex_sql, rank_sql, with_papers, word_count_sql, words_sql
from quillstone.session import written
from quillstone.sources.files import BOT_CHECK

TODAY = "2026-01-01"


def with_state(body: str) -> str:
    return f"WITH {views.STATE}, aliases AS (SELECT unnest(aliases) AS alias, bib FROM papers) {body}"


def arxiv():
    return F.substring(F.get(F.filter("identifier", lambda x: x.startswith("arXiv:")), F.lit(0)), 7, 100)


_arxiv = "substr(list_filter(identifier, lambda x: starts_with(x, 'arXiv:'))[1], 7)"

# filters and projections ---------------------------------------------------------------------------------------------


@query("flt01_paper_projection", with_papers("SELECT bib, array_to_string(author, '; ') AS authors, year::INTEGER AS year, doi[1] AS doi, epoch(date::TIMESTAMPTZ)::BIGINT AS pub_seconds FROM papers"))
def flt01(spark, sf):
    return views.papers(spark, sf).select(
        "bib", F.array_join("author", "; ").alias("authors"), F.when(F.col("year").rlike("^[0-9]+$"), F.col("year").try_cast("int")).alias("year"),
        F.get("doi", F.lit(0)).alias("doi"), F.unix_timestamp(V.iso_timestamp(F.col("date"))).alias("pub_seconds"),
    )


@query("flt02_non_empty_fields", with_papers("SELECT bib, nullif(title, '') AS title, CASE WHEN len(doi) > 0 THEN array_to_string(doi, ',') END AS doi FROM papers"))
def flt02(spark, sf):
    return views.papers(spark, sf).select("bib", F.nullif(F.col("title"), F.lit("")).alias("title"), F.when(F.size("doi") > 0, F.array_join("doi", ",")).alias("doi"))


@query("flt03_deny_list", with_state("SELECT bib FROM papers WHERE NOT list_has_any(aliases, (SELECT list('old:' || lpad((i * 22)::VARCHAR, 8, '0')) FROM range(1000000) t(i)))"))
def flt03(spark, sf):
    p = views.papers(spark, sf)
    denied = p.filter("doc_id % 22 = 0").select(F.concat(F.lit("old:"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("alias"))
    hit = records.alias_map(p).join(denied, "alias", "left_semi")
    return p.select("bib").join(hit.select("bib"), "bib", "left_anti")


_access = f"CASE WHEN {_arxiv} IS NOT NULL THEN 'arxiv' WHEN list_has_any(property, ['PUB_OPENACCESS', 'EPRINT_OPENACCESS', 'AUTHOR_OPENACCESS']) THEN 'open access' ELSE 'paywalled' END"
_sources = f"list_filter([CASE WHEN {_arxiv} IS NOT NULL THEN 'arxiv-tex' END, CASE WHEN {_arxiv} IS NOT NULL OR list_contains(esources, 'EPRINT_PDF') THEN 'arxiv-pdf' END, CASE WHEN list_contains(esources, 'AUTHOR_PDF') THEN 'author-pdf' END, CASE WHEN list_contains(esources, 'PUB_PDF') AND list_contains(property, 'PUB_OPENACCESS') THEN 'publisher-pdf' END], lambda x: x IS NOT NULL)"


@query("flt04_access_class", with_papers(f"SELECT bib, {_access} AS access FROM papers"))
def flt04(spark, sf):
    return views.papers(spark, sf).select("bib", records.access_class(arxiv(), F.col("property")).alias("access"))


@query("flt05_source_list", with_papers(f"SELECT bib, array_to_string({_sources}, ',') AS sources FROM papers"))
def flt05(spark, sf):
    return views.papers(spark, sf).select("bib", F.array_join(records.source_list(arxiv(), F.col("esources"), F.col("property")), ",").alias("sources"))


_own = f"list_distinct(list_filter({words_sql('title')}, lambda w: length(w) > 3))"


@query("flt06_quality_gate", with_papers(f"SELECT bib, CASE WHEN len({_own}) > 0 AND len(list_intersect({_own}, {words_sql('substr(text, 1, 8000)')})) / len({_own}) < 0.5 THEN 'another text' WHEN {word_count_sql('text')} < 100 THEN 'too short' END AS problem FROM papers"))
def flt06(spark, sf):
    share = T.title_share(F.col("title"), T.opening(F.col("text")))
    return views.papers(spark, sf).select("bib", F.when(share < 0.5, "another text").when(T.word_count(F.col("text")) < 100, "too short").alias("problem"))


_drop = f"(?i)^(?:{chunking.DROPPED.pattern})"
_heads = "[pub, CASE doc_id % 6 WHEN 0 THEN '9. References and notes' WHEN 1 THEN 'A Reference frames' WHEN 2 THEN 'Key Words:' WHEN 3 THEN 'Keyword search' WHEN 4 THEN 'VIII Acknowledgments' ELSE '9.3 The list of references' END]"


@query("flt07_drop_sections", with_papers(f"SELECT bib, h[2] AS header FROM (SELECT bib, {_heads} AS h FROM papers) WHERE NOT (regexp_matches(h[1], '{_drop}') OR regexp_matches(h[2], '{_drop}'))"))
def flt07(spark, sf):
    p = views.papers(spark, sf).withColumn("h", F.expr(_heads.replace("[pub", "array(pub")[:-1] + ")"))
    return p.filter(~F.exists("h", lambda x: x.rlike(_drop))).select("bib", F.get("h", F.lit(1)).alias("header"))


@query("flt08_table_paragraphs", "SELECT doc_id, len(l)::BIGINT AS lines, len(l) >= 3 AND len(list_filter(l, lambda x: length(x) - length(replace(x, '|', '')) >= 3)) >= 0.8 * len(l) AS is_table FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents)")
def flt08(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", chunking.table_lines(F.col("text")).alias("l"))
    return lines.select("doc_id", F.size("l").cast("long").alias("lines"), chunking.table_of_lines(F.col("l")).alias("is_table"))


@query("flt09_captions", "SELECT doc_id, regexp_matches(t, '(?i)^\\s*(table|tab\\.)\\s*[0-9]+') AS caption FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Table ' || doc_id WHEN 1 THEN ' tab. 2: x' ELSE 'The table 3' END AS t FROM documents)")
def flt09(spark, sf):
    d = F.col("doc_id") % 3
    t = F.when(d == 0, F.concat(F.lit("Table "), F.col("doc_id").cast("string"))).when(d == 1, F.lit(" tab. 2: x")).otherwise(F.lit("The table 3"))
    return table(spark, sf, "documents").select("doc_id", t.rlike(r"(?i)^\s*(table|tab\.)\s*[0-9]+").alias("caption"))


_HOSTED = "regexp_extract(url, '^https?://([^/?#]*)', 1)"
_PATH = "regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)"


@query("flt10_page_urls", f"SELECT page_id, url FROM pages WHERE ends_with({_HOSTED}, 'example.org') AND (starts_with({_PATH}, '/en/') OR starts_with({_PATH}, '/de/')) AND NOT contains(url, '/-/') AND string_split({_PATH}, '/')[3] NOT IN ('1', '2', '3')")
def flt10(spark, sf):
    # pattern functions, not parse_url, which fails on odd addresses
    host, path = F.regexp_extract("url", "^https?://([^/?#]*)", 1), F.regexp_extract("url", "^https?://[^/?#]*([^?#]*)", 1)
    ok = host.endswith("example.org") & (path.startswith("/en/") | path.startswith("/de/")) & ~F.col("url").contains("/-/") & ~F.get(F.split(path, "/"), F.lit(2)).isin("1", "2", "3")
    return table(spark, sf, "pages").filter(ok).select("page_id", "url")


def paper_index(spark, sf):
    keys = F.transform("author", lambda a: T.surname_keys(a))
    p = views.papers(spark, sf).select(
        "bib", "title", "abstract", F.array_distinct(F.flatten(keys)).alias("author_keys"), F.get(keys, F.lit(0)).alias("first_author_keys"),
        F.col("year").cast("int").alias("year"), F.substring("date", 1, 10).alias("pub_date"), F.array_join("keyword", " ").alias("keywords"),
    )
    return p


@query("flt11_faceted_filter", with_papers("SELECT bib FROM papers WHERE len(list_filter(author, lambda a: ends_with(lower(string_split(a, ',')[1]), 'nation 7'))) > 0 AND year::INTEGER BETWEEN 2003 AND 2015"))
def flt11(spark, sf):
    return paper_index(spark, sf).filter(search.paper_filter("nation 7", False, 2003, 2015)).select("bib")


@query("flt12_minimum_text", f"SELECT doc_id FROM documents WHERE {word_count_sql('text')} >= 5")
def flt12(spark, sf):
    return table(spark, sf, "documents").filter(T.word_count(F.col("text")) >= 5).select("doc_id")


@query("flt13_threshold", "SELECT event_id FROM events WHERE value > 0.5")
def flt13(spark, sf):
    return table(spark, sf, "events").filter("value > 0.5").select("event_id")


_copy = "CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'arXiv preprint' WHEN 2 THEN 'author''s copy' ELSE 'published version' END"
_class = "CASE doc_id % 5 WHEN 0 THEN 'open licence' WHEN 1 THEN 'with conditions' WHEN 2 THEN NULL ELSE 'no licence' END"


@query("flt14_indexable", f"SELECT doc_id, CASE WHEN c IS NULL THEN false WHEN c IN ('arXiv preprint', 'author''s copy') THEN true ELSE coalesce(k IN ('open licence', 'with conditions'), false) END AS indexable FROM (SELECT doc_id, {_copy} AS c, {_class} AS k FROM documents)")
def flt14(spark, sf):
    d = table(spark, sf, "documents").selectExpr("doc_id", f"{_copy.replace(chr(39) * 2, chr(92) + chr(39))} AS c", f"{_class} AS k")
    return d.select("doc_id", records.indexable(F.col("c"), F.col("k")).alias("indexable"))


@query("flt15_licensed_sources", with_papers(f"SELECT bib, array_to_string(CASE WHEN {_class} = 'open licence' THEN {_sources} ELSE list_filter({_sources}, lambda s: s IN ('arxiv-tex', 'arxiv-pdf', 'author-pdf')) END, ',') AS sources FROM papers"))
def flt15(spark, sf):
    p = views.papers(spark, sf).withColumn("k", F.expr(_class))
    return p.select("bib", F.array_join(records.allowed_sources(records.source_list(arxiv(), F.col("esources"), F.col("property")), F.col("k")), ",").alias("sources"))


def _tried(spark, sf):
    entry = lambda name, cond, transient, count: F.when(F.expr(cond), F.struct(F.lit(name).alias("key"), F.struct(F.expr(transient).alias("transient"), F.expr(count).cast("int").alias("count")).alias("value")))
    tried = F.map_from_entries(F.array_compact(F.array(entry("arxiv-tex", "doc_id % 3 = 0", "doc_id % 2 = 0", "doc_id % 12"), entry("arxiv-pdf", "doc_id % 4 = 0", "false", "1"))))
    return views.papers(spark, sf).withColumn("tried", tried).withColumn("sources", records.source_list(arxiv(), F.col("esources"), F.col("property")))


_remain = f"list_filter({_sources}, lambda s: CASE WHEN s = 'arxiv-tex' AND doc_id % 3 = 0 THEN doc_id % 2 = 0 AND doc_id % 12 < 10 WHEN s = 'arxiv-pdf' AND doc_id % 4 = 0 THEN false ELSE true END)"


@query("flt16_remaining_sources", with_papers(f"SELECT bib, array_to_string({_remain}, ',') AS remaining FROM papers"))
def flt16(spark, sf):
    return _tried(spark, sf).select("bib", F.array_join(records.remaining_sources(F.col("sources"), F.col("tried")), ",").alias("remaining"))


@query("flt18_bot_check", "SELECT page_id, regexp_matches(substr(html, 1, 20000), '(?i)captcha|are you a robot|casino') OR regexp_matches(url, '(?i)captcha|casino') AS blocked FROM pages")
def flt18(spark, sf):
    return table(spark, sf, "pages").select("page_id", (F.substring("html", 1, 20000).rlike("(?i)" + BOT_CHECK) | F.col("url").rlike("(?i)captcha|casino")).alias("blocked"))


@query("flt19_site_questions", f"WITH {views.GOLDEN} SELECT item_id, item_id % 3 = 0 AS about_site FROM golden")
def flt19(spark, sf):
    e = F.when(F.col("item_id") % 3 == 0, F.transform("expected", lambda x: F.concat(F.lit("site:"), x))).when(F.col("item_id") % 3 == 1, F.slice("expected", 1, 0)).otherwise(F.col("expected"))
    return views.golden(spark, sf).withColumn("e", e).select("item_id", ((F.size("e") > 0) & F.forall("e", lambda x: x.startswith("site:"))).alias("about_site"))


@query("flt20_retrieval_items", "SELECT conv_id FROM conversations WHERE turn = 0 AND conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn > 3) AND conv_id % 2 = 0")
def flt20(spark, sf):
    c = table(spark, sf, "conversations")
    return c.filter("turn = 0 AND conv_id % 2 = 0").join(c.filter("turn > 3").select("conv_id"), "conv_id", "left_anti").select("conv_id")


@query("flt21_due_lookups", "SELECT doc_id FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0 OR (CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END) IS DISTINCT FROM (CASE WHEN doc_id % 6 = 0 THEN NULL ELSE 'en' END)")
def flt21(spark, sf):
    return table(spark, sf, "documents").filter("doc_id % 5 = 0 OR doc_id % 7 = 0 OR NOT ((CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END) <=> (CASE WHEN doc_id % 6 = 0 THEN NULL ELSE 'en' END))").select("doc_id")


@query("flt22_record_kind", with_state("SELECT chunk_id, CASE WHEN starts_with(chunk_id, 'gone:') THEN 'site' ELSE 'chunk' END AS kind FROM state"))
def flt22(spark, sf):
    c = F.col("chunk_id")
    return views.index_state(spark, sf).select("chunk_id", F.when(c.isNull(), "paper").when(c.startswith("gone:"), "site").otherwise("chunk").alias("kind"))


@query("flt23_tool_offer", "SELECT t AS tool, t <> 'search_site' AS offered FROM (SELECT unnest(['search_papers', 'search_site', 'find_papers']) AS t)")
def flt23(spark, sf):
    have = {"search_papers", "find_papers"}
    return spark.createDataFrame([(t, t in have) for t in answers.TOOLS], "tool string, offered boolean")


@query("flt24_pdf_sniff", "SELECT doc_id, doc_id % 3 = 0 AS is_pdf FROM documents")
def flt24(spark, sf):
    content = F.concat(F.when(F.col("doc_id") % 3 == 0, F.lit("\n%PDF-1.7")).otherwise(F.lit("x" * 1024 + "%PDF-")), "text")
    return table(spark, sf, "documents").select("doc_id", (F.instr(F.substring(content, 1, 1024), "%PDF-") > 0).alias("is_pdf"))


_label = f"CASE WHEN starts_with(value, 'http') THEN {label_sql('value')} ELSE {openalex_sql('value')} END"
OPTIONS = views.EVIDENCE + f""", options AS (SELECT doc_id, value, {_label} AS label, CASE source WHEN 'crossref' THEN 0 WHEN 'datacite' THEN 1 ELSE 2 END AS source_rank FROM evidence
 WHERE (source = 'crossref' AND applies_to IN ('vor', 'unspecified') AND valid_from <= '{TODAY}') OR (source = 'datacite' AND NOT starts_with(value, 'info:eu-repo')) OR source = 'openalex')"""


@query("flt25_licence_options", f"WITH {OPTIONS} SELECT doc_id, label, source_rank FROM options")
def flt25(spark, sf):
    return records.licence_options(views.evidence(spark, sf), TODAY).select("doc_id", "label", "source_rank")


@query("set06_option_union", f"WITH {OPTIONS} SELECT doc_id, count(*) AS n, string_agg(label, '|' ORDER BY source_rank, value) AS labels FROM options GROUP BY doc_id")
def set06(spark, sf):
    o = records.licence_options(views.evidence(spark, sf), TODAY).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("source_rank", "value", "label"))).alias("o"))
    return o.select("doc_id", "n", F.array_join(F.transform("o", lambda x: x["label"]), "|").alias("labels"))


PUBLISHED = OPTIONS + f", published AS (SELECT doc_id, arg_min(label, struct_pack(a := {rank_sql('label')}, b := source_rank, c := value)) AS published FROM options GROUP BY doc_id)"


@query("top08_most_open", f"WITH {PUBLISHED} SELECT doc_id, published, {class_sql('published')} AS published_class FROM published")
def top08(spark, sf):
    return records.published_licence(records.licence_options(views.evidence(spark, sf), TODAY))


@query("inc07_licence_summary", f"WITH {PUBLISHED} SELECT d.doc_id, coalesce(published, CASE WHEN d.doc_id % 4 = 0 THEN 'free to read, no licence' ELSE 'none found' END) AS published, {class_sql('coalesce(published, chr(45))')} AS class, CASE d.doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN coalesce((SELECT {label_sql('value')} FROM evidence e WHERE e.doc_id = d.doc_id AND source = 'arxiv'), 'none recorded at arXiv') WHEN 2 THEN 'author''s copy' ELSE published END AS copy_licence FROM documents d LEFT JOIN published p ON p.doc_id = d.doc_id")
def inc07(spark, sf):
    ev = views.evidence(spark, sf)
    pub = records.published_licence(records.licence_options(ev, TODAY))
    pre = ev.filter("source = 'arxiv'").select("doc_id", L.label_from_url(F.col("value")).alias("preprint"))
    d = table(spark, sf, "documents").select("doc_id").join(pub, "doc_id", "left").join(pre, "doc_id", "left")
    copy = F.when(F.col("doc_id") % 4 == 1, F.coalesce("preprint", F.lit("none recorded at arXiv"))).when(F.col("doc_id") % 4 == 2, F.lit("author's copy")).when(F.col("doc_id") % 4 == 3, F.col("published"))
    shown = F.coalesce("published", F.when(F.col("doc_id") % 4 == 0, F.lit(L.FREE_TO_READ)).otherwise(F.lit(L.NONE_FOUND)))
    return d.select("doc_id", shown.alias("published"), L.licence_class(F.coalesce("published", F.lit("-"))).alias("class"), copy.alias("copy_licence"))


# joins ---------------------------------------------------------------------------------------------------------------


@query("jn01_list_metadata", with_papers("SELECT 'doc:' || lpad(doc_id::VARCHAR, 8, '0') AS bib, CASE WHEN doc_id % 4 = 1 THEN 'identifier' WHEN doc_id % 4 = 2 THEN 'list only' ELSE 'exact' END AS found FROM documents"))
def jn01(spark, sf):
    p = views.papers(spark, sf)
    feed = p.selectExpr("bib AS feed_bib", "CASE WHEN doc_id % 4 = 1 THEN concat('was:', bib) WHEN doc_id % 4 = 2 THEN concat('x:', bib) ELSE bib END AS name")
    ident = p.select(F.concat(F.lit("was:"), "bib").alias("name"), F.col("bib").alias("by_identifier"))
    out = feed.join(p.select(F.col("bib").alias("name"), F.col("bib").alias("exact")), "name", "left").join(ident, "name", "left")
    return out.select(F.col("feed_bib").alias("bib"), F.when(F.col("exact").isNotNull(), "exact").when(F.col("by_identifier").isNotNull(), "identifier").otherwise("list only").alias("found"))


@query("jn02_alias_resolution", with_state("SELECT chunk_id, coalesce(a.bib, s.parent_doc) AS bib FROM state s LEFT JOIN aliases a ON a.alias = s.parent_doc"))
def jn02(spark, sf):
    return records.resolve(views.index_state(spark, sf), records.alias_map(views.papers(spark, sf)), "parent_doc").select("chunk_id", "bib")


#: Lists of earlier years: a paper of number n was renamed n % 5 times, and each list knows two neighbouring names only.
_chain = "chain AS (SELECT bib, doc_id, k, CASE WHEN k = 0 THEN bib ELSE 'name' || k || ':' || doc_id END AS new_name, 'name' || (k + 1) || ':' || doc_id AS old_name FROM papers, range(0, 5) t(k) WHERE k < doc_id % 5)"


def rename_lists(spark, sf):
    """The current list, and one for each earlier year: bib and aliases."""
    p = views.papers(spark, sf)
    name = lambda k: F.concat(F.lit(f"name{k}:"), F.col("doc_id").cast("string")) if k else F.col("bib")
    earlier = [p.filter(F.col("doc_id") % 5 > k).select(name(k).alias("bib"), F.array(name(k + 1)).alias("aliases")) for k in range(4)]
    return p.select("bib", F.array("bib").alias("aliases"), "doc_id"), earlier


@query("jn02_rename_chains", f"WITH RECURSIVE {views.PAPERS}, {_chain}, reach AS (SELECT bib AS alias, bib FROM papers UNION SELECT c.old_name, r.bib FROM reach r JOIN chain c ON c.new_name = r.alias) SELECT alias, bib FROM reach")
def jn02_chains(spark, sf):
    """Every name that a paper ever had, over chains of renames in several lists."""
    now, earlier = rename_lists(spark, sf)
    return transitive_aliases(now.drop("doc_id"), *earlier).select("alias", "bib")


@query("inc04_rename_chains", f"WITH RECURSIVE {views.PAPERS}, {_chain}, reach AS (SELECT bib AS alias, bib FROM papers WHERE doc_id % 10 <> 2 UNION SELECT c.old_name, r.bib FROM reach r JOIN chain c ON c.new_name = r.alias), manifest AS (SELECT CASE WHEN doc_id % 5 = 0 THEN bib ELSE 'name' || (doc_id % 5) || ':' || doc_id END AS name FROM papers WHERE doc_id % 10 <> 1), m AS (SELECT name, bib FROM manifest LEFT JOIN reach ON alias = name), changes AS (SELECT CASE WHEN bib IS NULL THEN 'removed' WHEN bib <> name THEN 'renamed' ELSE 'same' END AS change FROM m UNION ALL SELECT 'new' FROM papers p WHERE doc_id % 10 <> 2 AND NOT EXISTS (SELECT 1 FROM m WHERE m.bib = p.bib)) SELECT change, count(*) AS n FROM changes GROUP BY change")
def inc04_chains(spark, sf):
    """A manifest that still has every paper's oldest name, against the current list."""
    now, earlier = rename_lists(spark, sf)
    listed = now.filter("doc_id % 10 <> 2")
    names = transitive_aliases(listed.drop("doc_id"), *earlier)
    oldest = F.when(F.col("doc_id") % 5 == 0, F.col("bib")).otherwise(F.concat(F.lit("name"), (F.col("doc_id") % 5).cast("string"), F.lit(":"), F.col("doc_id").cast("string")))
    manifest = now.filter("doc_id % 10 <> 1").select(oldest.alias("name"))
    # a name that leads to no listed paper keeps the root of its own component, which is none
    own = manifest.join(names.withColumnRenamed("alias", "name"), "name", "left")
    change = F.when(F.col("bib").isNull(), "removed").when(F.col("bib") != F.col("name"), "renamed").otherwise("same")
    fresh = listed.select("bib").join(own.select("bib"), "bib", "left_anti").select(F.lit("new").alias("change"))
    return own.select(change.alias("change")).unionAll(fresh).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("jn03_paper_markdown", with_papers("SELECT bib, CASE WHEN doc_id % 3 = 0 THEN 'abstract only' ELSE 'full text' END AS coverage FROM papers"))
def jn03(spark, sf):
    p = views.papers(spark, sf)
    md = p.filter("doc_id % 3 <> 0").select("bib", F.sha2("markdown", 256).alias("sha"))
    return p.select("bib").join(md, "bib", "left").select("bib", F.when(F.col("sha").isNull(), "abstract only").otherwise("full text").alias("coverage"))


@query("jn04_objects_by_alias", with_state("SELECT p.bib, count(s.chunk_id) AS objects FROM papers p LEFT JOIN aliases a ON a.bib = p.bib LEFT JOIN state s ON s.parent_doc = a.alias GROUP BY p.bib"))
def jn04(spark, sf):
    a = records.alias_map(views.papers(spark, sf))
    s = views.index_state(spark, sf).select(F.col("parent_doc").alias("alias"), "chunk_id")
    return a.join(s, "alias", "left").groupBy("bib").agg(F.count("chunk_id").alias("objects"))


@query("jn05_coverage_by_priority", with_state("SELECT p.bib, arg_min(coalesce(s.coverage, 'full text'), pos) AS coverage FROM (SELECT bib, unnest(aliases) AS alias, unnest(range(0, len(aliases))) AS pos FROM papers) p JOIN state s ON s.parent_doc = p.alias GROUP BY p.bib"))
def jn05(spark, sf):
    a = views.papers(spark, sf).select("bib", F.posexplode("aliases").alias("pos", "parent_doc"))
    return a.join(views.index_state(spark, sf), "parent_doc").groupBy("bib").agg(F.min_by(F.coalesce("coverage", F.lit("full text")), "pos").alias("coverage"))


@query("jn06_missing_papers", with_state("SELECT bib FROM papers p WHERE NOT EXISTS (SELECT 1 FROM aliases a JOIN state s ON s.parent_doc = a.alias WHERE a.bib = p.bib)"))
def jn06(spark, sf):
    p = views.papers(spark, sf)
    found = records.resolve(views.index_state(spark, sf), records.alias_map(p), "parent_doc", keep_unknown=False).filter("bib IS NOT NULL")
    return p.select("bib").join(found.select("bib"), "bib", "left_anti")


@query("jn07_stale_objects", with_state("SELECT chunk_id FROM state WHERE chunk_id NOT IN (SELECT bib || '#0001' FROM papers WHERE doc_id % 6 <> 0)"))
def jn07(spark, sf):
    wanted = views.papers(spark, sf).filter("doc_id % 6 <> 0").select(F.concat("bib", F.lit("#0001")).alias("chunk_id"))
    return views.index_state(spark, sf).select("chunk_id").join(wanted, "chunk_id", "left_anti")


@query("jn08_orphans", with_state("SELECT parent_doc, count(*) AS objects FROM state WHERE parent_doc NOT IN (SELECT alias FROM aliases) GROUP BY parent_doc"))
def jn08(spark, sf):
    return records.orphans(views.index_state(spark, sf), records.alias_map(views.papers(spark, sf)))


@query("jn09_stale_pages", "SELECT page_id FROM pages WHERE page_id % 5 = 0 AND page_id % 10 <> 0")
def jn09(spark, sf):
    p = table(spark, sf, "pages").select("page_id")
    live = p.filter("page_id % 5 <> 0").unionAll(p.filter("page_id % 10 = 0"))
    return p.join(live, "page_id", "left_anti")


_diff = with_state("SELECT w.bib, CASE WHEN o.n IS NULL THEN 'new' WHEN o.lo = o.hi AND o.lo = w.fp THEN 'keep' ELSE 'write' END AS action FROM (SELECT bib, substr(sha256(markdown), 1, 20) AS fp FROM papers) w LEFT JOIN (SELECT a.bib, min(fingerprint) AS lo, max(fingerprint) AS hi, count(*) AS n FROM state s JOIN aliases a ON a.alias = s.parent_doc GROUP BY a.bib) o ON o.bib = w.bib")


@query("jn10_changed_rows", _diff)
def jn10(spark, sf):
    p = views.papers(spark, sf)
    wanted = p.select("bib", F.substring(F.sha2("markdown", 256), 1, 20).alias("fingerprint"))
    return records.fingerprint_diff(wanted, views.index_state(spark, sf), records.alias_map(p))


@query("inc01_chunk_sync", _diff.replace("SELECT w.bib,", "SELECT action, count(*) AS n FROM (SELECT w.bib,") + ") GROUP BY action UNION ALL SELECT 'delete', count(DISTINCT parent_doc) FROM state WHERE parent_doc NOT IN (SELECT alias FROM aliases)")
def inc01(spark, sf):
    p, s = views.papers(spark, sf), views.index_state(spark, sf)
    gone = records.orphans(s, records.alias_map(p))
    return jn10(spark, sf).groupBy("action").agg(F.count(F.lit(1)).alias("n")).unionAll(gone.agg(F.lit("delete").alias("action"), F.count(F.lit(1)).alias("n")))


@query("jn11_doi_fan_out", with_papers("SELECT bib, count(*) AS dois, string_agg(CASE WHEN doc_id % 2 = 0 THEN 'hit' ELSE 'error' END, ',') AS results FROM (SELECT bib, doc_id, unnest(doi) AS d FROM papers) GROUP BY bib"))
def jn11(spark, sf):
    d = views.papers(spark, sf).select("bib", "doc_id", F.explode("doi").alias("doi"))
    hits = d.filter("doc_id % 2 = 0").select("doi", F.lit("hit").alias("hit"))
    return d.join(hits, "doi", "left").groupBy("bib").agg(F.count(F.lit(1)).alias("dois"), F.array_join(F.collect_list(F.coalesce("hit", F.lit("error"))), ",").alias("results"))


@query("jn12_preprints", with_papers(f"SELECT bib, {_arxiv} AS arxiv_id FROM papers WHERE {_arxiv} IS NOT NULL"))
def jn12(spark, sf):
    return views.papers(spark, sf).select("bib", arxiv().alias("arxiv_id")).filter("arxiv_id IS NOT NULL")


@query("jn13_list_diff", with_papers("SELECT bib, CASE WHEN doc_id % 10 = 1 THEN 'gone' ELSE 'added' END AS change FROM papers WHERE doc_id % 10 IN (1, 2)"))
def jn13(spark, sf):
    p = views.papers(spark, sf).select("doc_id", "bib", "aliases")
    old, new = p.filter("doc_id % 10 <> 2"), p.filter("doc_id % 10 <> 1")

    def missing(a, b, name):
        hit = records.alias_map(a).join(records.alias_map(b).select("alias"), "alias", "left_semi").select("bib")
        return a.select("bib").join(hit, "bib", "left_anti").withColumn("change", F.lit(name))

    return missing(old, new, "gone").unionAll(missing(new, old, "added"))


@query("jn14_run_to_run", f"WITH {views.RUNS}, a AS (SELECT question, sum(passed::INT) AS n FROM runs WHERE config LIKE 'm0%' GROUP BY question), b AS (SELECT question, sum(passed::INT) AS n FROM runs WHERE config LIKE 'm1%' GROUP BY question) SELECT a.question, a.n::BIGINT AS before, b.n::BIGINT AS after FROM a JOIN b ON replace(a.question, 'q', '')::INT + 1 = replace(b.question, 'q', '')::INT WHERE a.n <> b.n")
def jn14(spark, sf):
    r = views.runs(spark, sf).groupBy("config", "question").agg(F.count_if("passed").alias("n")).withColumn("i", F.substring("question", 2, 10).cast("int"))
    a = r.filter("config LIKE 'm0%'").select("question", "i", F.col("n").alias("before"))
    b = r.filter("config LIKE 'm1%'").select((F.col("i") - 1).alias("i"), F.col("n").alias("after"))
    return a.join(b, "i").filter(~F.col("before").eqNullSafe(F.col("after"))).select("question", "before", "after")


@query("jn15_given_docs", "SELECT doc_id FROM documents WHERE doc_id % 3 = 0 AND doc_id % 5 <> 0")
def jn15(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("doc_key"))
    return search.fresh_only(d.filter("doc_key % 3 = 0"), d.filter("doc_key % 5 = 0")).select(F.col("doc_key").alias("doc_id"))


@query("jn17_content_dedupe", "SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS canonical FROM documents")
def jn17(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    # a partially aggregated join instead of a window: a hash that is very common never lies in one task
    return d.join(d.groupBy("h").agg(F.min("doc_id").alias("canonical")), "h").select("doc_id", "canonical")


# aggregates ----------------------------------------------------------------------------------------------------------


@query("agg01_filtered_count", with_papers("SELECT count(*) AS total FROM papers WHERE year::INTEGER >= 2010"))
def agg01(spark, sf):
    return views.papers(spark, sf).agg(F.count_if(F.col("year").cast("int") >= 2010).alias("total"))


@query("agg02_furniture_blocks", f"WITH {views.SITE}, b AS (SELECT DISTINCT page_id, unnest(list_concat(links, blocks)) AS block FROM site) SELECT block, count(*) AS pages FROM b GROUP BY block HAVING count(*) > 0.01 * (SELECT count(*) FROM site)")
def agg02(spark, sf):
    s = views.site_pages(spark, sf)
    n = s.agg(F.count(F.lit(1)).alias("total"))
    b = s.select(F.explode(F.array_distinct(F.concat("links", "blocks"))).alias("block")).groupBy("block").agg(F.count(F.lit(1)).alias("pages"))
    return b.join(F.broadcast(n), F.col("pages") > 0.01 * F.col("total")).select("block", "pages")


@query("agg03_group_by_parent", with_state("SELECT parent_doc, string_agg(chunk_id || '=' || fingerprint, ',' ORDER BY chunk_id) AS objects FROM state GROUP BY parent_doc"))
def agg03(spark, sf):
    m = views.index_state(spark, sf).groupBy("parent_doc").agg(F.map_from_entries(F.collect_list(F.struct("chunk_id", "fingerprint"))).alias("m"))
    return m.select("parent_doc", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("objects"))


@query("agg04_coverage_merge", with_state("SELECT a.bib, CASE WHEN bool_or(coalesce(coverage, 'full text') = 'full text') THEN 'full text' ELSE 'abstract only' END AS coverage FROM state s JOIN aliases a ON a.alias = s.parent_doc GROUP BY a.bib"))
def agg04(spark, sf):
    return records.coverage_of(views.index_state(spark, sf), records.alias_map(views.papers(spark, sf)))


@query("agg05_value_counts", "SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def agg05(spark, sf):
    return table(spark, sf, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query("agg06_class_counts", f"WITH {PUBLISHED} SELECT count(*) FILTER ({class_sql('published')} = 'open licence') AS open, count(*) FILTER ({class_sql('published')} = 'with conditions') AS conditions, count(*) FILTER ({class_sql('published')} = 'no licence') AS none FROM published")
def agg06(spark, sf):
    p = top08(spark, sf)
    return p.agg(*[F.count_if(F.col("published_class") == c).alias(n) for c, n in zip(L.CLASSES, ("open", "conditions", "none"))])


@query("agg07_share_report", f"SELECT source, count(*) AS papers, sum({word_count_sql('text')})::BIGINT AS words, round(100.0 * count(*) / (SELECT count(*) FROM documents), 4)::DOUBLE AS percent FROM documents GROUP BY source")
def agg07(spark, sf):
    d = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("papers"), F.sum(T.word_count(F.col("text"))).alias("words"))
    total = d.agg(F.sum("papers").alias("total"))
    return d.join(F.broadcast(total)).select("source", "papers", "words", F.round(100.0 * F.col("papers").cast("double") / F.col("total"), 4).alias("percent"))


@query("agg08_token_distribution", "SELECT median(t)::DOUBLE AS median, round(avg(t), 6) AS mean, min(t) AS least, max(t) AS most, sum(t)::BIGINT AS total, count(*) FILTER (t > 512) AS over_budget, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, floor(length(text) / 2.5)::INTEGER + 1 AS t FROM documents)")
def agg08(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", V.token_estimate(F.col("text")).alias("t"))
    return t.agg(F.median("t").alias("median"), F.round(F.avg("t"), 6).alias("mean"), F.min("t").alias("least"), F.max("t").alias("most"), F.sum("t").alias("total"), F.count_if(F.col("t") > 512).alias("over_budget"), F.countDistinct("doc_id").alias("docs"))


@query("agg09_pass_rate", f"WITH {views.RUNS} SELECT \"check\", count(*) FILTER (passed) || '/' || count(*) AS rate FROM runs GROUP BY \"check\"")
def agg09(spark, sf):
    return views.runs(spark, sf).groupBy("check").agg(F.concat(F.count_if("passed").cast("string"), F.lit("/"), F.count(F.lit(1)).cast("string")).alias("rate"))


@query("agg10_retrieval_summary", f"WITH {views.RUNS} SELECT config, count(*) FILTER (rounds > 0) AS in_pool, count(*) FILTER (rounds > 1) AS in_final, count(*) FILTER (rounds = 3) AS rank_one, array_to_string(list_sort(list(DISTINCT question) FILTER (rounds = 0)), ',') AS missed FROM runs GROUP BY config")
def agg10(spark, sf):
    return views.runs(spark, sf).groupBy("config").agg(F.count_if(F.col("rounds") > 0).alias("in_pool"), F.count_if(F.col("rounds") > 1).alias("in_final"), F.count_if(F.col("rounds") == 3).alias("rank_one"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("rounds") == 0, F.col("question")))), ",").alias("missed"))


@query("agg11_full_run_summary", f"WITH {views.RUNS} SELECT config, list_sort(list(seconds))[count(*) // 2 + 1] AS upper_median, max(seconds) AS slowest, count(*) FILTER (error IS NOT NULL) AS failed FROM runs GROUP BY config")
def agg11(spark, sf):
    # ranks from counts of distinct values, not from rows
    r = views.runs(spark, sf)
    counts = r.groupBy("config", "seconds").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("config").orderBy("seconds").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("k").over(w)).withColumn("n", F.sum("k").over(Window.partitionBy("config")))
    upper = ranked.filter(F.col("upto") >= F.floor(F.col("n") / 2) + 1).groupBy("config").agg(F.min("seconds").alias("upper_median"))
    rest = r.groupBy("config").agg(F.max("seconds").alias("slowest"), F.count("error").alias("failed"))
    return rest.join(upper, "config").select("config", "upper_median", "slowest", "failed")


_even = "(CASE WHEN abs(x - floor(x) - 0.5) < 1e-9 THEN CASE WHEN floor(x)::BIGINT % 2 = 0 THEN floor(x) ELSE floor(x) + 1 END ELSE round(x) END)::BIGINT"


@query("agg12_median_p90", f"WITH {views.RUNS}, g AS (SELECT config, list_sort(list(seconds)) AS s, median(seconds) AS m, 0.9 * (count(*) - 1) AS x FROM runs GROUP BY config) SELECT config, round(m, 6)::DOUBLE AS median, s[{_even} + 1] AS p90 FROM g")
def agg12(spark, sf):
    r = views.runs(spark, sf)
    counts = r.groupBy("config", "seconds").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("config").orderBy("seconds").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("k").over(w)).withColumn("n", F.sum("k").over(Window.partitionBy("config")))
    p90 = ranked.filter(F.col("upto") > F.bround(F.lit(0.9) * (F.col("n") - 1), 0)).groupBy("config").agg(F.min("seconds").alias("p90"))
    return r.groupBy("config").agg(F.round(F.median("seconds"), 6).alias("median")).join(p90, "config").select("config", "median", "p90")


@query("agg13_config_summary", f"WITH {views.RUNS} SELECT config, count(*) AS rows, count(*) FILTER (passed) AS passed, round(avg(rounds), 6) AS mean_rounds, max(rounds) AS most_rounds, count(error) AS errors, count(DISTINCT question) AS questions FROM runs GROUP BY config")
def agg13(spark, sf):
    return views.runs(spark, sf).groupBy("config").agg(F.count(F.lit(1)).alias("rows"), F.count_if("passed").alias("passed"), F.round(F.avg("rounds"), 6).alias("mean_rounds"), F.max("rounds").alias("most_rounds"), F.count("error").alias("errors"), F.countDistinct("question").alias("questions"))


@query("agg14_question_contrast", f"WITH {views.RUNS}, r AS (SELECT question, \"check\", count(*) FILTER (passed AND event_id % 2 = 0) AS p0, count(*) FILTER (event_id % 2 = 0) AS n0, count(*) FILTER (passed AND event_id % 2 = 1) AS p1, count(*) FILTER (event_id % 2 = 1) AS n1 FROM runs GROUP BY question, \"check\") SELECT question, \"check\", round(p0 / n0, 6)::DOUBLE AS even, round(p1 / n1, 6)::DOUBLE AS odd FROM r WHERE n0 > 0 AND n1 > 0 AND p0 * n1 <> p1 * n0")
def agg14(spark, sf):
    r = views.runs(spark, sf).withColumn("half", F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd"))
    p = r.groupBy("question", "check").pivot("half", ["even", "odd"]).agg(F.count_if("passed").alias("p"), F.count(F.lit(1)).alias("n"))
    both = (F.col("even_n") > 0) & (F.col("odd_n") > 0) & (F.col("even_p") * F.col("odd_n") != F.col("odd_p") * F.col("even_n"))
    return p.filter(both).select("question", "check", F.round(F.col("even_p") / F.col("even_n"), 6).alias("even"), F.round(F.col("odd_p") / F.col("odd_n"), 6).alias("odd"))


@query("agg15_runs_by_config", "SELECT 'm' || (user_id % 2) || ' -> ' || event_type || ' on c' AS config, count(*) AS n FROM events GROUP BY 1")
def agg15(spark, sf):
    c = F.concat(F.lit("m"), (F.col("user_id") % 2).cast("string"), F.lit(" -> "), "event_type", F.lit(" on c"))
    return table(spark, sf, "events").groupBy(c.alias("config")).agg(F.count(F.lit(1)).alias("n"))


@query("agg16_timing_sums", "SELECT user_id, event_type AS part, round(sum(value), 2)::DOUBLE AS seconds FROM events GROUP BY ALL")
def agg16(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("part")).agg(F.round(F.sum(F.col("value").cast("decimal(18,4)")), 2).cast("double").alias("seconds"))


@query("agg17_distinct_keys", with_papers("SELECT bib, array_to_string(list_sort(list_distinct(list_transform(author, lambda a: regexp_replace(lower(string_split(a, ',')[1]), '^van der ', '')))), '|') AS keys FROM papers"))
def agg17(spark, sf):
    own = F.transform("author", lambda a: F.regexp_replace(T.author_key(a), "^van der ", ""))
    return views.papers(spark, sf).select("bib", F.array_join(F.array_sort(F.array_distinct(own)), "|").alias("keys"))


# windows -------------------------------------------------------------------------------------------------------------


@query("win01_chunk_numbers", "SELECT doc_id, i::INTEGER AS chunk_index, len(l)::INTEGER AS n_parts FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))")
def win01(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.split("text", "\n", -1).alias("l"))
    return d.select("doc_id", F.size("l").alias("n_parts"), F.posexplode("l").alias("p", "x")).select("doc_id", (F.col("p") + 1).alias("chunk_index"), "n_parts")


@query("win02_passage_numbers", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) + 7 AS passage FROM conversations")
def win02(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", (F.row_number().over(w) + 7).cast("long").alias("passage"))


@query("win04_first_rank", f"WITH {views.GOLDEN} SELECT item_id, list_position(expected, expected[-1])::BIGINT AS rank FROM golden")
def win04(spark, sf):
    g = views.golden(spark, sf).withColumn("want", F.slice("expected", -1, 1))
    ranks = F.transform("want", lambda x: F.nullif(F.array_position("expected", x), F.lit(0)))
    return g.select("item_id", F.array_min(ranks).alias("rank"))


@query("win05_history_window", "SELECT conv_id, turn, coalesce(string_agg(role || ': ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), '') AS history FROM conversations")
def win05(spark, sf):
    return answers.history_window(table(spark, sf, "conversations"))


@query("win06_ordered_distinct", "SELECT conv_id, array_to_string(list_filter(r, lambda x, i: list_position(r, x) = i), ',') AS roles FROM (SELECT conv_id, list(role ORDER BY turn) AS r FROM conversations GROUP BY conv_id)")
def win06(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return c.select("conv_id", F.array_join(F.array_distinct(F.transform("r", lambda x: x["role"])), ",").alias("roles"))


@query("win08_mark_run", f"WITH {views.REPLIES}, m AS (SELECT conv_id, turn, list_transform(regexp_extract_all(reply, '\\[([0-9]+)\\]', 1), lambda x: x::INTEGER) AS m FROM replies) SELECT conv_id, turn, (list_min(list_filter(range(1, len(m) + 2), lambda i: NOT list_contains(m, i))) - 1)::INTEGER AS run FROM m")
def win08(spark, sf):
    m = F.transform(F.regexp_extract_all("reply", F.lit(r"\[([0-9]+)\]"), F.lit(1)), lambda x: x.cast("int"))
    r = views.replies(spark, sf).select("conv_id", "turn", m.alias("m"))
    return r.select("conv_id", "turn", (F.array_min(F.array_except(F.sequence(F.lit(1), F.size("m") + 1), "m")) - 1).alias("run"))


@query("win09_batches", "SELECT doc_id, ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 20)::BIGINT AS batch FROM documents")
def win09(spark, sf):
    rows = ranks.numbered(table(spark, sf, "documents").select("doc_id", "source"), ["source"], ["doc_id"])
    return rows.select("doc_id", F.floor((F.col("number") - 1) / 20).alias("batch"))


# top-k and sets ------------------------------------------------------------------------------------------------------


@query("top05_newest", with_papers("SELECT bib, date FROM papers ORDER BY date DESC NULLS LAST, bib LIMIT 25"))
def top05(spark, sf):
    return views.papers(spark, sf).select("bib", "date").orderBy(F.col("date").desc_nulls_last(), "bib").limit(25)


_limit = "CASE event_id % 6 WHEN 0 THEN '0' WHEN 1 THEN '-3' WHEN 2 THEN 'ten' WHEN 3 THEN '99' WHEN 4 THEN NULL ELSE '7' END"


@query("top06_limit_clamp", "SELECT event_id, [10, 1, 10, 25, 10, 7][(event_id % 6 + 1)::INTEGER] AS k FROM events")
def top06(spark, sf):
    return table(spark, sf, "events").selectExpr("event_id", f"{_limit} AS v").select("event_id", V.clamp_limit(F.col("v")).alias("k"))


@query("top07_length_batches", "SELECT doc_id, length(text)::BIGINT AS n, ((row_number() OVER (ORDER BY length(text), doc_id) - 1) // 4)::BIGINT AS batch, row_number() OVER (ORDER BY doc_id) AS place FROM documents")
def top07(spark, sf):
    """Batches of texts of like length for a scorer that pads, and the rows' places in the input's order, in which they come back."""
    rows = ranks.length_batches(table(spark, sf, "documents").select("doc_id", "text"), "text", ["doc_id"], 4)
    return rows.select("doc_id", F.length("text").cast("long").alias("n"), "batch", "place").orderBy("place")


@query("top09_deterministic_order", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY lang, doc_id) AS place FROM documents")
def top09(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source", "lang")
    return ranks.numbered(rows, ["source"], ["lang", "doc_id"], "place").select("doc_id", "place")


@query("agg01_facet_totals", with_papers("SELECT 'nation ' || k AS author, count(*) AS total FROM papers, range(0, 25) t(k) WHERE len(list_filter(author, lambda a: ends_with(lower(string_split(a, ',')[1]), 'nation ' || k))) > 0 AND year::INTEGER BETWEEN 2003 AND 2015 GROUP BY k"))
def agg01_facets(spark, sf):
    """How many papers of 2003 to 2015 every surname has, from bitmaps."""
    papers = written(paper_index(spark, sf), "paper_index")
    bits = written(facet_bitmaps(papers), "facets")
    asked = bits.filter("facet = 'author' AND value RLIKE '^nation [0-9]+$'").select(F.col("value").alias("ask")).distinct()
    asked = asked.select("ask", F.col("ask").alias("author"), F.lit(False).alias("first_author_only"), F.lit(2003).alias("year_from"), F.lit(2015).alias("year_to"))
    return facet_totals(bits, asked).select(F.col("ask").alias("author"), "total")


@query("top10_first_evidence", with_papers("SELECT bib, array_to_string(author[1:6], '; ') AS authors, array_to_string(string_split(markdown, chr(10) || chr(10))[1:3], ' / ') AS opening FROM papers"))
def top10(spark, sf):
    return views.papers(spark, sf).select("bib", F.array_join(F.slice("author", 1, 6), "; ").alias("authors"), F.array_join(F.slice(F.split("markdown", "\n\n"), 1, 3), " / ").alias("opening"))


@query("set02_id_difference", with_state("SELECT parent_doc FROM (SELECT DISTINCT parent_doc FROM state EXCEPT SELECT bib FROM papers)"))
def set02(spark, sf):
    return views.index_state(spark, sf).select("parent_doc").distinct().subtract(views.papers(spark, sf).select(F.col("bib").alias("parent_doc")))


@query("set03_intersection_size", with_papers(f"SELECT bib, len(list_intersect({words_sql('title')}, {words_sql('text')}))::BIGINT AS n FROM papers"))
def set03(spark, sf):
    return views.papers(spark, sf).select("bib", F.size(F.array_intersect(T.words(F.col("title")), T.words(F.col("text")))).cast("long").alias("n"))


@query("set04_alias_union", with_papers("SELECT bib, array_to_string(list_sort(list_distinct(list_concat(aliases, list_filter(identifier, lambda x: regexp_matches(x, '^(doc|old):'))))), ',') AS aliases FROM papers"))
def set04(spark, sf):
    own = F.filter("identifier", lambda x: x.rlike("^(doc|old):"))
    return views.papers(spark, sf).select("bib", F.array_join(F.array_sort(F.array_union("aliases", own)), ",").alias("aliases"))


@query("set05_pattern_union", f"WITH {views.REPLIES} SELECT conv_id, turn, array_to_string(list_concat(list_filter(['the', 'la', 'ch'], lambda p: NOT regexp_matches(reply, p)), list_transform(list_filter(['er', 'zz'], lambda p: regexp_matches(reply, p)), lambda p: 'NOT ' || p)), ',') AS failed FROM replies")
def set05(spark, sf):
    must, must_not = F.array(*map(F.lit, ("the", "la", "ch"))), F.array(*map(F.lit, ("er", "zz")))
    failed = F.concat(F.filter(must, lambda p: ~F.regexp_like("reply", p)), F.transform(F.filter(must_not, lambda p: F.regexp_like("reply", p)), lambda p: F.concat(F.lit("NOT "), p)))
    return views.replies(spark, sf).select("conv_id", "turn", F.array_join(failed, ",").alias("failed"))
