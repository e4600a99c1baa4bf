"""Queries of sources, sinks and incremental maintenance, with their SQL."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import records
from quillstone.operators.spans import span_tree
from quillstone.plans import relational, views
from quillstone.plans.registry import query, table
from quillstone.plans.relational import TODAY, _remain, _sources, _tried, with_state
from quillstone.plans.scalar import with_papers
from quillstone.session import shared_folder, written
from quillstone.sources import files, site
from quillstone.sources.listing import Listing, land_pages
from quillstone.sources.ranges import RangeTable
from quillstone.streaming import attempts, sync

# sources -------------------------------------------------------------------------------------------------------------


@query("src01_list_scan", "SELECT doc_id FROM documents")
def src01(spark, sf):
    """Listing pages as JSON; a page that says it is longer than what it holds stops the scan."""
    d = table(spark, sf, "documents")
    pages = d.groupBy(F.floor(F.col("doc_id") / 500).alias("page")).agg(F.to_json(F.struct(F.count(F.lit(1)).alias("total"), F.collect_list(F.struct("doc_id")).alias("results"))).alias("body"))
    p = pages.select(F.from_json("body", "total long, results array<struct<doc_id: long>>").alias("p"))
    whole = F.when(F.col("p.total") > F.size("p.results"), F.raise_error(F.lit("the listing is cut")).cast("long")).otherwise(F.col("p.total"))
    return p.select(whole.alias("total"), F.explode("p.results").alias("r")).filter("total > 0").select("r.doc_id")


LISTED = "doc_id long, lang string, source string"


def _land(spark, sf, folder):
    """The documents' ids as pages of a listing service."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", F.floor(F.col("doc_id") / 500).alias("page"))
    land_pages(d, folder, "doc_id", "page", d.count())


def _listing(spark):
    spark.dataSource.register(Listing)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("listing").schema(LISTED).option("key", "doc_id")


@query("src01_listing_source", "SELECT doc_id, lang, source FROM documents")
def src01_source(spark, sf):
    """The whole listing through the data source, a page a task."""
    folder = shared_folder(spark, "listing")
    _land(spark, sf, folder)
    return _listing(spark).load(folder)


@query("src02_listing_keys", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT (SELECT max(doc_id) FROM documents) * k // 10 FROM range(0, 11) t(k))")
def src02_keys(spark, sf):
    """Eleven keys, looked up in their pages alone."""
    folder = shared_folder(spark, "listing")
    _land(spark, sf, folder)
    most = table(spark, sf, "documents").agg(F.max("doc_id")).first()[0]
    return _listing(spark).load(folder).filter(F.col("doc_id").isin([most * k // 10 for k in range(11)])).select("doc_id", "lang")


@query("src01_listing_stream", "SELECT doc_id, CASE WHEN doc_id // 500 <= (SELECT max(doc_id) // 1000 FROM documents) THEN 1 ELSE 2 END AS run FROM documents")
def src01_stream(spark, sf):
    """The listing as a stream in two runs: the second, from the first one's checkpoint, takes only the pages that landed since."""
    folder, checkpoint, out = (shared_folder(spark, n) for n in ("listing", "checkpoint", "listed"))
    _listing(spark)
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", F.floor(F.col("doc_id") / 500).alias("page"))
    middle = d.agg(F.max("doc_id")).first()[0] // 1000
    for run, own in ((1, d.filter(F.col("page") <= middle)), (2, d.filter(F.col("page") > middle))):
        land_pages(own, folder, "doc_id", "page", own.count())
        pages = spark.readStream.format("listing").schema(LISTED).option("key", "doc_id").load(folder)
        pages.select("doc_id", F.lit(run).alias("run")).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("doc_id long, run int").parquet(out)


@query("src02_batched_lookup", with_papers("SELECT bib, doc_id // 2000 AS batch, title FROM papers WHERE doc_id % 3 <> 0"))
def src02(spark, sf):
    p = views.papers(spark, sf)
    return p.filter("doc_id % 3 <> 0").selectExpr("bib", "doc_id div 2000 AS batch").join(p.select("bib", "title"), "bib")


@query("src03_fallback_lookup", with_papers("SELECT 'was:' || bib AS name, bib FROM papers WHERE doc_id % 4 = 1"))
def src03(spark, sf):
    p = views.papers(spark, sf)
    asked = p.select(F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("was:"), "bib")).otherwise(F.col("bib")).alias("name"))
    left = asked.join(p.select(F.col("bib").alias("name")), "name", "left_anti")
    ident = p.select(F.explode(F.concat("identifier", F.array(F.concat(F.lit("was:"), "bib")))).alias("name"), "bib")
    return left.join(ident, "name").select("name", "bib")


@query("src04_xml_licence", f"WITH {views.EVIDENCE} SELECT doc_id, value AS licence FROM evidence WHERE source = 'arxiv'")
def src04(spark, sf):
    xml = F.concat(F.lit('<oai:record xmlns:oai="http://o" xmlns="http://a"><oai:metadata><license> '), "value", F.lit(" </license></oai:metadata></oai:record>"))
    return views.evidence(spark, sf).filter("source = 'arxiv'").select("doc_id", xml.alias("xml")).select("doc_id", files.xml_licence("xml").alias("licence"))


@query("src05_crossref_batches", f"WITH {views.EVIDENCE} SELECT doc_id // 20 AS batch, count(*) AS licences FROM evidence WHERE source = 'crossref' GROUP BY 1")
def src05(spark, sf):
    return views.evidence(spark, sf).filter("source = 'crossref'").groupBy(F.floor(F.col("doc_id") / 20).alias("batch")).agg(F.count(F.lit(1)).alias("licences"))


@query("src06_datacite_rights", f"WITH {views.EVIDENCE} SELECT doc_id, value FROM evidence WHERE source = 'datacite' AND doc_id NOT IN (SELECT doc_id FROM evidence WHERE source = 'crossref')")
def src06(spark, sf):
    e = views.evidence(spark, sf)
    return e.filter("source = 'datacite'").join(e.filter("source = 'crossref'").select("doc_id"), "doc_id", "left_anti").select("doc_id", "value")


@query("src07_openalex_works", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'gold' ELSE 'bronze' END AS oa_status, 'cc-by,' || lang AS elsewhere FROM documents")
def src07(spark, sf):
    body = F.to_json(F.struct(F.when(F.col("doc_id") % 2 == 0, "gold").otherwise("bronze").alias("oa_status"), F.array("lang", F.lit("cc-by"), F.lit("cc-by")).alias("licences")))
    w = table(spark, sf, "documents").select("doc_id", F.from_json(body, "oa_status string, licences array<string>").alias("w"))
    return w.select("doc_id", "w.oa_status", F.array_join(F.array_sort(F.array_distinct("w.licences")), ",").alias("elsewhere"))


@query("src08_link_resolver", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'r:' || url END AS link FROM pages")
def src08(spark, sf):
    d = F.col("page_id") % 3
    body = F.to_json(F.struct(F.when(d == 0, F.col("url")).alias("link"), F.when(d == 1, F.array(F.struct(F.concat(F.lit("r:"), "url").alias("url")))).alias("records")))
    p = table(spark, sf, "pages").select("page_id", F.from_json(body, "link string, records array<struct<url: string>>").alias("b"))
    return p.select("page_id", F.coalesce("b.link", F.get("b.records", F.lit(0))["url"]).alias("link"))


class _Clock:
    """A clock that sleeping moves on, and nothing else."""

    def __init__(self):
        self.now = 0.0

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.now += seconds


def _polite():
    clock = _Clock()
    return files.Fetcher(lambda url: (200, {}, url.encode()), sleep=clock.sleep, clock=clock)


@query("src09_polite_schedule", "SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, count(*) AS requests, (count(*) - 1)::DOUBLE AS seconds, sum(strlen(url))::BIGINT AS bytes FROM pages GROUP BY 1")
def src09(spark, sf):
    """Every page fetched by the polite client, from a stand-in network that returns the address; a second's pause between requests to a host."""
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    got = files.fetched(table(spark, sf, "pages").select("url", host.alias("host")), _polite)
    return got.groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("requests"), F.sum("seconds").alias("seconds"), F.sum(F.octet_length("content")).alias("bytes"))


_held = f"list_filter({_sources}, lambda s: NOT ((s = 'arxiv-tex' AND doc_id % 3 = 0) OR (s = 'arxiv-pdf' AND doc_id % 4 = 0)))"
_missed = f"list_filter({_sources}, lambda s: (s = 'arxiv-tex' AND doc_id % 3 = 0) OR (s = 'arxiv-pdf' AND doc_id % 4 = 0))"


def _gone(record):
    raise OSError("status 404")


def _getters():
    """Stand-in sources: some bundles are gone, some PDFs are a page that asks who reads it."""
    pdf = lambda r: b"%PDF-1.5"
    return {
        "arxiv-tex": lambda r: _gone(r) if r["doc_id"] % 3 == 0 else gzip.compress(b"\\documentclass{article}"),
        "arxiv-pdf": lambda r: b"<html>Are you a robot?" if r["doc_id"] % 4 == 0 else b"%PDF-1.5",
        "author-pdf": pdf,
        "publisher-pdf": pdf,
    }


@query("src10_fetch_dispatch", with_papers(f"""SELECT bib, source, CASE WHEN source LIKE '%-pdf' THEN 'pdf' WHEN source IS NOT NULL THEN 'tex' END AS kind,
 array_to_string(list_transform(list_filter(missed, lambda s: source IS NULL OR list_position(sources, s) < list_position(sources, source)), lambda s: s || CASE s WHEN 'arxiv-tex' THEN ': status 404' ELSE ': a bot check' END), ',') AS errors
 FROM (SELECT bib, {_sources} AS sources, {_missed} AS missed, {_held}[1] AS source FROM papers)"""))
def src10(spark, sf):
    """Each paper's sources tried in order until one gives its text."""
    got = files.full_texts(_tried(spark, sf).select("bib", "doc_id", "sources"), _getters())
    return got.withColumn("errors", F.array_join("errors", ","))


@query("src11_archive_unpack", "SELECT doc_id, 'main.tex' AS name, sha256(text) AS digest FROM documents")
def src11(spark, sf):
    def packed(frames):
        for f in frames:
            yield pd.DataFrame({"path": f["doc_id"].astype(str), "content": [gzip.compress((t or "").encode(), 1) for t in f["text"]]})

    bundles = table(spark, sf, "documents").select("doc_id", "text").mapInPandas(packed, "path string, content binary")
    return files.unpack_files(bundles).select(F.col("bundle").cast("long").alias("doc_id"), "name", F.sha2("content", 256).alias("digest"))


@query("src12_landing_pdf", "SELECT page_id, 'https://h.example/pdf/' || page_id || '.pdf' AS pdf FROM pages")
def src12(spark, sf):
    tagged = F.concat(F.lit('<meta content="/pdf/'), F.col("page_id").cast("string"), F.lit('.pdf" name="citation_pdf_url">'), "html")
    return table(spark, sf, "pages").select("page_id", files.landing_pdf(tagged, "https://h.example/a/b").alias("pdf"))


@query("src13_metadata_scan", with_papers("SELECT bib, title FROM papers"))
def src13(spark, sf):
    p = views.papers(spark, sf)
    body = p.groupBy(F.floor(F.col("doc_id") / 500).alias("page")).agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("bib", F.struct("title")))).alias("papers"))).alias("body"))
    return body.select(F.explode(F.from_json("body", "papers map<string, struct<title: string>>")["papers"]).alias("bib", "r")).select("bib", "r.title")


def _markdown_files(spark, sf):
    p = views.papers(spark, sf)
    own = p.filter("doc_id % 4 <> 0").select(F.col("bib").alias("name"), "markdown")
    old = p.filter("doc_id % 11 = 0").select(F.col("aliases")[1].alias("name"), "markdown")
    odd = p.filter("doc_id % 100 = 0").select(F.concat(F.lit("zz"), "bib").alias("name"), "markdown")
    return own.unionAll(old).unionAll(odd), records.alias_map(p)


@query("src14_markdown_match", with_papers("SELECT bib, CASE WHEN doc_id % 4 <> 0 THEN bib ELSE aliases[2] END AS name FROM papers WHERE doc_id % 4 <> 0 OR doc_id % 11 = 0"))
def src14(spark, sf):
    return files.match_markdown(*_markdown_files(spark, sf))[0].select("bib", "name")


@query("src15_crawl", "SELECT page_id, floor(log2(page_id + 1))::INTEGER AS depth FROM pages")
def src15(spark, sf):
    """Breadth-first reach over a tree of links between all pages."""
    n = table(spark, sf, "pages")
    links = n.selectExpr("cast((page_id - 1) div 2 AS string) AS src", "cast(page_id AS string) AS dst").filter("dst <> '0'")
    reach = site.crawl_frontier(links, spark.createDataFrame([("0",)], "url string"))
    return reach.select(F.col("url").cast("long").alias("page_id"), "depth")


@query("src16_article_blocks", "SELECT page_id, regexp_extract(html, '(?s)<div class=\"ad\">(.*?)</div>', 1) AS block, 'News ' || page_id || ' (2024-01-' || lpad((1 + page_id % 28)::VARCHAR, 2, '0') || '): https://h.example/n/' || page_id AS news FROM pages")
def src16(spark, sf):
    """Blocks of a class, and the news cards that are put before every page."""
    n, day = F.col("page_id").cast("string"), F.lpad((1 + F.col("page_id") % 28).cast("string"), 2, "0")
    card = F.concat(F.lit('<a title="News '), n, F.lit('" href="https://h.example/n/'), n, F.lit('"><b>News</b> <span class="x inner-date"> 2024-01-'), day, F.lit(" </span></a>"))
    p = site.parse_pages(table(spark, sf, "pages").select("page_id", "url", F.concat(card, "html").alias("html")), "ad")
    said = F.transform("news", lambda c: F.concat(c["title"], F.lit(" ("), c["date"], F.lit("): "), c["link"]))
    return p.select("page_id", F.get("blocks", F.lit(0)).alias("block"), F.array_join(said, "\n").alias("news"))


@query("src17_projected_scan", with_state("SELECT parent_doc, fingerprint FROM state"))
def src17(spark, sf):
    return views.index_state(spark, sf).select("parent_doc", "fingerprint")


@query("src18_manifest_read", with_papers("SELECT 0 AS before, count(*) AS entries, count(*) FILTER (doc_id % 3 = 0) AS failed FROM papers"))
def src18(spark, sf):
    """The manifest, empty where none was written yet, then as it was written."""
    store = files.TableStore(spark, shared_folder(spark, "manifest"))

    def manifest():
        return store.read("manifest") if store.exists("manifest") else spark.createDataFrame([], "bib string, state string")

    before = manifest().count()
    store.write("manifest", views.papers(spark, sf).select("bib", F.when(F.col("doc_id") % 3 == 0, "failed").otherwise("done").alias("state")))
    return manifest().agg(F.lit(before).alias("before"), F.count(F.lit(1)).alias("entries"), F.count_if(F.col("state") == "failed").alias("failed"))


@query("src19_results_read", "SELECT conv_id FROM conversations WHERE turn = 0 AND conv_id % 3 = 0")
def src19(spark, sf):
    c = table(spark, sf, "conversations").filter("turn = 0")
    body = F.to_json(F.struct(F.when(F.col("conv_id") % 3 == 0, "full").otherwise("retrieval").alias("mode"), F.array("conv_id").alias("items")))
    return c.select(F.from_json(body, "mode string, items array<long>").alias("r")).filter("r.mode = 'full'").select(F.explode("r.items").alias("conv_id"))


@query("src20_progress_lines", "SELECT event_id, event_type AS event FROM events WHERE event_id % 3 <> 0")
def src20(spark, sf):
    line = F.when(F.col("event_id") % 3 == 0, F.lit("plain log line")).otherwise(F.to_json(F.struct(F.col("event_type").alias("event"), F.col("event_id").cast("string").alias("id"))))
    e = table(spark, sf, "events").select("event_id", F.from_json(line, "event string, id string").alias("e"))
    return e.filter("e.event IS NOT NULL").select("event_id", "e.event")


@query("src21_manual_files", with_papers("SELECT bib, CASE WHEN doc_id % 2 = 0 THEN bib ELSE aliases[2] END AS file FROM papers WHERE doc_id % 2 = 0 OR doc_id % 11 = 0"))
def src21(spark, sf):
    p = views.papers(spark, sf)
    dropped = p.filter("doc_id % 2 = 0").select(F.col("bib").alias("file")).unionAll(p.filter("doc_id % 11 = 0").select(F.col("aliases")[1].alias("file")))
    named = p.select("bib", F.posexplode("aliases").alias("pos", "file"))
    return named.join(dropped, "file").groupBy("bib").agg(F.min_by("file", "pos").alias("file"))


ABOUT = "# About this service\n\nIt answers questions over a list of papers."


@query("src22_static_document", f"SELECT conv_id, length('{ABOUT}')::INTEGER AS n, sha256('{ABOUT}') AS digest FROM conversations WHERE turn = 0")
def src22(spark, sf):
    """A document read from its file, once, for every conversation."""
    path = shared_folder(spark, "about")
    spark.createDataFrame([(ABOUT,)], "value string").coalesce(1).write.text(path)
    about = F.lit(files.read_document(spark, path))
    return table(spark, sf, "conversations").filter("turn = 0").select("conv_id", F.length(about).alias("n"), F.sha2(about, 256).alias("digest"))


@query("src23_settings", "SELECT 'a' AS key_one, 'b' AS key_two")
def src23(spark, sf):
    return spark.createDataFrame([(files.settings("ONE", {"ONE": "a"}), files.settings("TWO", {}, "X=1\nTWO = 'b'\n"))], "key_one string, key_two string")


@query("src24_main_tex", "SELECT bundle, name FROM (SELECT doc_id // 4 AS bundle, CASE WHEN doc_id % 4 = 0 THEN 'template' ELSE 'd' END || doc_id || '.tex' AS name, row_number() OVER (PARTITION BY doc_id // 4 ORDER BY (doc_id % 8 = 2) DESC, doc_id % 4 = 0, length(text) DESC, doc_id::VARCHAR) AS k FROM documents) WHERE k = 1")
def src24(spark, sf):
    """The main file of bundles of four documents each: one by its title, else no template, else the largest, else the first by name."""
    d = table(spark, sf, "documents")
    n = F.col("doc_id").cast("string")
    name = F.concat(F.when(F.col("doc_id") % 4 == 0, "template").otherwise("d"), n, F.lit(".tex"))
    title = F.when(F.col("doc_id") % 8 == 2, "Spectra of comet dust").otherwise("Notes")
    tex = F.concat(F.lit("\\documentclass{article}\n\\title{"), title, F.lit("}\n\\begin{document}\n"), F.coalesce("text", F.lit("")))
    rows = d.filter("doc_id IS NOT NULL").groupBy(F.expr("doc_id div 4").alias("bundle"), name.alias("name")).agg(F.max(tex).alias("tex"))
    bundles = rows.groupBy("bundle").agg(F.map_from_entries(F.collect_list(F.struct("name", "tex"))).alias("files"))
    return files.main_files(bundles.withColumn("title", F.lit("Measured spectra of comet dust")))


# sinks ---------------------------------------------------------------------------------------------------------------


def _store(spark, sf):
    store = files.TableStore(spark, shared_folder(spark, "store"))
    store.write("t", table(spark, sf, "documents").filter("doc_id % 10 <> 3").select("doc_id", "lang", F.lit("old").alias("mark")))
    return store


@query("snk01_atomic_write", "SELECT doc_id, lang, 'old' AS mark FROM documents WHERE doc_id % 10 <> 3")
def snk01(spark, sf):
    return _store(spark, sf).read("t")


@query("snk02_keyed_upsert", "SELECT doc_id, lang, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE 'old' END AS mark FROM documents WHERE doc_id % 10 <> 3 OR doc_id % 2 = 0")
def snk02(spark, sf):
    s = _store(spark, sf)
    s.upsert("t", table(spark, sf, "documents").filter("doc_id % 2 = 0").select("doc_id", "lang", F.lit("new").alias("mark")), "doc_id")
    return s.read("t")


@query("snk03_keyed_delete", "SELECT doc_id, lang, 'old' AS mark FROM documents WHERE doc_id % 10 <> 3 AND doc_id % 5 <> 0")
def snk03(spark, sf):
    s = _store(spark, sf)
    s.delete("t", table(spark, sf, "documents").filter("doc_id % 5 = 0"), "doc_id")
    return s.read("t")


@query("snk04_replace_group", "SELECT doc_id, lang, 'old' AS mark FROM documents WHERE doc_id % 10 <> 3 AND lang <> 'de' UNION ALL SELECT doc_id, lang, 'new' FROM documents WHERE lang = 'de' AND doc_id % 2 = 0")
def snk04(spark, sf):
    s = _store(spark, sf)
    s.replace_groups("t", table(spark, sf, "documents").filter("lang = 'de' AND doc_id % 2 = 0").select("doc_id", "lang", F.lit("new").alias("mark")), "lang")
    return s.read("t")


@query("snk05_patch", f"SELECT doc_id, lang, CASE WHEN lang = 'en' THEN '{TODAY}' ELSE 'old' END AS mark FROM documents WHERE doc_id % 10 <> 3")
def snk05(spark, sf):
    s = _store(spark, sf)
    s.patch("t", {"mark": F.when(F.col("lang") == "en", F.lit(TODAY)).otherwise(F.col("mark"))})
    return s.read("t")


def _ranges(spark, sf):
    """The documents' rows in about sixteen ranges of ids."""
    rows = table(spark, sf, "documents").select("doc_id", "lang", F.lit("old").alias("mark"))
    return RangeTable(spark, shared_folder(spark, "ranges")).create(rows, "doc_id", max(1, rows.count() // 16))


_first = "doc_id < (SELECT max(doc_id) // 100 FROM documents)"


def _first_ids(spark, sf):
    """The first hundredth of the ids."""
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return d.filter(F.col("doc_id") < d.agg(F.max("doc_id")).first()[0] // 100)


@query("snk02_range_upsert", f"SELECT doc_id, lang, CASE WHEN {_first} THEN 'new' ELSE 'old' END AS mark, 1 AS ranges FROM documents UNION ALL SELECT -1, 'xx', 'new', 1")
def snk02_ranges(spark, sf):
    """A hundredth of the keys and a new one, which lie in one range: the others' files stay."""
    t = _ranges(spark, sf)
    new = _first_ids(spark, sf).unionAll(spark.range(1).selectExpr("-1L", "'xx'")).withColumn("mark", F.lit("new"))
    ranges = t.upsert(new)
    return t.read().withColumn("ranges", F.lit(len(ranges)))


@query("snk03_range_delete", f"SELECT doc_id, lang, 'old' AS mark, 1 AS ranges FROM documents WHERE NOT {_first}")
def snk03_ranges(spark, sf):
    t = _ranges(spark, sf)
    ranges = t.delete(_first_ids(spark, sf))
    return t.read().withColumn("ranges", F.lit(len(ranges)))


@query("snk04_range_groups", "SELECT doc_id, lang, 'old' AS mark FROM documents WHERE lang <> 'de' UNION ALL SELECT doc_id, lang, 'new' FROM documents WHERE lang = 'de' AND doc_id % 2 = 0")
def snk04_ranges(spark, sf):
    t = _ranges(spark, sf)
    t.replace_groups(table(spark, sf, "documents").filter("lang = 'de' AND doc_id % 2 = 0").select("doc_id", "lang", F.lit("new").alias("mark")), "lang")
    return t.read()


@query("snk05_range_patch", f"SELECT doc_id, lang, CASE WHEN {_first} THEN 'old ' || lang ELSE 'old' END AS mark, 1 AS ranges FROM documents")
def snk05_ranges(spark, sf):
    t = _ranges(spark, sf)
    ranges = t.patch(_first_ids(spark, sf), {"mark": F.concat_ws(" ", "mark", "lang")})
    return t.read().withColumn("ranges", F.lit(len(ranges)))


@query("snk06_evolve", "SELECT doc_id, lang, 'old' AS mark, NULL::INTEGER AS year FROM documents WHERE doc_id % 10 <> 3")
def snk06(spark, sf):
    s = _store(spark, sf)
    s.evolve("t", "year int")
    return s.read("t")


@query("snk07_set_aside", "SELECT 'v1' AS version, count(*) AS rows FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'v2', count(*) FROM documents")
def snk07(spark, sf):
    s = files.TableStore(spark, shared_folder(spark, "aside"))
    d = table(spark, sf, "documents").select("doc_id")
    versions = [s.write("md", d.filter("doc_id % 2 = 0")), s.write("md", d)]
    parts = [spark.read.parquet(f"{s.root}/md/{v}").agg(F.lit(f"v{k}").alias("version"), F.count(F.lit(1)).alias("rows")) for k, v in enumerate(versions, 1)]
    return parts[0].unionAll(parts[1])


@query("snk08_eval_report", f"WITH {views.RUNS} SELECT '| ' || \"check\" || ' | ' || count(*) FILTER (passed) || '/' || count(*) || ' |' AS line FROM runs GROUP BY \"check\"")
def snk08(spark, sf):
    r = views.runs(spark, sf).groupBy("check").agg(F.count_if("passed").alias("p"), F.count(F.lit(1)).alias("n"))
    return r.select(F.concat(F.lit("| "), "check", F.lit(" | "), F.col("p").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(" |")).alias("line"))


@query("snk09_markdown_dump", "SELECT lang, count(*) AS files FROM documents GROUP BY lang")
def snk09(spark, sf):
    path = shared_folder(spark, "dump")
    d = table(spark, sf, "documents").select("lang", F.concat(F.lit("<!-- doc "), F.col("doc_id").cast("string"), F.lit(" --> "), F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" "))).alias("value"))
    d.write.partitionBy("lang").text(path)
    return spark.read.schema("value string, lang string").text(path).groupBy("lang").agg(F.count(F.lit(1)).alias("files"))


@query("snk10_trace_table", "SELECT event_type AS span, count(*) AS n, min(event_id) AS first FROM events GROUP BY event_type")
def snk10(spark, sf):
    spans = written(table(spark, sf, "events").select(F.col("event_type").alias("span"), "event_id", "ts"), "spans")
    return spans.groupBy("span").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


_spans = "spans AS (SELECT conv_id AS trace, turn AS span, CASE WHEN turn > 0 THEN (turn - 1) // 2 END AS parent, length(text)::BIGINT AS own FROM conversations)"


@query("snk10_span_tree", f"WITH RECURSIVE {_spans}, walk AS (SELECT trace, span, own, 0 AS depth, own AS path_time, [span] AS path FROM spans WHERE parent IS NULL UNION ALL SELECT s.trace, s.span, s.own, w.depth + 1, w.path_time + s.own, list_append(w.path, s.span) FROM walk w JOIN spans s ON s.trace = w.trace AND s.parent = w.span), best AS (SELECT trace, path AS longest FROM (SELECT *, row_number() OVER (PARTITION BY trace ORDER BY path_time DESC, span) AS k FROM walk) WHERE k = 1), below AS (SELECT trace, span, sum(own)::BIGINT AS total FROM (SELECT trace, unnest(path) AS span, own FROM walk) GROUP BY ALL) SELECT trace, span, depth, path_time, total, list_contains(longest, span) AS critical FROM walk JOIN below USING (trace, span) JOIN best USING (trace)")
def snk10_tree(spark, sf):
    """Turns as spans: turn n was called by turn (n - 1) / 2 and takes as long as its text."""
    parent = F.when(F.col("turn") > 0, F.expr("(turn - 1) div 2"))
    return span_tree(table(spark, sf, "conversations").select(F.col("conv_id").alias("trace"), F.col("turn").alias("span"), parent.alias("parent"), F.char_length("text").alias("own")))


@query("snk11_response", f"WITH {views.REPLIES} SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'Sorry, there is no answer just now.' ELSE reply END AS reply FROM replies")
def snk11(spark, sf):
    r = views.replies(spark, sf)
    return r.select("conv_id", "turn", F.coalesce(F.when(F.col("turn") % 3 != 0, F.col("reply")), F.lit("Sorry, there is no answer just now.")).alias("reply"))


# incremental maintenance ---------------------------------------------------------------------------------------------


@query("inc02_paper_sync", with_state("SELECT p.bib, CASE WHEN c.full_ THEN 'full text' ELSE 'abstract only' END AS coverage, (SELECT count(*) FROM papers WHERE doc_id % 10 IN (1, 7)) AS written, 5 AS removed FROM papers p LEFT JOIN (SELECT a.bib, bool_or(coalesce(coverage, 'full text') = 'full text') AS full_ FROM state s JOIN aliases a ON a.alias = s.parent_doc GROUP BY a.bib) c ON c.bib = p.bib"))
def inc02(spark, sf):
    """The paper table brought to the list: some papers are new to it, some have changed, five have left the list."""
    p = views.papers(spark, sf)
    held = records.coverage_of(views.index_state(spark, sf), records.alias_map(p))
    rows = p.select("bib", "doc_id", "title").join(held, "bib", "left").withColumn("coverage", F.coalesce("coverage", F.lit("abstract only")))
    listing = rows.select("bib", "doc_id", "coverage", T.fingerprint(F.col("title"), F.col("coverage")).alias("fingerprint"))
    old = listing.filter("doc_id % 10 <> 1").withColumn("fingerprint", F.when(F.col("doc_id") % 10 == 7, "stale").otherwise(F.col("fingerprint")))
    gone = spark.range(5).selectExpr("concat('gone:', id) AS bib", "-id AS doc_id", "'full text' AS coverage", "'x' AS fingerprint")
    store = files.TableStore(spark, shared_folder(spark, "papers"))
    store.write("papers", old.unionByName(gone))
    did = sync.sync_full(store, "papers", listing, "bib")
    return store.read("papers").select("bib", "coverage", F.lit(did["written"]).cast("long").alias("written"), F.lit(did["removed"]).alias("removed"))


@query("inc03_site_sync", "SELECT CASE WHEN page_id % 10 = 3 THEN 'new' WHEN page_id % 10 = 7 THEN 'write' WHEN page_id % 10 = 5 THEN 'failed' WHEN page_id % 10 = 9 THEN 'delete' ELSE 'keep' END AS action, count(*) AS n FROM pages GROUP BY 1")
def inc03(spark, sf):
    """Page-level differences: pages that failed to load stay, pages that left go."""
    p = table(spark, sf, "pages").select("page_id", F.sha2("html", 256).alias("fp"))
    d = F.col("page_id") % 10
    old = p.filter(d != 3).select("page_id", F.when(d == 7, F.lit("x")).otherwise(F.col("fp")).alias("old"))
    live, failed = p.filter(~d.isin(5, 9)), p.filter(d == 5).select("page_id", F.lit(True).alias("bad"))
    both = live.join(old, "page_id", "full_outer").join(failed, "page_id", "left")
    action = F.when(F.col("fp").isNull(), F.when(F.col("bad"), "failed").otherwise("delete")).when(F.col("old").isNull(), "new").when(F.col("fp") == F.col("old"), "keep").otherwise("write")
    return both.groupBy(action.alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query("inc04_reconcile", with_papers("SELECT CASE WHEN doc_id % 10 = 1 THEN 'new' WHEN doc_id % 10 = 2 THEN 'removed' WHEN doc_id % 11 = 0 THEN 'renamed' WHEN doc_id % 10 = 4 THEN 'reopened' ELSE 'same' END AS change, count(*) AS n FROM papers GROUP BY 1"))
def inc04(spark, sf):
    """The manifest against the list: new, renamed, removed and reopened entries."""
    p = views.papers(spark, sf)
    d = F.col("doc_id") % 10
    listed = p.filter(d != 2).select("bib", "aliases", F.lit("i1").alias("inputs"))
    manifest = p.filter(d != 1).select(F.when(F.col("doc_id") % 11 == 0, F.col("aliases")[1]).otherwise(F.col("bib")).alias("name"), F.when(d == 4, F.lit("i0")).otherwise(F.lit("i1")).alias("old_inputs"))
    own = manifest.join(listed.select(F.explode("aliases").alias("name"), "bib", "inputs"), "name", "left")
    new = listed.join(own.filter("bib IS NOT NULL").select("bib"), "bib", "left_anti").select(F.lit("new").alias("change"))
    change = F.when(F.col("bib").isNull(), "removed").when(F.col("name") != F.col("bib"), "renamed").when(~F.col("inputs").eqNullSafe(F.col("old_inputs")), "reopened").otherwise("same")
    return own.select(change.alias("change")).unionAll(new).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


_state = f"CASE WHEN doc_id % 5 = 0 AND doc_id % 2 = 0 THEN 'full text' WHEN doc_id % 5 = 0 THEN 'not indexable' WHEN len({_sources}) = 0 THEN 'abstract only' WHEN len({_remain}) = 0 THEN 'failed' WHEN doc_id % 3 = 0 OR doc_id % 4 = 0 THEN 'retry' ELSE 'pending' END"


@query("inc05_derive_state", with_papers(f"SELECT bib, {_state} AS state FROM papers"))
def inc05(spark, sf):
    t = _tried(spark, sf).withColumn("remaining", records.remaining_sources(F.col("sources"), F.col("tried")))
    state = records.derive_state(F.col("doc_id") % 5 == 0, F.col("doc_id") % 2 == 0, F.col("sources"), F.col("remaining"), F.col("tried"))
    return t.select("bib", state.alias("state"))


_attempted = "attempted AS (SELECT user_id::VARCHAR AS key, epoch_us(ts) // 1000 AS ms, event_type = 'error' AS failed FROM events WHERE event_type IN ('error', 'purchase'))"
EVENT = "key string, ts timestamp, failed boolean"
#: A key that no user has, for the event that lets a stream's time go on.
NOBODY = -(1 << 63)


def _utc():
    """The events' time, which has no zone, as a point of time."""
    return F.expr("timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts))")


def _in_parts(spark, events, name, closing):
    """A folder for a stream, and a function that lands the first half of events, or the rest and one event (closing) long after all others."""
    folder = shared_folder(spark, name)
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    middle = F.lit(low) + (F.lit(high) - F.lit(low)) / 2

    def land(first):
        events.filter(F.col("ts") <= middle if first else F.col("ts") > middle).write.mode("append").parquet(folder)
        if not first:
            events.agg((F.max("ts") + F.expr("interval 30 days")).alias("ts")).select(*[F.col("ts") if c == "ts" else F.lit(closing.get(c)).cast(t).alias(c) for c, t in events.dtypes]).write.mode("append").parquet(folder)

    return folder, land


@query("inc05_retry_stream", f"WITH {_attempted}, a AS (SELECT *, count(*) FILTER (NOT failed) OVER (PARTITION BY key ORDER BY ms, failed ROWS UNBOUNDED PRECEDING) AS streak, lead(ms) OVER (PARTITION BY key ORDER BY ms, failed) AS next FROM attempted), b AS (SELECT *, (count(*) FILTER (failed) OVER (PARTITION BY key, streak ORDER BY ms, failed ROWS UNBOUNDED PRECEDING))::INTEGER AS failures FROM a), c AS (SELECT *, ms + 1000 * least(failures * {attempts.STEP}, {attempts.MOST}) AS due FROM b WHERE failed) SELECT key, failures, due FROM c WHERE next IS NULL OR due < next")
def inc05_stream(spark, sf):
    """Retries that fall due after failed attempts, from a stream with state and timers that is stopped and resumed half-way."""
    e = table(spark, sf, "events").filter("event_type IN ('error', 'purchase')").select(F.col("user_id").cast("string").alias("key"), _utc().alias("ts"), (F.col("event_type") == "error").alias("failed"))
    folder, land = _in_parts(spark, e, "attempts", {"key": "", "failed": False})
    checkpoint, out = shared_folder(spark, "checkpoint"), shared_folder(spark, "retries")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", attempts.ROCKSDB)
    try:
        for first in (True, False):
            land(first)
            stream = attempts.retries(spark.readStream.schema(EVENT).parquet(folder))
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(attempts.RETRY).parquet(out).select("key", "failures", F.unix_millis("due").alias("due"))


@query("src20_timed_runs", "WITH s AS (SELECT user_id, ts FROM events WHERE event_type = 'click'), e AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase') SELECT s.user_id, epoch_us(s.ts) AS started, epoch_us(e.ts) AS ended FROM s LEFT JOIN e ON e.user_id = s.user_id AND e.ts >= s.ts AND e.ts <= s.ts + INTERVAL 2 HOURS")
def src20_runs(spark, sf):
    """Starts and ends of runs as two streams; starts that no end follows in time leave as timed out."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("key"), _utc().alias("ts"), "event_type")
    streams, lands = [], []
    for kind in ("click", "purchase"):
        folder, land = _in_parts(spark, e.filter(F.col("event_type") == kind).select("key", "ts"), kind, {"key": NOBODY})
        lands.append(land)
        streams.append(folder)
    checkpoint, out = shared_folder(spark, "checkpoint"), shared_folder(spark, "runs")
    for first in (True, False):
        for land in lands:
            land(first)
        starts, ends = (spark.readStream.schema("key long, ts timestamp").parquet(f) for f in streams)
        attempts.runs(starts, ends).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema("key long, started timestamp, ended timestamp").parquet(out).filter(F.col("key") != NOBODY)
    return rows.select(F.col("key").alias("user_id"), F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"))


@query("inc06_licence_step", f"WITH {views.EVIDENCE} SELECT doc_id, source, CASE WHEN source = 'crossref' AND doc_id % 5 = 0 THEN 'kept' ELSE 'new' END AS origin FROM evidence")
def inc06(spark, sf):
    """Sources that failed in this run keep their earlier evidence."""
    e = views.evidence(spark, sf).select("doc_id", "source", "value")
    failed = (F.col("source") == "crossref") & (F.col("doc_id") % 5 == 0)
    new = e.filter(~failed).withColumn("origin", F.lit("new"))
    bad = e.filter(failed).select("doc_id", "source").distinct()
    return new.unionByName(e.join(bad, ["doc_id", "source"], "left_semi").withColumn("origin", F.lit("kept"))).select("doc_id", "source", "origin")


@query("inc08_removal_guard", "SELECT true AS refused, 5 AS allowed")
def inc08(spark, sf):
    gone = records.orphans(views.index_state(spark, sf), records.alias_map(views.papers(spark, sf))).count()
    try:
        records.guard_removals(gone, 4)
        refused = False
    except records.RemovalRefused:
        refused = True
    records.guard_removals(gone, 10)
    return spark.createDataFrame([(refused, gone)], "refused boolean, allowed int")


@query("inc09_fetch_rounds", with_papers("SELECT bib, CASE doc_id % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'failed' WHEN 2 THEN 'done' ELSE 'retry' END AS result FROM papers"))
def inc09(spark, sf):
    """All papers in rounds: done at once, failed for good, done in the third round, or still to be tried after it."""

    def attempt(row, k):
        return ("done", "failed", "done" if k == 3 else "retry", "retry")[row["doc_id"] % 4]

    return sync.fetch_rounds_table(views.papers(spark, sf).select("bib", "doc_id"), attempt).select("bib", "result")


@query("inc10_conversion_intake", "SELECT user_id::VARCHAR AS id, CASE WHEN count(*) FILTER (event_type = 'purchase') = 0 THEN 'running' ELSE 'done' END AS state FROM events GROUP BY user_id")
def inc10(spark, sf):
    e = table(spark, sf, "events").select(F.when(F.col("event_type") == "purchase", "done").otherwise("start").alias("event"), F.col("user_id").cast("string").alias("id"), F.lit(None).cast("string").alias("error"), F.col("value").alias("seconds"))
    return files.job_states(e).select("id", "state")


@query("inc11_single_run", "SELECT true AS second_refused")
def inc11(spark, sf):
    import tempfile

    with tempfile.NamedTemporaryFile() as f, sync.single_run(f.name):
        try:
            with sync.single_run(f.name):
                refused = False
        except BlockingIOError:
            refused = True
    return spark.createDataFrame([(refused,)], "second_refused boolean")


@query("inc12_missing_source", with_papers("SELECT bib, CASE WHEN doc_id % 4 = 0 THEN CASE WHEN doc_id % 8 = 0 THEN 'keep' ELSE 'forget' END ELSE 'present' END AS action FROM papers"))
def inc12(spark, sf):
    """A file that is gone: its objects stay if the stored hash still gives their fingerprint."""
    p = views.papers(spark, sf)
    sha = F.sha2("markdown", 256)
    rows = p.select("bib", F.when(F.col("doc_id") % 4 != 0, sha).alias("sha"), F.when(F.col("doc_id") % 8 == 0, sha).otherwise(F.lit("other")).alias("stored_sha"), T.fingerprint(F.col("title"), sha).alias("stored_fp"), "title")
    same = T.fingerprint(F.col("title"), F.coalesce("sha", "stored_sha")) == F.col("stored_fp")
    return rows.select("bib", F.when(F.col("sha").isNotNull(), "present").when(same, "keep").otherwise("forget").alias("action"))


@query("inc13_edit_detection", with_papers("SELECT bib FROM papers WHERE doc_id % 6 = 1"))
def inc13(spark, sf):
    sha = F.sha2("markdown", 256)
    rows = views.papers(spark, sf).select("bib", sha.alias("now"), F.when(F.col("doc_id") % 6 == 1, F.lit(None)).otherwise(sha).alias("before"))
    return rows.filter(~F.col("now").eqNullSafe(F.col("before"))).select("bib")


@query("inc14_source_order", with_papers(f"SELECT bib, array_to_string(list_distinct_in_order, ',') AS sources FROM (SELECT bib, list_concat({_sources}, CASE WHEN doc_id % 7 = 0 THEN ['manual'] ELSE []::VARCHAR[] END) AS list_distinct_in_order FROM papers)"))
def inc14(spark, sf):
    extra = F.when(F.col("doc_id") % 7 == 0, F.array(F.lit("manual"))).otherwise(F.array().cast("array<string>"))
    return _tried(spark, sf).select("bib", F.array_join(F.array_union("sources", extra), ",").alias("sources"))


@query("udf09_paper_search_text", with_papers("""SELECT 'years' AS search, 'years: 2005-2006; ' || count(*) || ' papers match, ' || CASE WHEN count(*) > 10 THEN 'the 10 best follow; at most 10 are shown' ELSE 'all follow' END AS said FROM papers WHERE year::INTEGER BETWEEN 2005 AND 2006 HAVING count(*) > 0
 UNION ALL SELECT 'nobody', 'author: qqqq wwww; no paper of the list matches'
 UNION ALL SELECT 'weak', 'query: qqqq wwww xxxx the; no paper is clearly about this, the 3 closest follow'"""))
def udf09(spark, sf):
    """What three searches say of what they found: by years, by an author who is not listed, and on a topic that no paper has."""
    from quillstone.operators import answers, search

    def said(filters, **how):
        rows, total, _ = search.find_papers(relational.paper_index(spark, sf), limit=10, **how)
        got = rows.select("weak").collect()
        return answers.search_summary(filters, len(got), total, 10, any(r["weak"] for r in got))

    topic = "qqqq wwww xxxx the"
    out = [("years", said({"years": "2005-2006"}, year_from=2005, year_to=2006)), ("nobody", said({"author": "qqqq wwww"}, author_key="qqqq wwww")), ("weak", said({"query": topic}, query=topic))]
    return spark.createDataFrame(out, "search string, said string")


@query("udf11_entry_point")
def udf11(spark, sf):
    """Every question answered end to end with the stand-in models: reply and source lines."""
    from quillstone.plans.retrieval import answered

    return answered(spark, sf).select("query_id", T.renumber_citations(F.col("reply")).alias("reply"), F.size(T.cited(F.col("reply"))).alias("sources"))


@query("udf13_spans", "SELECT item_id, kind, n, parents, failed FROM benchmark, (VALUES ('AGENT', 1, 0, 0), ('LLM', 2, 2, 0), ('TOOL', 1, 1, 0)) t(kind, n, parents, failed)")
def udf13(spark, sf):
    """Spans that the answer loop records for each question: by kind, how many there are, stand in another, and failed."""
    from quillstone.operators import answers

    def run(frames):
        for f in frames:
            out = []
            for item_id, text in zip(f["item_id"], f["text"], strict=True):
                trace = answers.Trace()
                answers.answer_loop(answers.RuleModel(), text, [], {"search_papers": lambda args: [{"key": "k"}]}, 1, trace)
                out += [(item_id, r["kind"], r["parent"], r["error"]) for r in trace.rows]
            yield pd.DataFrame(out, columns=["item_id", "kind", "parent", "error"])

    spans = table(spark, sf, "benchmark").select("item_id", "text").mapInPandas(run, "item_id long, kind string, parent int, error string")
    counts = {"n": F.lit(True), "parents": F.col("parent") >= 0, "failed": F.col("error").isNotNull()}
    return spans.groupBy("item_id", "kind").agg(*[F.count_if(c).cast("int").alias(n) for n, c in counts.items()])


@query("evl08_modes", f"WITH {views.RUNS} SELECT config, question, count(*) AS rows FROM runs WHERE question IN ('q1', 'q2', 'q3') GROUP BY config, question")
def evl08(spark, sf):
    return views.runs(spark, sf).filter(F.col("question").isin("q1", "q2", "q3")).groupBy("config", "question").agg(F.count(F.lit(1)).alias("rows"))


@query("ui01_last_messages", "SELECT conv_id, count(*) AS kept FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 8 GROUP BY conv_id")
def ui01(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return table(spark, sf, "conversations").withColumn("k", F.row_number().over(w)).filter("k <= 8").groupBy("conv_id").agg(F.count(F.lit(1)).alias("kept"))
