"""Queries of the text, date, number and array functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import licences as L
from quillstone.functions import text as T
from quillstone.functions import values as V
from quillstone.operators.ranks import ranked
from quillstone.plans import views
from quillstone.plans.registry import query, table

ROOT = "https://www.example.org/"
HOME = "https://www.example.org/home"
SQUEEZE = "trim(regexp_replace({0}, '[ \\t\\n\\r\\f]+', ' ', 'g'))"


def sq(x: str) -> str:
    return SQUEEZE.format(x)


def with_papers(body: str) -> str:
    return f"WITH {views.PAPERS} {body}"


def words_sql(x: str) -> str:
    plain = f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'))"
    return f"(CASE WHEN {plain} = '' THEN []::VARCHAR[] ELSE string_split({plain}, ' ') END)"


def word_count_sql(x: str) -> str:
    plain = sq(f"coalesce({x}, '')")
    return f"(CASE WHEN {plain} = '' THEN 0 ELSE len(string_split({plain}, ' ')) END)"


def shingles_sql(x: str, n: int = 5) -> str:
    return f"(SELECT list_distinct(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i : i + {n - 1}], ' '))) FROM (SELECT {words_sql(x)} AS w))"


def fold_sql(x: str) -> str:
    x = f"lower({x})"
    for letter, plain in T.LETTERS:
        x = f"replace({x}, '{letter}', '{plain}')"
    return f"trim(regexp_replace(strip_accents({x}), '[^a-z0-9]+', ' ', 'g'))"


def key_sql(x: str) -> str:
    return fold_sql(f"string_split({x}, ',')[1]")


# text ----------------------------------------------------------------------------------------------------------------

_clean = "regexp_replace(coalesce(html, ''), '<[^>]+>', '', 'g')"
for _a, _b in T.ENTITIES:
    _clean = f"replace({_clean}, '{_a}', '{_b.replace(chr(39), chr(39) * 2)}')"


@query("str01_clean_text", f"SELECT page_id, {sq(_clean)} AS clean FROM pages")
def str01(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.clean_text(F.col("html")).alias("clean"))


@query("str02_arxiv_id", with_papers("SELECT bib, substr(list_filter(identifier, lambda x: starts_with(x, 'arXiv:'))[1], 7) AS arxiv_id FROM papers"))
def str02(spark, sf):
    first = F.get(F.filter("identifier", lambda x: x.startswith("arXiv:")), F.lit(0))
    return views.papers(spark, sf).select("bib", F.substring(first, 7, 1000).alias("arxiv_id"))


_last = "list_transform(author, lambda a: trim(string_split(a, ',')[1]))"


@query("str03_short_ref", with_papers(f"SELECT bib, CASE len(author) WHEN 0 THEN 'Unknown' WHEN 1 THEN {_last}[1] WHEN 2 THEN array_to_string({_last}, ' & ') ELSE {_last}[1] || ' et al.' END || ' (' || year || ')' AS short_ref FROM papers"))
def str03(spark, sf):
    return views.papers(spark, sf).select("bib", T.short_ref(F.col("author"), F.col("year")).alias("short_ref"))


@query("str04_words", f"SELECT doc_id, len({words_sql('text')})::BIGINT AS n_words, len(list_distinct({words_sql('text')}))::BIGINT AS n_distinct, md5(array_to_string({words_sql('text')}, ' ')) AS digest FROM documents")
def str04(spark, sf):
    w = table(spark, sf, "documents").select("doc_id", T.words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.md5(F.array_join("w", " ").cast("binary")).alias("digest"))


_own = f"list_distinct(list_filter({words_sql('title')}, lambda w: length(w) > 3))"


@query("str05_title_share", with_papers(f"SELECT bib, CASE WHEN len({_own}) = 0 THEN 1.0::DOUBLE ELSE round(len(list_intersect({_own}, {words_sql('substr(text, 100, 8000)')})) / len({_own}), 6)::DOUBLE END AS share FROM papers"))
def str05(spark, sf):
    return views.papers(spark, sf).select("bib", F.round(T.title_share(F.col("title"), F.substring("text", 100, 8000)), 6).alias("share"))


@query("str06_abstract_share", with_papers(f"SELECT bib, CASE WHEN len({shingles_sql('abstract')}) = 0 THEN 1.0::DOUBLE ELSE round(len(list_intersect({shingles_sql('abstract')}, {shingles_sql('substr(substr(text, 200), 1, 30000)')})) / len({shingles_sql('abstract')}), 6)::DOUBLE END AS share FROM papers"))
def str06(spark, sf):
    share = T.abstract_share(F.col("abstract"), F.expr("substring(text, 200)"))
    return views.papers(spark, sf).select("bib", F.round(share, 6).alias("share"))


@query("str07_fold_name", f"SELECT doc_id, {fold_sql('text')} AS folded FROM documents")
def str07(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.fold_name(F.col("text")).alias("folded"))


_w = f"list_filter(string_split({key_sql('a')}, ' '), lambda x: x <> '')"
_keys = f"(SELECT list_distinct(flatten(list_transform(range(1, len(w) + 1), lambda i: list_transform(range(0, len(w) - i + 1), lambda n: array_to_string(w[i : i + n], ' '))))) FROM (SELECT {_w} AS w))"
_particles = "[" + ", ".join(f"'{p}'" for p in T.PARTICLES) + "]"


@query("str08_surname_keys", with_papers(f"SELECT bib, pos, array_to_string(list_sort(list_filter({_keys}, lambda k: NOT list_contains({_particles}, k))), '|') AS keys FROM (SELECT bib, unnest(author) AS a, unnest(range(0, len(author))) AS pos FROM papers)"))
def str08(spark, sf):
    a = views.papers(spark, sf).select("bib", F.posexplode("author").alias("pos", "a"))
    return a.select("bib", F.col("pos").cast("long").alias("pos"), F.array_join(F.array_sort(T.surname_keys(F.col("a"))), "|").alias("keys"))


_rest = f"list_filter(author[7:], lambda a: contains(' ' || {key_sql('a')} || ' ', ' nation 1 '))[1:3]"


@query("str09_authors_line", with_papers(f"SELECT bib, array_to_string(author[1:6], '; ') || CASE WHEN len(author) > 6 THEN '; and ' || (len(author) - 6) || ' more' ELSE '' END || CASE WHEN len({_rest}) > 0 THEN ' (including ' || array_to_string({_rest}, '; ') || ')' ELSE '' END AS line FROM papers"))
def str09(spark, sf):
    return views.papers(spark, sf).select("bib", T.authors_line(F.col("author"), F.lit("nation 1")).alias("line"))


@query("str10_shorten_abstract", with_papers("SELECT bib, CASE WHEN length(abstract) > 400 THEN regexp_replace(substr(abstract, 1, 400), ' [^ ]*$', '') || ' …' ELSE abstract END AS short FROM papers"))
def str10(spark, sf):
    return views.papers(spark, sf).select("bib", T.shorten(F.col("abstract")).alias("short"))


_plain = sq("regexp_replace(regexp_replace(regexp_replace(m, '!\\[(\\\\.|[^\\]\\\\])*\\]\\([^)]*\\)', '', 'g'), '\\[((\\\\.|[^\\]\\\\])*)\\]\\([^)]*\\)', '\\1', 'g'), '(?m)^[ \\t]*#+[ \\t]+', '', 'g')")


@query("str11_snippet", with_papers(f"SELECT bib, CASE WHEN length(p) <= 60 THEN p ELSE regexp_replace(substr(p, 1, 60), ' [^ ]*$', '') || '…' END AS snippet FROM (SELECT bib, {_plain} AS p FROM (SELECT bib, '## Head' || chr(10) || '![i](a.png) [t](http://u) ' || text AS m FROM papers))"))
def str11(spark, sf):
    m = F.concat(F.lit("## Head\n![i](a.png) [t](http://u) "), "text")
    return views.papers(spark, sf).select("bib", T.snippet(m).alias("snippet"))


_n = "least(length(h[1]), length(title), 25)"


@query("str12_path_without_title", with_papers(f"SELECT bib, array_to_string(CASE WHEN {_n} >= 10 AND substr(lower(h[1]), 1, {_n}) = substr(lower(title), 1, {_n}) THEN h[2:] ELSE h END, ' > ') AS path FROM (SELECT bib, title, [CASE WHEN doc_id % 3 = 0 THEN title || ' note' ELSE 'Methods' END, pub] AS h FROM papers)"))
def str12(spark, sf):
    h = F.array(F.when(F.col("doc_id") % 3 == 0, F.concat("title", F.lit(" note"))).otherwise(F.lit("Methods")), "pub")
    return views.papers(spark, sf).select("bib", F.array_join(T.without_title(h, F.col("title")), " > ").alias("path"))


@query("str13_page_path", with_papers("SELECT bib, array_to_string(CASE WHEN lower(trim(h[1])) = lower(trim(title)) THEN h[2:] ELSE h END, ' > ') AS path FROM (SELECT bib, title, [CASE WHEN doc_id % 3 = 0 THEN ' ' || title || ' ' ELSE 'Methods' END, pub] AS h FROM papers)"))
def str13(spark, sf):
    h = F.array(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), "title", F.lit(" "))).otherwise(F.lit("Methods")), "pub")
    return views.papers(spark, sf).select("bib", F.array_join(T.without_page_title(h, F.col("title")), " > ").alias("path"))


_think = "CASE WHEN doc_id % 3 = 0 THEN '<think>a' || chr(10) || 'b</think> ' || text WHEN doc_id % 3 = 1 THEN 'x <x:think> ' || text ELSE text END"


@query("str14_strip_reasoning", f"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace({_think}, '(?is)<(\\w+:)?think>.*?</(\\w+:)?think>\\s*', '', 'g'), '(?is)^.*?<(\\w+:)?think>', ''), '^\\s+|\\s+$', '', 'g') AS answer FROM documents")
def str14(spark, sf):
    d = F.col("doc_id") % 3
    text = F.when(d == 0, F.concat(F.lit("<think>a\nb</think> "), "text")).when(d == 1, F.concat(F.lit("x <x:think> "), "text")).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", T.strip_reasoning(text).alias("answer"))


_marks = "list_transform(regexp_extract_all(reply, '(?s)<cite>(.*?)</cite>', 1), lambda x: trim(x))"
# distinct in order of first use
_order = f"(SELECT list_filter(m, lambda x, i: list_position(m, x) = i) FROM (SELECT {_marks} AS m))"


@query("str15_used_sources", f"WITH {views.REPLIES} SELECT conv_id, turn, array_to_string({_order}, ',') AS used FROM replies")
def str15(spark, sf):
    return views.replies(spark, sf).select("conv_id", "turn", F.array_join(T.cited(F.col("reply")), ",").alias("used"))


@query("win03_citation_renumber", f"WITH {views.REPLIES}, o AS (SELECT *, {_order} AS o, string_split_regex(reply, '<cite>|</cite>') AS parts FROM replies) SELECT conv_id, turn, array_to_string(list_transform(parts, lambda p, i: CASE WHEN i % 2 = 0 THEN '[' || list_position(o, trim(p)) || ']' ELSE p END), '') AS answer FROM o")
def win03(spark, sf):
    return views.replies(spark, sf).select("conv_id", "turn", T.renumber_citations(F.col("reply")).alias("answer"))


@query("str16_strip_citations", f"WITH {views.REPLIES} SELECT conv_id, turn, regexp_replace(reply, '(?s)<cite>.*?</cite>', '', 'g') AS answer FROM replies")
def str16(spark, sf):
    return views.replies(spark, sf).select("conv_id", "turn", T.strip_citations(F.col("reply")).alias("answer"))


@query("jn16_citation_to_doc", f"WITH {views.REPLIES} SELECT conv_id, turn, array_to_string(list_transform({_order}, lambda m: coalesce(CASE WHEN regexp_full_match(m, '[0-9]{{1,9}}') AND m::INTEGER BETWEEN 1 AND 5 THEN m::INTEGER END::VARCHAR, '-')), ',') AS numbers FROM replies")
def jn16(spark, sf):
    n = T.cited_numbers(T.cited(F.col("reply")), F.lit(5))
    return views.replies(spark, sf).select("conv_id", "turn", F.array_join(n, ",", "-").alias("numbers"))


@query("str17_source_line", with_papers("SELECT bib, '[1] ' || pub || ' *[' || title || '](https://x.example/' || bib || ')*' || CASE WHEN length(pd) > 4 THEN ', published ' || pd ELSE '' END || ' — Section: ' || array_to_string(keyword, ', ') || CASE WHEN len(extra) > 0 THEN ' (' || array_to_string(extra, ' · ') || ')' ELSE '' END AS line FROM (SELECT *, CASE WHEN pubdate LIKE '%-00-00' THEN year ELSE substr(pubdate, 1, 7) END AS pd, list_filter([CASE WHEN len(doi) > 0 THEN '[publisher](https://doi.org/' || doi[1] || ')' END, CASE WHEN doc_id % 2 = 0 THEN '[arXiv](https://arxiv.org/abs/' || substr(identifier[2], 7) || ')' END], lambda x: x IS NOT NULL) AS extra FROM papers)"))
def str17(spark, sf):
    from quillstone.operators.answers import source_line

    p = views.papers(spark, sf).withColumns({"pd": V.display_date(F.col("pubdate"), F.col("year")), "arxiv": F.substring(F.get(F.filter("identifier", lambda x: x.startswith("arXiv:")), F.lit(0)), 7, 100)})
    line = source_line(F.lit(1), F.col("pub"), F.col("title"), F.concat(F.lit("https://x.example/"), "bib"), F.col("pd"), F.concat(F.lit("Section: "), F.array_join("keyword", ", ")), F.get("doi", F.lit(0)), F.col("arxiv"))
    return p.select("bib", line.alias("line"))


@query("str18_format_docs", with_papers("""SELECT bib, '{"passage":' || (doc_id + 1) || ',"title":' || to_json(title) || ',"published":' || to_json(year) || CASE WHEN doc_id % 4 = 1 THEN ',"coverage":"abstract only"' ELSE '' END || '}' || chr(10) || text AS context FROM papers"""))
def str18(spark, sf):
    from quillstone.operators.answers import format_passage

    p = views.papers(spark, sf)
    coverage = F.when(F.col("doc_id") % 4 == 1, F.lit("abstract only"))
    return p.select("bib", format_passage(F.col("doc_id") + 1, F.col("title"), F.col("year"), coverage, F.col("text")).alias("context"))


_norm = "regexp_replace(regexp_replace(regexp_replace(url, '[#?].*$', ''), '/+$', ''), '^http://', 'https://')"


@query("str19_normalise_url", f"SELECT page_id, CASE WHEN {_norm} = 'https://www.example.org' THEN '{HOME}' ELSE {_norm} END AS address FROM pages")
def str19(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.normalise_url(F.col("url"), ROOT, HOME).alias("address"))


@query("str20_slug", "SELECT page_id, CASE WHEN starts_with(url, 'https://www.') THEN substr(url, 13) ELSE url END AS slug FROM pages")
def str20(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.slug(F.col("url"), "https://www.").alias("slug"))


def _tidy_input(text):
    return F.concat(F.lit("![a](b.png)\n[](x) see [doc](/d/e)  \n---\n\n\n\n"), text, F.lit(" [t](http://u) \n "))


@query("str21_tidy_markdown", "SELECT doc_id, 'see [doc](https://s.example/d/e)' || chr(10) || chr(10) || regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^[ \\t]*-{3,}[ \\t]*$', '', 'g') || ' [t](http://u)', '(?m)[ \\t]+$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+', '') AS md, regexp_replace('[a](b) ' || text, '\\[((\\\\.|[^\\]\\\\])*)\\]\\([^)]*\\)', '\\1', 'g') AS plain FROM documents")
def str21(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.tidy_markdown(_tidy_input(F.col("text")), "https://s.example").alias("md"), T.link_text(F.concat(F.lit("[a](b) "), "text")).alias("plain"))


@query("str22_page_title", f"WITH {views.SITE} SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_replace('SITE ' || title || ' - Portal - Hub', '(?i)\\s*-\\s*portal\\s*-\\s*hub\\s*$', ''), '^SITE ', '')), ''), url) AS title FROM site")
def str22(spark, sf):
    t = F.concat(F.lit("SITE "), "title", F.lit(" - Portal - Hub"))
    return views.site_pages(spark, sf).select("page_id", T.clean_title(t, r"(?i)\s*-\s*portal\s*-\s*hub\s*$", "^SITE ", F.col("url")).alias("title"))


@query("str23_news_list", "SELECT conv_id, '## News items' || chr(10) || chr(10) || string_agg('- ' || turn || ': [' || role || '](u' || turn || ')', chr(10) ORDER BY turn) AS news FROM conversations GROUP BY conv_id")
def str23(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("n"))
    line = F.transform("n", lambda x: F.concat(F.lit("- "), x["turn"].cast("string"), F.lit(": ["), x["role"], F.lit("](u"), x["turn"].cast("string"), F.lit(")")))
    return c.select("conv_id", F.concat(F.lit("## News items\n\n"), F.array_join(line, "\n")).alias("news"))


@query("str24_heading_text", with_papers("SELECT bib, (1 + doc_id % 40) || '.' || (doc_id % 7) || ' ' || pub AS heading FROM papers"))
def str24(spark, sf):
    h = F.concat(F.lit('<span id="p"></span>***'), (1 + F.col("doc_id") % 40).cast("string"), F.lit("."), (F.col("doc_id") % 7).cast("string"), F.lit(" "), "pub", F.lit("***"))
    return views.papers(spark, sf).select("bib", T.heading_text(h).alias("heading"))


_num = "CASE doc_id % 4 WHEN 0 THEN (1 + doc_id % 40) || '.' || (doc_id % 7) || 'Title' WHEN 1 THEN 'A' || (doc_id % 9) || ' Appendix' WHEN 2 THEN '1.2.3.4.5 Deep' ELSE 'Plain ' || doc_id END"


@query("str25_section_number", f"SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CASE WHEN 1 + doc_id % 40 <= 30 THEN 2 END WHEN 1 THEN 1 END AS depth, CASE WHEN doc_id % 4 = 0 AND 1 + doc_id % 40 <= 30 THEN (1 + doc_id % 40) || '.' || (doc_id % 7) || ' Title' ELSE {_num} END AS heading FROM documents")
def str25(spark, sf):
    d = F.col("doc_id")
    s = lambda c: c.cast("string")
    h = F.when(d % 4 == 0, F.concat(s(1 + d % 40), F.lit("."), s(d % 7), F.lit("Title"))).when(d % 4 == 1, F.concat(F.lit("A"), s(d % 9), F.lit(" Appendix"))).when(d % 4 == 2, F.lit("1.2.3.4.5 Deep")).otherwise(F.concat(F.lit("Plain "), s(d)))
    return table(spark, sf, "documents").select("doc_id", T.section_depth(h).alias("depth"), T.numbered_heading(h).alias("heading"))


@query("flt17_false_heading", "SELECT doc_id, regexp_matches(t, '^[•\\-*–—]') OR ends_with(t, ':') OR length(t) > 120 OR NOT regexp_matches(t, '\\p{L}') AS is_false FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '• ' || substr(text, 1, 20) WHEN 1 THEN substr(text, 1, 30) || ':' WHEN 2 THEN substr(text, 1, 130) ELSE substr(text, 1, 20) END AS t FROM documents)")
def flt17(spark, sf):
    d = F.col("doc_id") % 4
    t = F.when(d == 0, F.concat(F.lit("• "), F.substring("text", 1, 20))).when(d == 1, F.concat(F.substring("text", 1, 30), F.lit(":"))).when(d == 2, F.substring("text", 1, 130)).otherwise(F.substring("text", 1, 20))
    return table(spark, sf, "documents").select("doc_id", T.false_heading(t).alias("is_false"))


@query("str27_strip_wrappers", "SELECT page_id, html AS clean FROM (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<footer\\b.*?</footer>', '', 'g'), '(?is)<svg\\b.*?</svg>', '<img src=\"graphic.svg\">', 'g') AS html FROM pages)")
def str27(spark, sf):
    framed = F.concat(F.lit("<section>\n"), "html", F.lit("\n</section>\n"))
    clean = T.strip_wrappers(framed)
    return table(spark, sf, "pages").select("page_id", F.regexp_replace(clean, "\n$", "").alias("clean"))


_url = "value LIKE 'http%'"


def label_sql(v: str) -> str:
    cc = "(?i)creativecommons\\.org/licen[cs]es/([a-z-]+)/([0-9](\\.[0-9])?)"
    pub = "(?i)creativecommons\\.org/(publicdomain/(zero|mark)|licen[cs]es/publicdomain)"
    return f"""(CASE WHEN regexp_matches({v}, '{cc}') THEN 'CC ' || upper(regexp_extract({v}, '{cc}', 1)) || ' ' || regexp_extract({v}, '{cc}', 2)
 WHEN regexp_matches({v}, '{pub}') THEN CASE WHEN lower(regexp_extract({v}, '{pub}', 2)) = 'zero' THEN 'CC0' ELSE 'public domain' END
 WHEN contains({v}, 'arxiv.org/licenses/nonexclusive-distrib') THEN 'arXiv default licence' WHEN contains({v}, 'arxiv.org/licenses/assumed-1991-2003') THEN 'arXiv, before licences (1991-2003)'
 ELSE 'publisher''s terms (' || regexp_replace(lower(regexp_extract({v}, '://([^/:?#]+)', 1)), '^www\\.', '') || ')' END)"""


def openalex_sql(v: str) -> str:
    last = f"string_split(lower({v}), '/')[-1]"
    return f"(CASE WHEN starts_with({last}, 'cc-') THEN 'CC ' || upper(substr({last}, 4)) WHEN {last} = 'cc0' THEN 'CC0' WHEN {last} = 'public-domain' THEN 'public domain' WHEN {last} = 'publisher-specific-oa' THEN 'publisher''s terms (OpenAlex)' ELSE 'no open licence (OpenAlex: ' || {last} || ')' END)"


def class_sql(x: str) -> str:
    return f"(CASE WHEN {x} IN ('CC0', 'public domain') THEN 'open licence' WHEN starts_with({x}, 'CC BY') THEN CASE WHEN contains(string_split({x}, ' ')[2], 'NC') OR contains(string_split({x}, ' ')[2], 'ND') THEN 'with conditions' ELSE 'open licence' END ELSE 'no licence' END)"


def rank_sql(x: str) -> str:
    return f"(CASE {class_sql(x)} WHEN 'open licence' THEN 0 WHEN 'with conditions' THEN 1 ELSE 2 END)"


@query("str29_licence_label_url", f"WITH {views.EVIDENCE} SELECT doc_id, value, {label_sql('value')} AS label FROM evidence WHERE {_url}")
def str29(spark, sf):
    return views.evidence(spark, sf).filter(_url).select("doc_id", "value", L.label_from_url(F.col("value")).alias("label"))


_id = "CASE doc_id % 5 WHEN 0 THEN 'cc-by-nc' WHEN 1 THEN 'https://x/licenses/cc0' WHEN 2 THEN 'public-domain' WHEN 3 THEN 'publisher-specific-oa' ELSE 'other-oa' END"


@query("str30_licence_label_id", f"SELECT doc_id, {openalex_sql('v')} AS label FROM (SELECT doc_id, {_id} AS v FROM documents)")
def str30(spark, sf):
    return table(spark, sf, "documents").selectExpr("doc_id", f"{_id} AS v").select("doc_id", L.label_from_openalex(F.col("v")).alias("label"))


@query("str31_licence_class", f"WITH {views.EVIDENCE} SELECT doc_id, value, {class_sql('l')} AS class FROM (SELECT doc_id, value, CASE WHEN {_url} THEN {label_sql('value')} ELSE {openalex_sql('value')} END AS l FROM evidence)")
def str31(spark, sf):
    label = F.when(F.expr(_url), L.label_from_url(F.col("value"))).otherwise(L.label_from_openalex(F.col("value")))
    return views.evidence(spark, sf).select("doc_id", "value", L.licence_class(label).alias("class"))


@query("str32_publisher_dois", with_papers("SELECT bib, array_to_string(list_filter(list_transform(doi, lambda d: lower(d)), lambda d: NOT starts_with(d, '10.48550/')), ',') AS dois FROM papers"))
def str32(spark, sf):
    return views.papers(spark, sf).select("bib", F.array_join(L.publisher_dois(F.col("doi")), ",").alias("dois"))


@query("str34_plain_fold", "SELECT doc_id, replace(text, chr(10), '-') || '- ' AS folded FROM documents")
def str34(spark, sf):
    odd = F.concat(F.replace("text", F.lit("\n"), F.lit("‑")), F.lit("− ​"))
    return table(spark, sf, "documents").select("doc_id", T.plain_fold(odd).alias("folded"))


@query("str35_leftovers", f"WITH {views.REPLIES} SELECT conv_id, turn, regexp_matches(reply, '(?i)</?(cite|think|tool)[^>]*>') AS leftover_tag, turn % 5 = 0 AS has_cjk FROM replies")
def str35(spark, sf):
    odd = F.concat("reply", F.when(F.col("turn") % 5 == 0, F.lit("漢")).otherwise(F.lit("")))
    return views.replies(spark, sf).select("conv_id", "turn", T.has_leftover_tag(F.col("reply")).alias("leftover_tag"), T.has_cjk(odd).alias("has_cjk"))


def fingerprint_sql(*parts: str) -> str:
    return f"substr(sha256(concat_ws(chr(31), {', '.join(f'coalesce({chr(39)}={chr(39)} || {p}, {chr(39)}-{chr(39)})' for p in parts)})), 1, 20)"


@query("str36_fingerprint", with_papers(f"SELECT bib, {fingerprint_sql('title', 'abstract', 'sha256(markdown)')} AS fingerprint FROM papers"))
def str36(spark, sf):
    return views.papers(spark, sf).select("bib", T.fingerprint(F.col("title"), F.col("abstract"), F.sha2("markdown", 256)).alias("fingerprint"))


@query("str37_file_hash", "SELECT page_id, sha256(html) AS digest FROM pages")
def str37(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.sha2("html", 256).alias("digest"))


NAMESPACE_DNS = "6ba7b8109dad11d180b400c04fd430c8"
_h = f"sha1(unhex('{NAMESPACE_DNS}') || encode(i))"


@query("str38_identifiers", with_papers(f"SELECT i AS chunk_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM (SELECT i, {_h} AS h FROM (SELECT bib || '#' || lpad((doc_id % 50)::VARCHAR, 4, '0') AS i FROM papers))"))
def str38(spark, sf):
    c = T.chunk_id(F.col("bib"), F.col("doc_id") % 50)
    return views.papers(spark, sf).select(c.alias("chunk_id"), T.uuid5(NAMESPACE_DNS, c).alias("uuid"))


_low, _up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@query("str39_rot13", f"SELECT page_id, translate(url, '{_low}{_up}', '{_low[13:]}{_low[:13]}{_up[13:]}{_up[:13]}') AS hidden FROM pages")
def str39(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.rot13(F.col("url")).alias("hidden"))


@query("str40_url_codec", "SELECT page_id, url AS decoded, url_encode(url) AS encoded FROM pages")
def str40(spark, sf):
    encoded = T.url_encode_form(F.col("url"))
    return table(spark, sf, "pages").select("page_id", F.try_url_decode(encoded).alias("decoded"), encoded.alias("encoded"))


@query("str41_escape_html", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS safe FROM pages")
def str41(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.escape_html(F.col("html")).alias("safe"))


# dates ---------------------------------------------------------------------------------------------------------------


@query("dt01_display_date", with_papers("SELECT bib, CASE WHEN pubdate LIKE '____-00-%' THEN year ELSE substr(pubdate, 1, 7) END AS shown FROM papers"))
def dt01(spark, sf):
    return views.papers(spark, sf).select("bib", V.display_date(F.col("pubdate"), F.col("year")).alias("shown"))


@query("dt02_iso_timestamp", with_papers("SELECT bib, epoch(date::TIMESTAMPTZ)::BIGINT AS seconds FROM papers"))
def dt02(spark, sf):
    return views.papers(spark, sf).select("bib", F.unix_timestamp(V.iso_timestamp(F.col("date"))).alias("seconds"))


@query("dt03_site_date", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%d') END AS updated FROM events")
def dt03(spark, sf):
    say = F.when(F.col("event_id") % 5 == 0, F.lit("no date")).otherwise(F.concat(F.lit("Site last updated on  "), F.date_format("ts", "d MMMM yyyy"), F.lit(".")))
    return table(spark, sf, "events").select("event_id", V.site_date(say).alias("updated"))


@query("dt04_date_line", "SELECT event_id, CASE event_id % 3 WHEN 2 THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS day FROM events")
def dt04(spark, sf):
    e = F.col("event_id") % 3
    line = F.when(e == 0, F.concat(F.lit("("), F.date_format("ts", "MMMM d, yyyy"), F.lit(")"))).when(e == 1, F.date_format("ts", "d MMMM yyyy")).otherwise(F.concat(F.lit("on "), F.date_format("ts", "d MMMM yyyy")))
    return table(spark, sf, "events").select("event_id", F.date_format(V.date_line(line), "yyyy-MM-dd").alias("day"))


@query("dt06_year", with_papers("SELECT bib, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE year::INTEGER END AS year FROM papers"))
def dt06(spark, sf):
    v = F.when(F.col("doc_id") % 7 == 0, F.lit("n.d.")).otherwise(F.concat(F.lit(" "), "pubdate"))
    return views.papers(spark, sf).select("bib", V.year_of(v).alias("year"))


@query("dt07_stamp", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events")
def dt07(spark, sf):
    return table(spark, sf, "events").select("event_id", V.stamp(F.col("ts")).alias("stamp"))


@query("dt08_retry_after", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN (event_id % 4) * 10 ELSE least(event_id % 300, 120) END::INTEGER AS wait FROM events")
def dt08(spark, sf):
    header = F.when(F.col("event_id") % 3 == 0, F.lit("soon")).otherwise((F.col("event_id") % 300).cast("string"))
    return table(spark, sf, "events").select("event_id", V.retry_after(header, (F.col("event_id") % 4).cast("int")).alias("wait"))


# numbers -------------------------------------------------------------------------------------------------------------


@query("mth01_token_estimate", "SELECT doc_id, floor(length(text) / 2.5)::INTEGER + 1 AS tokens FROM documents")
def mth01(spark, sf):
    return table(spark, sf, "documents").select("doc_id", V.token_estimate(F.col("text")).alias("tokens"))


@query("mth02_dry_run_tokens", "SELECT source, sum(length(text) // 3)::BIGINT AS tokens FROM documents GROUP BY source")
def mth02(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.sum(F.expr("length(text) div 3")).alias("tokens"))


@query("mth03_unit_vectors", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) ^ 0.5, 4) AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS first FROM embeddings")
def mth03(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.round(F.sqrt(V.dot(F.col("embedding"), F.col("embedding"))), 4).alias("norm"), F.round(F.get(V.unit(F.col("embedding")), F.lit(0)), 4).alias("first"))


def _sexa_sql(x: str, decimals: int, sign: str) -> str:
    s = 10**decimals
    return f"(SELECT {sign} || lpad((t // {s} // 3600)::VARCHAR, 2, '0') || ':' || lpad((t // {s} // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((t // {s} % 60)::VARCHAR, 2, '0') || '.' || lpad((t % {s})::VARCHAR, {decimals}, '0') FROM (SELECT floor({x} * 3600 * {s} + 0.5)::BIGINT AS t))"


@query("mth04_sexagesimal", f"SELECT event_id, {_sexa_sql('(event_id % 360 + 0.25) / 15', 2, chr(39) * 2)} AS hms, {_sexa_sql('abs(event_id % 180 - 90 + 0.125)', 1, 'CASE WHEN event_id % 180 - 90 + 0.125 < 0 THEN chr(45) ELSE chr(43) END')} AS dms FROM events")
def mth04(spark, sf):
    ra, dec = (F.col("event_id") % 360 + 0.25).cast("double"), (F.col("event_id") % 180 - 90 + 0.125).cast("double")
    return table(spark, sf, "events").select("event_id", V.to_hms(ra).alias("hms"), V.to_dms(dec).alias("dms"))


@query("mth05_parse_sexagesimal", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE round((CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END) * (event_id % 90 + (event_id % 60) / 60 + 30.5 / 3600), 6) END AS degrees FROM events")
def mth05(spark, sf):
    e = F.col("event_id")
    s = lambda c: c.cast("string")
    text = F.when(e % 5 == 0, F.lit("none")).otherwise(F.concat(F.when(e % 2 == 0, F.lit("-")).otherwise(F.lit("+")), s(e % 90), F.lit(":"), s(e % 60), F.lit(":30.5")))
    return table(spark, sf, "events").select("event_id", F.round(V.from_dms(text), 6).alias("degrees"))


@query("mth06_is_integer", "SELECT event_id, value = floor(value) AS whole FROM events")
def mth06(spark, sf):
    return table(spark, sf, "events").select("event_id", V.is_integer(F.col("value")).alias("whole"))


_size = "CASE event_id % 4 WHEN 0 THEN (event_id % 100) || ' B' WHEN 1 THEN (event_id % 100) || '.5 kB' WHEN 2 THEN (event_id % 100) || ' MB' ELSE 'big' END"


@query("mth07_file_size", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN (event_id % 100)::DOUBLE WHEN 1 THEN (event_id % 100 + 0.5) * 1024 WHEN 2 THEN (event_id % 100) * 1048576.0 END::DOUBLE AS bytes FROM events")
def mth07(spark, sf):
    return table(spark, sf, "events").selectExpr("event_id", f"{_size} AS s").select("event_id", V.file_size(F.col("s")).alias("bytes"))


@query("top11_table_sort_keys", "SELECT event_id, rank() OVER (ORDER BY CASE event_id % 3 WHEN 0 THEN (event_id % 9) + (event_id % 5) / 10 WHEN 1 THEN (event_id % 9)::DOUBLE END NULLS LAST) AS place FROM events WHERE event_type = 'click'")
def top11(spark, sf):
    e = F.col("event_id")
    s = lambda c: c.cast("string")
    text = F.when(e % 3 == 0, F.concat(F.lit("Q"), s(e % 9), F.lit("."), s(e % 5))).when(e % 3 == 1, F.concat(F.lit("C"), s(e % 9))).otherwise(F.lit("Q"))
    k = table(spark, sf, "events").filter("event_type = 'click'").select("event_id", V.season(text).alias("k"))
    return ranked(k, "k").select("event_id", "place")


# arrays and JSON -----------------------------------------------------------------------------------------------------


@query("arr01_as_list", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang || '|' || source WHEN 1 THEN lang ELSE '' END AS items FROM documents")
def arr01(spark, sf):
    d = F.col("doc_id") % 3
    v = F.when(d == 0, F.to_json(F.array("lang", "source"))).when(d == 1, F.col("lang"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(V.as_list(v), "|").alias("items"))


@query("arr02_header_path", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang || ' > ' || source ELSE source END AS path FROM documents")
def arr02(spark, sf):
    h = F.array(F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(F.lit("")), "source")
    return table(spark, sf, "documents").select("doc_id", V.header_path(h).alias("path"))


@query("arr03_header_map", "SELECT doc_id, lang AS h1, source AS h2 FROM documents")
def arr03(spark, sf):
    m = F.map_from_arrays(F.array(F.lit("h1"), F.lit("h2")), F.array("lang", "source"))
    return table(spark, sf, "documents").withColumn("m", m).select("doc_id", F.col("m")["h1"].alias("h1"), F.col("m")["h2"].alias("h2"))


@query("arr04_tool_arguments", "SELECT event_id, ['not JSON', 'not an object', 'no query', 'ok'][(event_id % 4 + 1)::INTEGER] AS verdict FROM events")
def arr04(spark, sf):
    e = F.col("event_id") % 4
    text = F.when(e == 0, F.lit("{broken")).when(e == 1, F.lit("[1, 2]")).when(e == 2, F.lit('{"limit": 3}')).otherwise(F.lit('{"query": "x"}'))
    return table(spark, sf, "events").select("event_id", V.tool_arguments(text).alias("verdict"))


@query("arr05_attempts", "SELECT user_id, string_agg(event_type || ':' || n || ':' || last, '|' ORDER BY event_type) AS tried FROM (SELECT user_id, event_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY ALL) GROUP BY user_id")
def arr05(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))
    m = e.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", F.struct("n", "last")))).alias("tried"))
    entries = F.transform(F.array_sort(F.map_entries("tried")), lambda x: F.concat_ws(":", x["key"], x["value"]["n"].cast("string"), x["value"]["last"].cast("string")))
    return m.select("user_id", F.array_join(entries, "|").alias("tried"))


_arx = "coalesce(substr(list_filter(identifier, lambda x: starts_with(x, 'arXiv:'))[1], 7), '')"


@query("arr06_inputs_signature", with_papers(f"SELECT bib, substr(sha256(concat_ws('|', {_arx}, array_to_string(list_sort(esources), ','), array_to_string(list_sort(list_filter(property, lambda p: ends_with(p, 'OPENACCESS'))), ','), array_to_string(list_sort(doi), ','))), 1, 12) AS inputs FROM papers"))
def arr06(spark, sf):
    a = F.substring(F.get(F.filter("identifier", lambda x: x.startswith("arXiv:")), F.lit(0)), 7, 100)
    return views.papers(spark, sf).select("bib", V.inputs_signature(a, F.col("esources"), F.col("property"), F.col("doi")).alias("inputs"))


@query("arr07_nested_default", "SELECT event_id, coalesce(json_extract_string(props, '$.page'), 'none') AS page FROM events")
def arr07(spark, sf):
    return table(spark, sf, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.page"), F.lit("none")).alias("page"))


@query("arr08_doc_summary", with_papers("""SELECT bib, '{"chunk_id":"' || bib || '","pubdate":"' || pubdate || '","headers":["' || doctype || '","' || pub || '"]}' AS summary FROM papers"""))
def arr08(spark, sf):
    return views.papers(spark, sf).select("bib", F.to_json(F.struct(F.col("bib").alias("chunk_id"), "pubdate", F.col("keyword").alias("headers"))).alias("summary"))


@query("arr09_settings_signature", f"SELECT substr(sha256('{{\"max\":512,\"overlap\":64,\"min\":48,\"atomic_max\":8192,\"version\":1}}'), 1, 20) AS signature")
def arr09(spark, sf):
    from quillstone.operators.chunking import ChunkSettings

    return spark.range(1).select(F.substring(F.sha2(F.lit(ChunkSettings().signature()), 256), 1, 20).alias("signature"))
