import gzip
import io
import tarfile

import pytest
from pyspark.sql import functions as F

from quillstone.operators import answers
from quillstone.operators.records import RemovalRefused
from quillstone.sources import files, site
from quillstone.streaming import sync


def test_unpack():
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w:gz") as t:
        for name, data in (("a/main.tex", b"x"), ("../evil", b"y"), ("/abs", b"z")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    assert files.unpack(buf.getvalue()) == {"a/main.tex": b"x"}
    assert files.unpack(gzip.compress(b"%PDF-1.4")) == {"paper.pdf": b"%PDF-1.4"}
    with pytest.raises(ValueError):
        files.unpack(gzip.compress(b"x" * 1000), limit=10)


def test_main_tex_and_title():
    body = "\\documentclass{a}\n% \\title{no}\n\\title[s]{A {nested} study of stars}\n\\begin{document}"
    assert files.tex_title(body) == "A {nested} study of stars"
    assert files.main_tex({"template.tex": body + "x" * 50, "main.tex": body, "sec.tex": "x"}, "nested study of stars") == "main.tex"


def test_landing_page():
    assert files.citation_pdf_url('<META NAME="citation_pdf_url" CONTENT="/p.pdf">', "https://h/x/y") == "https://h/p.pdf"
    assert files.citation_pdf_url("<p>", "https://h") is None


def test_fetcher_policy():
    slept, answers_ = [], iter([(503, {"retry-after": "500"}, b""), (200, {}, b"ok"), (403, {}, b""), (403, {}, b"")])
    f = files.Fetcher(lambda u: next(answers_), pause=0, refusals=2, sleep=slept.append, clock=lambda: 0.0)
    assert f.fetch("https://h/a") == b"ok" and slept == [120]
    for _ in range(2):
        with pytest.raises(OSError, match="status 403"):
            f.fetch("https://h/a")
    with pytest.raises(OSError, match="refuses"):
        f.fetch("https://h/a")


def test_records_guard(spark, tmp_path):
    p = tmp_path / "list.json"
    p.write_text('{"total": 3, "results": [{"id": 1}, {"id": 2}]}')
    with pytest.raises(ValueError, match="cut"):
        files.read_records(spark, str(p))
    p.write_text('{"total": 2, "results": [{"id": 1}, {"id": 2}]}')
    assert files.read_records(spark, str(p)).count() == 2
    (tmp_path / "log.jsonl").write_text('noise\n{"event": "start", "id": "a"}\n{"event": "done", "id": "a", "error": "", "seconds": 2}\n{"event": "start", "id": "b"}\n')
    states = {r["id"]: r["state"] for r in files.job_states(files.read_events(spark, str(tmp_path / "log.jsonl"))).collect()}
    assert states == {"a": "done", "b": "running"}
    (tmp_path / "papers.json").write_text('{"papers": {"k1": {"title": "T"}}}')
    assert files.read_json_map(spark, str(tmp_path / "papers.json"), "papers", "title: string").first()["value"]["title"] == "T"
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "x.md").write_text("# é")
    assert tuple(files.read_markdown(spark, str(tmp_path / "md")).first()) == ("x", "# é")


def test_page_parser_and_crawl():
    page = '<title>T</title><meta property="og:title" content="O"><div class="a b"><div>x &amp; <img src="i?t=12"></div></div><a href="/n">n</a>'
    got = site.parse_page(page, "b")
    assert got == {"title": "O", "blocks": ['<div>x &amp; <img src="i"></div>'], "links": ["/n"]}
    web = {"h": ["a", "b"], "a": ["c", "h"], "c": []}

    def fetch(u):
        if u not in web:
            raise OSError(u)
        return u

    pages, failed = site.crawl("h", fetch, lambda u, p: web[u], lambda u: True)
    assert list(pages) == ["h", "a", "c"] and failed == ["b"]


def test_site_markdown():
    assert site.html_to_markdown("<nav>no</nav><h2>H</h2><p>a <a href='u'>b</a><ul><li>1<li>2</ul>") == "## H\n\na [b](u)\n\n- 1\n- 2"


def test_streamed_sync(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    (land / "1.json").write_text('{"id": "a", "fingerprint": "1"}\n{"id": "b", "fingerprint": "1"}\n')
    args = (spark, str(land), "id string, fingerprint string", f"file://{tmp_path}/store", "t", "id", str(tmp_path / "cp"))
    sync.stream_into(*args).awaitTermination()
    (land / "2.json").write_text('{"id": "a", "fingerprint": "2"}\n')
    sync.stream_into(*args).awaitTermination()
    store = files.TableStore(spark, f"file://{tmp_path}/store")
    assert {r["id"]: r["fingerprint"] for r in store.read("t").collect()} == {"a": "2", "b": "1"}
    version = store.version("t")
    assert sync.sync_batch(store, "t", store.read("t"), "id") == 0 and store.version("t") == version
    listing = spark.createDataFrame([("b", "9")], "id string, fingerprint string")
    with pytest.raises(RemovalRefused):
        sync.sync_full(store, "t", listing, "id", 0)
    assert sync.sync_full(store, "t", listing, "id") == {"written": 1, "removed": 1}


def test_event_windows(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    ev = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").selectExpr("CAST(ts AS timestamp) AS ts", "event_type")
    q = sync.event_counts(ev, "1 day").writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM counts").first()[0] == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_answer_loop_and_router():
    a = answers.answer_loop(answers.RuleModel(), "q", [{"key": "d1"}], {"search_papers": lambda args: [{"key": "d1"}, {"key": "d2"}]}, 2)
    assert a.reply == "Found: <cite>1</cite>, <cite>2</cite>" and [d["key"] for d in a.docs] == ["d1", "d2"] and a.calls[0]["found"] == 1
    assert answers.route(lambda q: "no json", "raw")["search_query"] == "raw"
    assert answers.route(lambda q: '{"about_service": 0, "search_query": " a  b "}', "raw") == {"about_service": False, "search_query": "a b"}
    assert "User message: q" in answers.prompt("s", ["b", ""], "h", "q")


def test_main_tex_of_a_bundle_with_letters_and_readme():
    body = "\\documentclass{a}\n\\title{%s}\n\\begin{document}"
    same = body % "A study of stars"
    assert files.main_tex({"b/Reply_to_referee.tex": same + "x" * 99, "ms.tex": same}, "A study of stars") == "ms.tex"
    listed = {"old.tex": same, "ms.tex": body % "Other", "00README.XXX": "ms.tex toplevelfile\nfig.tex ignore\n"}
    assert files.main_tex(listed, "A study of stars") == "ms.tex"
    assert files.listed_files({"00README.json": '{"sources": [{"usage": "toplevel", "filename": "ms.tex"}, {"usage": "ignore", "filename": "x.tex"}]}'}) == {"ms.tex"}
    assert files.listed_files({"00README.json": "[1"}) == set()
    assert files.main_tex({"a.txt": same}, "x") is None


def test_title_may_stand_in_late_headings(spark):
    from quillstone.functions import text as T

    late = "word " * 2000 + "\n# The Mission of Plato\n\ntext"
    fourth = "# one\n# two\n## three\n" + late
    rows = spark.createDataFrame([(late,), (fourth,)], "t string").select(T.title_share(F.lit("The mission of Plato"), T.opening(F.col("t"))).alias("s")).collect()
    assert [r["s"] for r in rows] == [1.0, 0.0]


def test_table_store_versions(spark, tmp_path):
    store = files.TableStore(spark, f"file://{tmp_path}")
    assert not store.exists("t")
    held = [store.write("t", spark.range(n)) for n in (1, 2, 3)]
    assert held == sorted(held) and store.version("t") == held[-1] and store.read("t").count() == 3
    # a folder without its pointer, as a crash leaves it, does not count
    spark.range(9).write.parquet(f"file://{tmp_path}/t/v99999999999999999999-x")
    assert store.read("t").count() == 3


def test_nearest_in_blocks(spark, monkeypatch):
    from quillstone.operators import search

    rows = spark.createDataFrame([(f"k{i}", [float(i), 1.0]) for i in range(30)], "doc_key string, embedding array<double>")
    q = spark.createDataFrame([(i, [1.0, float(-i)]) for i in range(20)], "query_id long, q array<double>")
    want = sorted(map(tuple, search.nearest(rows, q, 3).collect()))
    monkeypatch.setattr(search, "MOST_QUERIES", 3)
    assert sorted(map(tuple, search.nearest(rows, q, 3).collect())) == want and len(want) == 60


def test_news_cards_and_absolute_links():
    page = '<a title="A &amp; b" href="n/1"><b>x</b><span class="q inner-date"> 1 May </span></a><a title="no date" href="/2">y</a><span class="inner-date">stray</span><a href="http://[">z</a>'
    assert site.news_of(site.events_of(page), "https://h.example/p/") == [{"title": "A & b", "link": "https://h.example/p/n/1", "date": "1 May"}]
    assert site.parse_page(page, "b", base="https://h.example/p/")["links"] == ["https://h.example/p/n/1", "https://h.example/2", "http://["]
    assert site.parse_page('<div class="b">never closed<div class="b">in it</div>', "b")["blocks"] == []
    assert site.parse_page('<div class="b">1<br>2</br></div><div class="b">3</div>', "b")["blocks"] == ["1<br>2", "3"]
    assert site.parse_page(None, "b") == {"title": "", "blocks": [], "links": []}


def test_full_text_of_the_first_source_that_gives_one():
    def fails(record):
        raise OSError("status 404")

    getters = {"tex": fails, "a-pdf": lambda r: b"<p>CAPTCHA", "b-pdf": lambda r: b"<p>", "c-pdf": lambda r: b"%PDF-1", "bad": lambda r: b"\x1f\x8bnot gzip"}
    got = files.full_text({"sources": ["tex", "bad", "none", "a-pdf", "b-pdf", "c-pdf"]}, getters)
    assert (got["source"], got["kind"]) == ("c-pdf", "pdf")
    assert [e.split(":")[0] for e in got["errors"]] == ["tex", "bad", "none", "a-pdf", "b-pdf"] and got["errors"][3:] == ["a-pdf: a bot check", "b-pdf: not a PDF"]
    assert files.full_text({"sources": []}, getters) == {"source": None, "kind": None, "errors": []}


def test_fetch_rounds_over_a_table(spark):
    names = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("a",)], "name string")
    answers_of = {"a": ["done"], "b": ["failed"], "c": ["retry", "retry", "done"], "d": ["retry"] * 3}
    got = sync.fetch_rounds_table(names, lambda row, k: answers_of[row["name"]][k - 1])
    assert sorted(map(tuple, got.collect())) == [("a", "done"), ("a", "done"), ("b", "failed"), ("c", "done"), ("d", "retry")]
    assert sync.fetch_rounds_table(names.limit(0), lambda row, k: "done").count() == 0


def test_golden_questions_as_by_brute_force(spark, tmp_path):
    from quillstone.plans import views

    texts = [(1, "x a b c d e y"), (2, "xa b c d ey"), (3, None), (4, ""), (5, "b c d"), (6, "a b c d e a b c d e"), (6, "a b c d e"), (7, "p  q r s  t u"), (8, "no zebra here")]
    items = [(1, "a b c d e"), (2, "zebra"), (3, "p  q r s  t"), (4, None), (5, "b c d"), (6, "not in any text at all"), (7, "a b c d e")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {i: sorted(f"doc:{d:08d}" for d, t in texts if t is not None and x in t) for i, x in items if x is not None}
    assert {r["item_id"]: r["expected"] for r in views.golden(spark, str(tmp_path)).collect()} == {i: e for i, e in want.items() if e}


def test_spans_and_search_summaries():
    ticks = iter(range(99))
    t = answers.Trace(lambda: float(next(ticks)))
    with pytest.raises(OSError), t.span("a", "CHAIN"), t.span("b", "TOOL"):
        raise OSError("gone")
    assert [(r["span"], r["parent"], r["seconds"], r["error"]) for r in t.rows] == [("a", -1, 3.0, "OSError: gone"), ("b", 0, 1.0, "OSError: gone")]
    with pytest.raises(ValueError), t.span("c", "nothing"):
        pass
    assert answers.search_summary({}, 2, 2, 10) == "no filters; 2 papers match, all follow"
    assert answers.search_summary({"author": "x"}, 0, 4, 10) == "author: x; 4 papers match the filters, none of them the query"
    assert answers.search_summary({"query": "q"}, 10, 30, 10, given=[1, 3]).endswith("30 papers match, the 10 best follow; at most 10 are shown; given before: 1, 3")
    assert answers.route(lambda q: 1 / 0, "raw")["search_query"] == "raw"


def test_crawl_of_a_long_chain(spark):
    """A chain longer than a batch of rounds, a cycle and a limit."""
    from quillstone.sources.site import crawl_frontier

    links = spark.createDataFrame([(str(k), str(k + 1)) for k in range(40)] + [("5", "2"), ("x", "y")], "src string, dst string").coalesce(1)
    start = spark.createDataFrame([("0",)], "url string")
    assert sorted((int(r["url"]), r["depth"]) for r in crawl_frontier(links, start).collect()) == [(k, k) for k in range(41)]
    with pytest.raises(RuntimeError, match="not ended after 3 rounds"):
        crawl_frontier(links, start, 3)


def test_markdown_of_tables_code_lists_and_maths():
    md = site.html_to_markdown
    assert md("<table><caption>T</caption><tr><th>a<th>b</tr><tr><td>1|2<td><p>x</p><p>y</p></table>") == "T\n\n| a | b |\n| --- | --- |\n| 1\\|2 | x y |"
    assert md("<table><thead><tr><th colspan=2>a</th></tr></thead><tbody><tr><td>1<td>2</tbody></table>z") == "| a |  |\n| --- | --- |\n| 1 | 2 |\n\nz"
    assert md("<table><tr><td><ul><li>x</ul><td>y</table>") == "- x\n\ny"
    assert md("<ul><li>a<ul><li>b<ol start=3><li>c<li>d</ol></ul><li>e<p>f</p></ul>") == "- a\n  - b\n    3. c\n    4. d\n- e\n\n  f"
    assert md("<pre><code>if a:\n    b  ``` c\n</code></pre><p>so <code>x`y</code>.") == "````\nif a:\n    b  ``` c\n````\n\nso ``x`y``."
    assert md("<p>a <b>bold <p>b <em> it </em>c<br>d") == "a **bold**\n\nb *it* c\nd"
    assert md("<blockquote><p>a<p>b</blockquote><hr><img alt='A  b' src='/i.png'><li>z") == "> a\n>\n> b\n\n---\n\n![A b](/i.png)\n\n- z"
    assert md("<p>so <math alttext='a^2'><mi>a</mi></math> is</p><math display=block alttext='b'></math>") == "so $a^2$ is\n\n$$b$$"
    assert md(None) == md("</td></p>") == md("<table></table><ul></ul>") == ""
    assert md("<div>" * 20000 + "x") == "x"


def test_pages_with_news_and_the_date_of_the_site(spark):
    card = [("N 1", "/n/1", "1 May")]
    rows = [(1, "u1", ["<p>foot, last  updated on 3  MAY 2024</p>", "<p>one <b>two</b> three four five</p>"], []), (2, "u2", ["<p>foot, last  updated on 3  MAY 2024</p>", " "], card), (3, "u3", ["<p>foot, last  updated on 3  MAY 2024</p>"], []), (4, "u4", None, card)]
    pages = spark.createDataFrame(rows, "page_id long, url string, blocks array<string>, news array<struct<title: string, link: string, date: string>>")
    got = {r["page_id"]: (r["markdown"], r["aliases"]) for r in site.assemble_pages(pages, convert=site.html_to_markdown_udf()).collect()}
    assert got == {1: ("one **two** three four five", 0), 2: ("## News items\n\n- 1 May: [N 1](/n/1)", 1)}
    assert str(site.site_updated(pages).first()["updated"]) == "2024-05-03"
    assert site.site_updated(pages.drop("blocks").withColumn("blocks", F.array(F.lit("x")))).first()["updated"] is None
    assert site.assemble_pages(pages.limit(0)).count() == 0
