"""A website as a source: crawl order, article blocks, Markdown and page assembly."""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter, deque
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from itertools import accumulate, count, takewhile
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.batches import in_slices
from quillstone.functions.text import word_count
from quillstone.session import written

MOST_PAGES = 300
FURNITURE = 0.5
LEAST_WORDS = 5
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Events(HTMLParser):
    """A page as a flat list of (kind, element, attributes, source); kind is open, close, empty or text."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.seen: list[tuple[str, str, dict, str]] = []

    def handle_starttag(self, name, attrs):
        self.seen.append(("empty" if name in VOID else "open", name, dict(attrs), self.get_starttag_text()))

    def handle_startendtag(self, name, attrs):
        self.seen.append(("empty", name, dict(attrs), self.get_starttag_text()))

    def handle_endtag(self, name):
        self.seen.append(("close", name, {}, "" if name in VOID else f"</{name}>"))

    def handle_data(self, data):
        self.seen.append(("text", "", {}, data))

    def handle_entityref(self, name):
        self.seen.append(("text", "", {}, f"&{name};"))

    def handle_charref(self, name):
        self.seen.append(("text", "", {}, f"&#{name};"))


def events_of(page: str | None) -> list[tuple[str, str, dict, str]]:
    p = _Events()
    p.feed(page or "")
    p.close()
    return p.seen


def has_class(attrs: dict, name: str) -> bool:
    return name in (attrs.get("class") or "").split()


def blocks_of(events: list, block_class: str, tag: str = "div") -> list[str]:
    """Sources of the outermost elements of a class that are closed, without the cache marks of their addresses."""
    levels = list(accumulate((kind == "open") - (kind == "close" and bool(raw)) for kind, _, _, raw in events))
    out, at = [], 0
    while at < len(events):
        kind, name, attrs, _ = events[at]
        at += 1
        if kind == "open" and name == tag and has_class(attrs, block_class):
            end = next((i for i in range(at, len(events)) if levels[i] < levels[at - 1]), None)
            if end is None:
                break
            out.append(re.sub(r"\?t=\d+", "", "".join(e[3] for e in events[at:end])))
            at = end + 1
    return out


def title_of(events: list) -> str:
    """What the page says of itself to others (og:title), else its title."""
    shared = [a.get("content") or "" for kind, name, a, _ in events if name == "meta" and a.get("property") == "og:title"]
    if shared and shared[-1]:
        return shared[-1]
    heads = [i for i, (kind, name, _, _) in enumerate(events) if kind == "open" and name == "title"]
    texts = ("".join(e[3] for e in takewhile(lambda e: e[0] == "text", events[i + 1 :])) for i in heads)
    return html_lib.unescape("".join(texts)).strip()


def absolute(base: str, link: str) -> str:
    """A link as an address, as it is where it cannot be resolved."""
    try:
        return urljoin(base, link)
    except ValueError:
        return link


def news_of(events: list, base: str = "") -> list[dict]:
    """title, link, date of the page's news cards: titled links around a span of class inner-date that is not empty."""
    cards, dated = [], False
    for kind, name, a, raw in events:
        if kind == "open" and name == "a":
            cards.append({"title": a.get("title") or "", "link": absolute(base, a.get("href") or ""), "date": "", "open": bool(a.get("title"))})
        elif kind == "close" and name == "a" and cards:
            cards[-1]["open"] = False
        if name == "span" or name == "a":
            dated = kind == "open" and name == "span" and has_class(a, "inner-date")
        elif kind == "text" and dated and cards and cards[-1]["open"]:
            cards[-1]["date"] += html_lib.unescape(raw).strip()
    return [{k: c[k] for k in ("title", "link", "date")} for c in cards if c["date"]]


def parse_page(page: str, block_class: str, tag: str = "div", base: str = "") -> dict:
    """Title, blocks of a class and links of a page; links are resolved against a base where there is one."""
    events = events_of(page)
    links = [absolute(base, a["href"]) for kind, name, a, _ in events if kind == "open" and name == "a" and a.get("href")]
    return {"title": title_of(events), "blocks": blocks_of(events, block_class, tag), "links": links}


def parse_pages(pages: DataFrame, block_class: str, tag: str = "div") -> DataFrame:
    """page_id, url, title, blocks, links, news of pages(page_id, url, html); addresses are absolute."""

    def parse(frames):
        for f in frames:
            got = [parse_page(h, block_class, tag, u or "") | {"news": news_of(events_of(h), u or "")} for h, u in zip(f["html"], f["url"], strict=True)]
            yield pd.DataFrame({"page_id": f["page_id"], "url": f["url"]} | {k: [g[k] for g in got] for k in ("title", "blocks", "links", "news")})

    schema = "page_id long, url string, title string, blocks array<string>, links array<string>, news array<struct<title: string, link: string, date: string>>"
    return pages.select("page_id", "url", "html").mapInPandas(parse, schema)


def crawl(home: str, fetch: Callable[[str], str], links_of: Callable[[str, str], list[str]], keep: Callable[[str], bool], most: int = MOST_PAGES) -> tuple[dict[str, str], list[str]]:
    """(pages by address, addresses that failed), breadth first from the home page; a failing home page is fatal."""
    pages, failed, seen, todo = {}, [], {home}, deque([home])
    while todo and len(pages) < most:
        url = todo.popleft()
        try:
            pages[url] = fetch(url)
        except OSError:
            if url == home:
                raise
            failed.append(url)
            continue
        for link in links_of(url, pages[url]):
            if link not in seen and keep(link):
                seen.add(link)
                todo.append(link)
    return pages, failed


def crawl_frontier(links: DataFrame, start: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """url, depth of everything reachable in links(src, dst) from start(url): one join and one anti-join a round, until nothing new is found.

    Every round is written to the shared folder, and every 32 rounds what has been seen is written as one table, so the plan stays
    short however long a chain of pages is. Where a limit of rounds is given, it raises beyond it.
    """
    seen = fresh = written(start.select("url", F.lit(0).alias("depth")).distinct(), "frontier")
    for d in count(1):
        if most_rounds is not None and d > most_rounds:
            raise RuntimeError(f"crawl: not ended after {most_rounds} rounds")
        found = fresh.join(links, F.col("url") == F.col("src")).select(F.col("dst").alias("url")).distinct()
        fresh = written(found.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(d)), "frontier")
        if fresh.isEmpty():
            return seen
        seen = seen.unionAll(fresh)
        if d % 32 == 0:
            seen = written(seen, "frontier")


NEWS_LAST = 2**31 - 1


def news_markdown(news: Column) -> Column:
    """A page's news cards as a list under its heading; null where there are none."""
    lines = F.transform(news, lambda c: F.concat(F.lit("- "), c["date"], F.lit(": ["), c["title"], F.lit("]("), c["link"], F.lit(")")))
    return F.when(F.size(news) > 0, F.concat(F.lit("## News items\n\n"), F.array_join(lines, "\n")))


def furniture_blocks(pages: DataFrame, furniture: float = FURNITURE) -> DataFrame:
    """block of what stands on more than a share of pages(page_id, blocks)."""
    total = pages.agg(F.count(F.lit(1)).alias("total"))
    counts = pages.select(F.explode(F.array_distinct("blocks")).alias("block"), "page_id").distinct().groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(total), F.col("n") > furniture * F.col("total")).select("block")


def site_updated(pages: DataFrame, furniture: float = FURNITURE) -> DataFrame:
    """updated: the latest date that the site's furniture says it was last updated on; null where it says none."""
    said = F.regexp_extract(F.regexp_replace("block", "<[^>]*>", " "), r"(?i)last\s+updated\s+on\s+(\d{1,2}\s+\w+\s+\d{4})", 1)
    day = F.regexp_replace(F.initcap(F.lower(said)), r"\s+", " ")
    when = F.coalesce(F.try_to_date(day, "d MMMM yyyy"), F.try_to_date(day, "d MMM yyyy"))
    return furniture_blocks(pages, furniture).agg(F.max(F.when(said != "", when)).alias("updated"))


def assemble_pages(pages: DataFrame, furniture: float = FURNITURE, least_words: int = LEAST_WORDS, convert: Callable[[Column], Column] | None = None) -> DataFrame:
    """page_id, url, markdown, aliases: blocks on more than a share of the pages dropped, short pages dropped, equal texts merged.

    pages(page_id, url, blocks), with the page's news cards where there is a column news: they end the page and are never furniture.
    convert makes Markdown of a block's source. Blank blocks are left out. The first page of equal texts stays; aliases counts the others.
    """
    each = pages.select("page_id", "url", F.posexplode("blocks").alias("pos", "block"))
    kept = each.join(furniture_blocks(pages, furniture), "block", "left_anti").select("page_id", "url", "pos", "block")
    if convert:
        kept = kept.withColumn("block", convert(F.col("block")))
    if "news" in pages.columns:
        kept = kept.unionByName(pages.select("page_id", "url", F.lit(NEWS_LAST).alias("pos"), news_markdown(F.col("news")).alias("block")).filter("block IS NOT NULL"))
    kept = kept.filter(F.col("block").rlike(r"\S")).groupBy("page_id", "url").agg(F.array_sort(F.collect_list(F.struct("pos", "block"))).alias("b"))
    md = kept.select("page_id", "url", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("markdown")).filter(word_count(F.col("markdown")) >= least_words)
    first = md.withColumn("h", F.sha2("markdown", 256)).groupBy("h").agg(F.min(F.struct("page_id", "url", "markdown")).alias("p"), (F.count(F.lit(1)) - 1).alias("aliases"))
    return first.select("p.*", "aliases")


class _Open:
    """An element that is not closed yet: finished blocks (kind, text), the line being written, rows or items of tables and lists."""

    def __init__(self, name: str, attrs: dict):
        self.name, self.attrs = name, attrs
        self.blocks: list[tuple[str, str]] = []
        self.line: list[str] = []
        self.parts: list = []


class _Markdown(HTMLParser):
    """Writes an element when it closes, from what its children have written, so depth costs no recursion."""

    SKIP = frozenset("head script style nav footer".split())
    INLINE = frozenset("a b strong i em code span sub sup small u abbr cite time label".split())
    MARK = {"b": "**", "strong": "**", "i": "*", "em": "*"}
    #: a new one of these closes an open one of the second column, unless an element of the third stands between
    IMPLIED = {
        "li": ({"li"}, {"ul", "ol"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}),
        "tr": ({"tr"}, {"table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    }

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [_Open("", {})]
        self.names: Counter[str] = Counter()
        self.skipped = self.math = 0

    def handle_starttag(self, name, attrs):
        attrs = dict(attrs)
        if name in self.SKIP:
            self.skipped += 1
        elif self.skipped:
            return
        elif self.math or name == "math":
            if name == "math":
                tex, mark = (attrs.get("alttext") or "").strip(), "$$" if attrs.get("display") == "block" else "$"
                self.open[-1].line.append(f"{mark}{tex}{mark}" if tex and not self.math else "")
                self.math += 1
        elif name == "br":
            self.open[-1].line.append("\n")
        elif name == "img":
            alt = re.sub(r"\s+", " ", attrs.get("alt") or "").strip()
            self.open[-1].line.append(f"![{alt}]({attrs['src']})" if attrs.get("src") else "")
        elif name == "hr":
            self._end_line()
            self.open[-1].blocks.append(("rule", "---"))
        elif name not in VOID:
            if name not in self.INLINE:
                self._end_line()
                closes, within = self.IMPLIED.get(name, ((), ()))
                for k in range(len(self.open) - 1, 0, -1) if closes and any(self.names[c] for c in closes) else ():
                    if self.open[k].name in within:
                        break
                    if self.open[k].name in closes:
                        self._close_to(k)
                        break
                if name == "li" and not (self.names["ul"] or self.names["ol"]):
                    self._push("ul", {})
            self._push(name, attrs)

    def handle_startendtag(self, name, attrs):
        self.handle_starttag(name, attrs)
        if name not in VOID:
            self.handle_endtag(name)

    def handle_endtag(self, name):
        if name in self.SKIP:
            self.skipped = max(0, self.skipped - 1)
        elif self.skipped:
            return
        elif self.math:
            self.math -= name == "math"
        elif self.names[name]:
            self._close_to(max(k for k, e in enumerate(self.open) if e.name == name))

    def handle_data(self, data):
        if not self.skipped and not self.math:
            self.open[-1].line.append(data if self.names["pre"] else re.sub(r"\s+", " ", data))

    def result(self) -> str:
        self.close()
        self._end_line()
        self._close_to(1)
        self._flush(self.open[0])
        return "\n\n".join(text for _, text in self.open[0].blocks).strip()

    def _push(self, name: str, attrs: dict) -> None:
        self.open.append(_Open(name, attrs))
        self.names[name] += 1

    def _end_line(self) -> None:
        """A block begins: inline elements, a paragraph and a heading end here."""
        while self.open[-1].name in self.INLINE or re.fullmatch("p|h[1-6]", self.open[-1].name):
            self._close_to(len(self.open) - 1)
        self._flush(self.open[-1])

    def _close_to(self, k: int) -> None:
        while len(self.open) > k:
            e = self.open.pop()
            self.names[e.name] -= 1
            if e.name in self.INLINE:
                self.open[-1].line.append(self._inline(e))
            else:
                self._block(e, self.open[-1])

    @staticmethod
    def _flush(e: _Open) -> None:
        text = re.sub(r" *\n *", "\n", re.sub(" +", " ", "".join(e.line))).strip()
        e.line = []
        if text:
            e.blocks.append(("text", text))

    def _inline(self, e: _Open) -> str:
        text = "".join(e.line)
        if self.names["pre"]:
            return text
        inner = text.strip()
        lead, tail = text[: len(text) - len(text.lstrip())], text[len(text.rstrip()) :] if inner else ""
        if e.name == "a" and e.attrs.get("href"):
            return f"{lead}[{inner}]({e.attrs['href']}){tail}"
        if e.name == "code" and inner:
            mark = "`" * (1 + max(map(len, re.findall("`+", inner)), default=0))
            return f"{lead}{mark}{inner}{mark}{tail}"
        mark = self.MARK.get(e.name, "") if inner else ""
        return f"{lead}{mark}{inner}{mark}{tail}"

    def _block(self, e: _Open, parent: _Open) -> None:
        if e.name == "pre":
            code = "".join(e.line).strip("\n")
            fence = "`" * max(3, 1 + max(map(len, re.findall("`+", code)), default=0))
            parent.blocks += [("code", f"{fence}\n{code}\n{fence}")] if code.strip() else []
            return
        self._flush(e)
        if re.fullmatch("h[1-6]", e.name):
            parent.blocks += [("heading", "#" * int(e.name[1]) + " " + re.sub(r"\s+", " ", text)) for _, text in e.blocks]
        elif e.name == "blockquote" and e.blocks:
            parent.blocks.append(("quote", "\n".join(f"> {line}".rstrip() for line in "\n\n".join(t for _, t in e.blocks).split("\n"))))
        elif e.name == "li" and parent.name in ("ul", "ol"):
            parent.parts.append(e.blocks)
        elif e.name in ("ul", "ol"):
            parent.blocks += e.blocks
            parent.blocks += [("list", _listed(e.parts, e.name == "ol", e.attrs.get("start")))] if e.parts else []
        elif e.name in ("td", "th") and parent.name == "tr":
            wide = int(e.attrs["colspan"]) if re.fullmatch("[1-9][0-9]?", e.attrs.get("colspan") or "") else 1
            parent.parts += [e.blocks] + [[]] * (wide - 1)
        elif e.name == "tr" and parent.name in ("table", "thead", "tbody", "tfoot"):
            parent.parts += [e.parts] if e.parts else []
        elif e.name in ("thead", "tbody", "tfoot") and parent.name == "table":
            parent.parts += e.parts
            parent.blocks += e.blocks
        elif e.name == "table":
            parent.blocks += e.blocks + _tabled(e.parts)
        else:
            parent.blocks += e.blocks


def _listed(items: list[list[tuple[str, str]]], numbered: bool, start: str | None) -> str:
    first = int(start) if numbered and re.fullmatch("[0-9]{1,9}", start or "") else 1
    out = []
    for k, blocks in enumerate(items, first):
        mark = f"{k}. " if numbered else "- "
        text = "".join(("" if not i else "\n" if kind == "list" else "\n\n") + t for i, (kind, t) in enumerate(blocks))
        out.append((mark + text.replace("\n", "\n" + " " * len(mark))).rstrip())
    return "\n".join(re.sub(r"(?m)^ +$", "", item) for item in out)


def _tabled(rows: list[list[list[tuple[str, str]]]]) -> list[tuple[str, str]]:
    """Rows as a pipe table under the first; a table that only lays out (one column, or blocks in its cells) as its blocks."""
    width = max(map(len, rows), default=0)
    if width < 2 or any(kind != "text" for row in rows for cell in row for kind, _ in cell):
        return [block for row in rows for cell in row for block in cell]
    cells = [[re.sub(r"\s+", " ", " ".join(t for _, t in cell)).replace("|", r"\|") for cell in row] + [""] * (width - len(row)) for row in rows]
    lines = ["| " + " | ".join(row) + " |" for row in cells]
    return [("table", "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]))]


def html_to_markdown(page: str | None) -> str:
    """A page as Markdown: headings, paragraphs, nested and numbered lists, pipe tables, code, quotes, emphasis, links, images, maths.

    Menus, footers, heads, scripts and styles are left out. Characters that mean something in Markdown are not escaped, save bars in tables.
    """
    p = _Markdown()
    p.feed(page or "")
    return p.result()


def html_to_markdown_udf():
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("string")
    def convert(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # a piece of the answers at a time: what a page leaves behind is freed before the next pages are read
        for whole in pages:
            made = [pa.array(map(html_to_markdown, texts), pa.string()) for (texts,) in in_slices([pa.RecordBatch.from_arrays([whole], ["html"])])]
            yield pa.concat_arrays(made) if made else pa.array([], pa.string())

    return convert


def newest_first(pages: DataFrame, key: str, *order) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return pages.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
