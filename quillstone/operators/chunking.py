"""Markdown documents to header-aware, token-bounded chunks; heading repair; image inventory.

Lines are classified once (`scan`): heading, fenced or plain. A section's paragraphs are measured once, and packing only decides
boundaries: spans of paragraph numbers found by binary search in prefix sums of their tokens. Heading repair is a
query over a DataFrame of lines. Python handles a document at a time, in Arrow batches, where a tokenizer is called.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from itertools import accumulate, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillstone.functions import text as T
from quillstone.functions import values as V
from quillstone.functions.batches import sliced

#: Forms of Markdown headings, fences, paragraph breaks, table captions and rules.
ATX = re.compile(r" {0,3}(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$")
FENCE = re.compile(r" {0,3}(?:`{3,}|~{3,})")
BREAK = re.compile(r"\n[ \t]*\n")
CAPTION = re.compile(r"\s*(?:table|tab\.)\s*\d+", re.I)
RULE = re.compile(r"[\s|:-]*-[\s|:-]*$")
#: Sections that are not worth indexing, by their heading.
DROPPED = re.compile(
    r"\s*(?:(?:[IVXLC]+|[A-Z]|\d+)(?:\.\d+)*[.)]?\s+)?"
    r"(?:(?:references|bibliography|acknowledge?ments?)\b"
    r"|(?:key\s*words?|index\s+terms)\s*[.:]*\s*$)",
    re.I,
)
#: A table has so many lines at least, and such a share of them so many bars at least.
TABLE_LINES, TABLE_BARS, TABLE_SHARE = 3, 3, 0.8
PIECE = "doc_id long, chunk_index int, headers array<string>, content string, part int, n_parts int, tokens int"
_PIECE = pa.schema([("doc_id", pa.int64()), ("chunk_index", pa.int32()), ("headers", pa.list_(pa.string())), ("content", pa.string()), ("part", pa.int32()), ("n_parts", pa.int32()), ("tokens", pa.int32())])


@dataclass(frozen=True)
class ChunkSettings:
    max: int = 512
    overlap: int = 64
    min: int = 48
    atomic_max: int | None = 8192
    version: int = 1

    def signature(self) -> str:
        return json.dumps(asdict(self), separators=(",", ":"))


def estimate(text: str) -> int:
    return int(len(text) / 2.5) + 1


def is_table(paragraph: str) -> bool:
    """Enough lines, and bars in enough of them; blank lines do not count."""
    bars = np.array([line.count("|") for line in paragraph.splitlines() if line.strip()])
    return len(bars) >= TABLE_LINES and bool((bars >= TABLE_BARS).mean() >= TABLE_SHARE)


def table_lines(paragraph: Column) -> Column:
    """The lines of a paragraph that are not blank."""
    return F.filter(F.split(paragraph, "\n"), lambda line: F.trim(line) != "")


def table_of_lines(lines: Column) -> Column:
    """`is_table` as an expression over the lines that `table_lines` gives."""
    bars = F.filter(lines, lambda line: F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit(""))) >= TABLE_BARS)
    return (F.size(lines) >= TABLE_LINES) & (F.size(bars) >= TABLE_SHARE * F.size(lines))


def scan(markdown: str) -> Iterator[tuple[str, int, str, bool]]:
    """(line, level, title, fenced) of every line; level 0 for what is no heading, which fenced lines never are.

    A fence is closed by a fence of the same character only.
    """
    fence = ""
    for line in markdown.splitlines():
        mark = FENCE.match(line)
        if mark:
            char = mark.group().lstrip()[0]
            fence = {"": char, char: ""}.get(fence, fence)
        fenced = bool(mark or fence)
        found = None if fenced else ATX.match(line)
        yield (line, len(found.group(1)), found.group(2).strip(), False) if found else (line, 0, "", fenced)


def sections(markdown: str, levels: tuple[int, ...] = (1, 2, 3, 4, 5, 6)) -> Iterator[tuple[list[str], str]]:
    """(open headers, body) of every section with a body; headings inside fences are content."""
    lines = list(scan(markdown or ""))
    cuts = [k for k, (_, level, *_) in enumerate(lines) if level in levels]
    path: tuple[tuple[int, str], ...] = ()
    for a, b in pairwise([-1, *cuts, len(lines)]):
        if a >= 0:
            _, level, title, _ = lines[a]
            path = (*(p for p in path if p[0] < level), (level, title))
        body = "\n".join(line for line, *_ in lines[a + 1 : b]).strip("\n")
        if body.strip():
            yield [title for _, title in path], body


def split_words(text: str, limit: int, count: Callable[[str], int]) -> list[str]:
    """Pieces of whole words within the limit; a single word over it stays whole."""
    words, out = text.split(), []
    step = max(1, int(len(words) * limit / max(1, count(text)) * 0.9))
    at = 0
    while at < len(words):
        n = min(step, len(words) - at)
        while n > 1 and count(" ".join(words[at : at + n])) > limit:
            n -= 1
        out.append(" ".join(words[at : at + n]))
        at += n
    return out


def split_table(table: str, limit: int, count: Callable[[str], int]) -> list[str]:
    """Pieces of whole rows, each under the table's header."""
    lines = table.splitlines()
    filled = [i for i, x in enumerate(lines) if x.strip()]
    rule = next((i for i in filled[:3] if "|" in lines[i] and RULE.match(lines[i])), None)
    cut = (rule if rule is not None else filled[0]) + 1
    head, rows = lines[:cut], [x for x in lines[cut:] if x.strip()]
    out, at = [], 0
    while at < len(rows):
        n, size = 0, count("\n".join(head)) + 1
        while at + n < len(rows) and (n == 0 or size + count(rows[at + n]) + 1 <= limit):
            size += count(rows[at + n]) + 1
            n += 1
        while n > 1 and count("\n".join(head + rows[at : at + n])) > limit:
            n -= 1
        out.append("\n".join(head + rows[at : at + n]))
        at += n
    return out or [table]


def fill(tokens: list[int], start: int, most: int, overlap: int) -> list[tuple[int, int]]:
    """Spans [a, b) that cover all paragraphs, numbered from `start`, each at most `most` tokens; a span begins with the last
    paragraphs of the one before, as many as the overlap allows, if the next paragraph leaves room for them."""
    at = [0, *accumulate(tokens)]
    n, a, out = len(tokens), 0, []
    while (b := bisect_right(at, at[a] + most) - 1) < n:
        out.append((start + a, start + b))
        shared = bisect_left(at, at[b] - overlap, a, b)
        a = shared if at[b + 1] - at[shared] <= most else b
    return [*out, (start + a, start + n)]


def boundaries(tokens: list[int], kinds: list[str], settings: ChunkSettings) -> list[tuple[int, int]]:
    """Spans [a, b) of paragraphs for the chunks of a section. kinds: 'text', 'caption', 'table' or 'long'.

    Tables and paragraphs over the budget stand alone. A table takes what waits before it: all of it if that is small,
    else its last paragraph if that is a caption.
    """
    alone = [k for k, kind in enumerate(kinds) if kind in ("table", "long")]
    out: list[tuple[int, int]] = []
    for before, k in pairwise([-1, *alone, len(kinds)]):
        first = k
        if before + 1 < k:
            *done, (a, b) = fill(tokens[before + 1 : k], before + 1, settings.max, settings.overlap)
            out += done
            if k < len(kinds) and kinds[k] == "table":
                first = a if sum(tokens[a:b]) <= settings.min else b - 1 if kinds[b - 1] == "caption" else k
            if a < first:
                out.append((a, first))
        if k < len(kinds):
            out.append((first, k + 1))
    return out


def pack(text: str, settings: ChunkSettings = ChunkSettings(), count: Callable[[str], int] = estimate, atomic: Callable[[str], bool] = is_table) -> list[tuple[str, int]]:
    """(chunk, tokens): paragraphs filled up to the budget, with overlap; tables by themselves with their caption."""
    paragraphs = [p for p in map(str.strip, BREAK.split(text)) if p]
    tokens = [count(p) for p in paragraphs]
    kinds = ["table" if atomic(p) else "long" if n > settings.max else "caption" if CAPTION.match(p) else "text" for p, n in zip(paragraphs, tokens, strict=True)]
    out: list[tuple[str, int]] = []
    for a, b in boundaries(tokens, kinds, settings):
        whole, last = "\n\n".join(paragraphs[a:b]), kinds[b - 1]
        size = count(whole)
        if last == "long":
            out += [(piece, count(piece)) for piece in split_words(paragraphs[a], settings.max, count)]
        elif last == "table" and settings.atomic_max is not None and size > settings.atomic_max:
            lead = "".join(f"{p}\n\n" for p in paragraphs[a : b - 1])
            first, *rest = split_table(paragraphs[b - 1], settings.atomic_max - count(lead), count)
            out += [(piece, count(piece)) for piece in (lead + first, *rest)]
        else:
            out.append((whole, size))
    return coalesce_small(out, settings, count)


def joined(sizes: list[int], least: int, most: int) -> list[tuple[int, int]]:
    """Spans of pieces that belong together: one under `least` is open and takes the next piece if both fit; if it cannot,
    it goes to the span before it, if they fit."""
    spans: list[tuple[int, int]] = []
    at, a = [0, *accumulate(sizes)], 0
    for b in range(1, len(at)):
        small = at[b] - at[a] < least
        if small and b < len(sizes) and at[b + 1] - at[a] <= most:
            continue
        if small and spans and at[b] - at[spans[-1][0]] <= most:
            a = spans.pop()[0]
        spans.append((a, b))
        a = b
    return spans


def coalesce_small(pieces: list[tuple[str, int]], settings: ChunkSettings, count: Callable[[str], int] | None = None) -> list[tuple[str, int]]:
    """Pieces under the minimum join the next one if both fit, else the one before, else stay; joined ones are counted anew, or their sizes added up."""
    spans = joined([n for _, n in pieces], settings.min, settings.max)
    texts = ["\n\n".join(t for t, _ in pieces[a:b]) for a, b in spans]
    return [(text, count(text) if count and b > a + 1 else sum(n for _, n in pieces[a:b])) for text, (a, b) in zip(texts, spans, strict=True)]


def chunks(markdown: str, settings: ChunkSettings = ChunkSettings(), drop: re.Pattern | None = DROPPED, count: Callable[[str], int] = estimate) -> list[tuple[list[str], str, int, int, int]]:
    """(headers, content, part, parts, tokens) of a document's chunks in order."""
    out = []
    for headers, body in sections(markdown):
        if drop and any(drop.match(h) for h in headers):
            continue
        parts = pack(body, settings, count)
        out += [(headers, text, k, len(parts), n) for k, (text, n) in enumerate(parts, 1)]
    return out


def chunk_documents(docs: DataFrame, settings: ChunkSettings = ChunkSettings(), drop_sections: bool = True, keep: tuple[str, ...] = (), count: Callable[[str], int] = estimate) -> DataFrame:
    """Chunks of docs(doc_id, markdown), numbered from 1 within each row, with the columns of `keep`; a null text has none."""
    drop = DROPPED if drop_sections else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            doc_ids, texts = (batch.column(k).to_pylist() for k in (0, 1))
            rows = [
                (at, doc_id, i, headers, text, part, parts, n)
                for at, (doc_id, md) in enumerate(zip(doc_ids, texts, strict=True))
                for i, (headers, text, part, parts, n) in enumerate(chunks(md or "", settings, drop, count), 1)
            ]
            at, *columns = zip(*rows, strict=True) if rows else [()] * (len(_PIECE) + 1)
            kept = [c.take(pa.array(at, pa.int64())) for c in batch.columns[2:]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns, _PIECE, strict=True)), *kept], names=[*_PIECE.names, *keep])

    out = StructType([*StructType.fromDDL(PIECE), *(docs.schema[k] for k in keep)])
    return docs.select("doc_id", F.col("markdown").cast("string").alias("markdown"), *keep).mapInArrow(cut, out)


# papers -------------------------------------------------------------------------------------------------------------

#: A text with a smaller share of its title's words is another one, one with fewer words is none; an abstract of which a text holds a smaller share is lost in it.
TITLE_SHARE, MIN_WORDS, ABSTRACT_SHARE = 0.5, 100, 0.4
FULL_TEXT, ABSTRACT_ONLY = "full text", "abstract only"
#: What every object of a paper carries.
PROPERTIES = ("title", "authors", "short_ref", "journal", "year", "pubdate", "pub_date", "link", "doi", "arxiv_id")


def text_problem(title: Column, text: Column) -> Column:
    """Why a text cannot be that of the paper with this title, or null."""
    return F.when(T.title_share(title, T.opening(text)) < TITLE_SHARE, "another text").when(T.word_count(text) < MIN_WORDS, "too short")


def without_false_dates(docs: DataFrame, slack: int = 31) -> DataFrame:
    """docs with all columns, of which `markdown` loses date lines later than `published` and the slack."""
    names = docs.columns
    text, day = names.index("markdown"), names.index("published")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = zip(batch.column(text).to_pylist(), batch.column(day).to_pylist(), strict=True)
            kept = [md if md is None or published is None else strip_false_dates(md, later_than(published, slack)) for md, published in rows]
            yield pa.RecordBatch.from_arrays([pa.array(kept, c.type) if k == text else c for k, c in enumerate(batch.columns)], names=names)

    return docs.mapInArrow(strip, docs.schema)


def paper_objects(papers: DataFrame, settings: ChunkSettings = ChunkSettings(), drop_sections: bool = True, count: Callable[[str], int] = estimate) -> DataFrame:
    """Every object of papers(doc_id, bib, abstract, markdown, published, full, and PROPERTIES): chunks of the full texts, and abstracts.

    A paper without a full text is its abstract, or its title where it has none; one whose text does not hold its abstract has that
    as well. The fingerprint is a hash of all that a paper's objects are made from: properties, abstract, text and settings. `embed` is
    the text to embed: title and headings before the content. False dates go before the text is cut. Every row is a paper.
    """
    full = F.coalesce(F.col("full"), F.lit(False)) & F.col("markdown").isNotNull()
    made_from = [*PROPERTIES, "bib", "abstract", F.when(full, F.sha2("markdown", 256)), F.lit(settings.signature()), F.lit(DROPPED.pattern if drop_sections else None)]
    mark = T.fingerprint(*(F.col(c) if isinstance(c, str) else c for c in made_from)).alias("fingerprint")
    rows = papers.select("doc_id", "bib", *PROPERTIES, F.coalesce("abstract", F.lit("")).alias("abstract"), F.when(full, F.col("markdown")).alias("markdown"), "published", full.alias("full"), mark)
    rows = without_false_dates(rows)
    own = ("bib", *PROPERTIES, "fingerprint")

    def objects(part: DataFrame, key: Column, n: Column, headers: Column, content: Column, coverage: Column) -> DataFrame:
        title = F.coalesce("title", F.lit(""))
        embed = F.concat_ws("\n", title, V.header_path(headers), F.lit(""), content)
        return part.select(key.alias("chunk_id"), n.cast("int").alias("chunk_index"), headers.alias("section_headers"), content.alias("content"), embed.alias("embed"), coverage.alias("coverage"), *own)

    lost = ~F.col("full") | ((F.col("abstract") != "") & (T.abstract_share(F.col("abstract"), F.col("markdown")) < ABSTRACT_SHARE))
    said = F.coalesce(F.nullif("abstract", F.lit("")), "title", F.lit(""))
    abstracts = objects(rows.filter(lost), F.concat("bib", F.lit("#abstract")), F.lit(0), F.array(F.lit("Abstract")), said, F.when(F.col("full"), FULL_TEXT).otherwise(ABSTRACT_ONLY))
    pieces = chunk_documents(rows.filter("full"), settings, drop_sections, own, count)
    return abstracts.unionByName(objects(pieces, T.chunk_id(F.col("bib"), F.col("chunk_index")), F.col("chunk_index"), F.col("headers"), F.col("content"), F.lit(FULL_TEXT)))


# headings -----------------------------------------------------------------------------------------------------------

#: Headings at section level although they have no number.
MATTER = ("abstract", "references", "bibliography", "acknowledgement", "acknowledgements", "acknowledgments", "appendix")
KINDS = ("title", "numbered", "front_back", "inherited", "demoted")


def heading_lines(docs: DataFrame) -> DataFrame:
    """The lines of docs(doc_id, markdown): row (an input row), doc_id, pos, line and, of headings, their text and kind."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "markdown")
    lines = rows.select("row", "doc_id", F.posexplode(F.split(F.coalesce("markdown", F.lit("")), "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("text", F.nullif(T.heading_text(F.regexp_extract("line", "^" + ATX.pattern, 2)), F.lit("")))
    matter = F.lower(F.trim(F.regexp_replace("text", ":+$", ""))).isin(*MATTER) | F.lower("text").startswith("appendix")
    first = F.row_number().over(Window.partitionBy("row", F.col("text").isNull()).orderBy("pos")) == 1
    kind = F.when(first, "title").when(~matter & T.false_heading(F.col("text")), "demoted").when(T.section_depth(F.col("text")).isNotNull(), "numbered").when(matter, "front_back").otherwise("inherited")
    return lines.withColumn("kind", F.when(F.col("text").isNotNull(), kind))


def renumber_documents(docs: DataFrame) -> DataFrame:
    """docs(doc_id, markdown) with heading levels from section numbers, and how many headings of each kind there were."""
    lines = heading_lines(docs)
    own = F.when(F.col("kind") == "numbered", F.least(T.section_depth(F.col("text")) + 1, F.lit(6)))
    last = F.coalesce(F.last(own, True).over(Window.partitionBy("row").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)), F.lit(1))
    marks = {"title": F.lit(1), "numbered": own, "front_back": F.lit(2), "inherited": F.least(last + 1, F.lit(6))}
    line = F.when(F.col("kind") == "demoted", F.concat(F.lit("**"), "text", F.lit("**")))
    for kind, level in marks.items():
        line = line.when(F.col("kind") == kind, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), T.numbered_heading(F.col("text")) if kind == "numbered" else F.col("text")))
    lines = lines.select("row", "doc_id", "pos", "kind", line.otherwise(F.col("line")).alias("line"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("markdown")
    counts = [F.count_if(F.coalesce(F.col("kind") == k, F.lit(False))).cast("int").alias(k) for k in KINDS]
    return lines.groupBy("row", "doc_id").agg(whole, *counts).drop("row")


# dates and images ---------------------------------------------------------------------------------------------------

_DATE = re.compile(r"\s*\(?\s*([A-Z][a-z]+ \d{1,2}, \d{4}|\d{1,2} [A-Z][a-z]+ \d{4})\s*\)?\s*$")


def date_of_line(line: str) -> dt.date | None:
    found = _DATE.match(line)
    for form in ("%B %d, %Y", "%d %B %Y") if found else ():
        try:
            return dt.datetime.strptime(found.group(1), form).date()
        except ValueError:
            continue
    return None


def strip_false_dates(markdown: str, rejected: Callable[[dt.date], bool]) -> str:
    """Lines before the second heading that hold nothing but a rejected date go."""
    out, headings, lines = [], 0, markdown.split("\n")
    for k, line in enumerate(lines):
        headings += bool(ATX.match(line))
        if headings == 2:
            return "\n".join(out + lines[k:])
        day = date_of_line(line)
        if not (day and rejected(day)):
            out.append(line)
    return "\n".join(out)


def later_than(published: dt.date, slack: int = 31) -> Callable[[dt.date], bool]:
    return lambda day: day > published + dt.timedelta(days=slack)


_IMAGE = re.compile(r"!\[([^\]]*)\]\(([^)\s]+)")


def images(markdown: str) -> list[dict]:
    """path, caption and section of every image outside fences, in order."""
    out: list[dict] = []
    path: tuple[tuple[int, str], ...] = ()
    for line, level, title, fenced in scan(markdown or ""):
        if level:
            path = (*(p for p in path if p[0] < level), (level, title))
        if not fenced:
            out += [{"path": p, "caption": c, "section": [t for _, t in path]} for c, p in _IMAGE.findall(line)]
    return out


def image_inventory(docs: DataFrame) -> DataFrame:
    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d, k, i["path"], i["caption"], " > ".join(i["section"])) for d, m in zip(frame["doc_id"], frame["markdown"], strict=True) for k, i in enumerate(images(m or ""))]
            yield pd.DataFrame(rows, columns=["doc_id", "pos", "path", "caption", "section"])

    return docs.select("doc_id", "markdown").mapInPandas(apply, "doc_id long, pos int, path string, caption string, section string")


def drop_false_dates(docs: DataFrame, slack: int = 31) -> DataFrame:
    """docs(doc_id, markdown, published) without date lines later than publication and the slack."""

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = zip(frame["markdown"], frame["published"], strict=True)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "markdown": [strip_false_dates(m or "", later_than(p, slack)) if p is not None else m for m, p in rows]})

    return docs.select("doc_id", "markdown", "published").mapInPandas(apply, "doc_id long, markdown string")


def header_stack(lines: DataFrame) -> DataFrame:
    """The open header of each level at every line of lines(doc_id, pos, level, text): level is null off headings.

    Declarative form of the fold: a level's header is the last heading of that level, unless a shallower one came since.
    """
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = lines
    for k in range(1, 7):
        at = F.last(F.when(F.col("level") == k, F.col("pos")), ignorenulls=True).over(w)
        text = F.last(F.when(F.col("level") == k, F.col("text")), ignorenulls=True).over(w)
        reset = F.last(F.when(F.col("level") < k, F.col("pos")), ignorenulls=True).over(w)
        out = out.withColumn(f"h{k}", F.when(reset.isNull() | (at > reset), text))
    return out
