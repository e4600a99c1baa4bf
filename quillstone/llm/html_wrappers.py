"""HTML extraction (operator 6): a wrapper for each host by union-free regular-expression inference over its pages.

A page is cut into a nested stream of tags and texts (one pass; tags that never close get the ends that HTML implies).
The first page of a host is its first wrapper. Every further page is aligned with it, level by level: equal tags match in
order; what one side lacks becomes an optional group; a run of one or more tags that follows itself, where the pages
disagree on how often, becomes a repeated group; a text on which two pages disagree becomes a slot, and one that is the
same everywhere stays template text. Wrappers are inferred inside each partition and then merged by host in rounds
of fewer and fewer salts, one wrapper at a time, so no task holds more than the wrapper that it builds.

Every page is then matched against its host's wrapper, and the texts that are bound to slots are candidates; template
text is left out (only where at least INDEPENDENT different pages agree on it; headings always stay, and paragraphs, list items and
cells inside an article too). Of the candidates
those in <article> or <main> are the main text. A page without any takes those in the host's main group, the deepest
wrapper group that holds MOST of the slot characters (outside links) of the host's pages of that kind, so a menu and an
article in the same tags are told apart by what varies. A page without text there takes its own such group. A text that
the wrapper does not know counts as a slot. Groups that HTML itself names as menus, headers, footers, asides or forms, and
hidden ones, are never main text, but a form that stands around an article or around most of a page is no such form. Groups whose
class, id or role names them so (see `marked`) neither, unless they hold nearly all slot characters of the host; a compound
whose last word only may name one (market-share) does so where the group holds no prose (see `_prose`).

Bounds: beyond MOST_NODES a wrapper drops the optional groups of the fewest pages. Their texts are slots then, like any that a
wrapper does not know, and lie in the main group if what holds them does.

Defined results: null and empty pages have no text; a null url has the host ''; repeated rows are read each by itself; an
unclosed comment, script or style reaches to the end of the page, an unclosed quote in a tag to its first '>'; an empty
table gives no rows; further columns are ignored. Time and memory are linear in a page, whatever its depth or width.
"""

from __future__ import annotations

import html as html_lib
import json
import re
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import materialise, slices

ROUNDS = (1024, 32, 1)
SALTS = 32
MOST = 0.6
LEAST = 0.1
INDEPENDENT = 5
LONG_RUN = 16
PERIOD = 8
SKETCH = 64
PROSE = 60
MOST_NODES = 50_000
FLUSH_NODES = 400_000
BROADCAST_BYTES = 16 << 20

#: Fixed values of HTML: elements without content, inline elements, elements whose content is no text, which open elements a start tag ends.
VOID = frozenset("area base col embed hr img input link meta source track".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg title".split())
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}} | {
    t: {"p"} for t in "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()
}
LIMITS = frozenset("html body article section main div table td th ul ol dl blockquote nav header footer aside form".split())
PARAGRAPHS = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 tr td th pre blockquote figcaption caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PLAIN = frozenset("html body head main article".split())
#: Fixed values of HTML: elements that are no main text by their meaning.
SKIP_TAGS = frozenset("nav header footer aside form head button select option dialog menu object canvas".split()) | RAW
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words that name a group when they are a whole class or id, or the last word of one.
SKIP_HEADS = frozenset(
    "ad ads advert adverts advertisement advertisements banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus footer header login masthead menu modal nav navbar navigation newsletter notice notices pagination paywall popup promo promos reactions related replies respond search share sharing sidebar signup social sponsor sponsored sponsors subscribe toolbar widget widgets".split()
)
#: Words that name a group where a class or id begins with them.
SKIP_FIRST = frozenset("advert breadcrumb breadcrumbs comment comments disqus gdpr nav navbar newsletter pagination paywall sidebar sponsor sponsored".split())
#: Of these words those that name a group in any compound; a compound with another (market-share, drug-reactions) does so only if the group holds no prose.
STRONG = frozenset(
    "advert adverts advertisement advertisements breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus footer gdpr newsletter notice notices pagination paywall replies respond sidebar sponsor sponsored sponsors".split()
)
#: Pairs of a first and a last word that name a group.
SKIP_PAIRS = {
    **dict.fromkeys(("related", "recommended", "popular"), frozenset("articles content items links news pages posts stories".split())),
    **dict.fromkeys(("social", "share", "sharing"), frozenset("bar buttons icons links media tools".split())),
}
_START = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r">|=\s*[\"']")
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"\shidden(?=[\s=/>])|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORD = re.compile(r"[a-z]+")
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in RAW}


def marked(value: str) -> str:
    """'!' if a class or id (one token) names a menu, advert, comment or the like, '^' if it may do so, else ''."""
    words = _WORD.findall(_CAMEL.sub(" ", value).lower())
    if not words:
        return ""
    if words[-1] in SKIP_PAIRS.get(words[0], ()):
        return "!"
    told = {words[-1]} & SKIP_HEADS | {words[0]} & SKIP_FIRST
    return "" if not told else "!" if told & STRONG or all(w in SKIP_HEADS or w in SKIP_FIRST for w in words) else "^"


class Item:
    """A part of a wrapper or page: a tag, a text ('#') or a group of tags that repeats together (key starts with \\x1e)."""

    __slots__ = ("key", "how", "pages", "seqs", "text", "link", "chars", "out", "prose", "bound", "keys", "singles", "groups", "template", "root")

    def __init__(self, key: str, how: str = "", pages: int = 1):
        self.key, self.how, self.pages = key, how, pages
        self.seqs: list[list[Item]] = []
        self.text = self.bound = self.keys = None
        self.link = self.chars = self.out = self.prose = 0
        self.template = self.root = False

    @property
    def kids(self) -> list[Item]:
        return self.seqs[0] if self.seqs else []


def tag_name(key: str) -> str:
    return key.partition(" ")[0].rstrip("!~^")


def skipped(key: str, words: bool = True) -> bool:
    """Furniture: by tag or role or as hidden ('~'), or by its words ('!'). What may be furniture ('^') is told by its content, see `_prose`."""
    name = key.partition(" ")[0]
    return name.endswith("~") or (words and name.endswith("!"))


_KEYS: dict[str, str] = {}


def key_of(tag: str, name: str) -> str:
    """The name, '~' for furniture by meaning, '!' by words, '^' for forms and doubtful words, and the class, id and role words that pages share (no digits)."""
    key = _KEYS.get(tag)
    if key is not None:
        return key
    found = [(k.lower(), a or b or c) for k, a, b, c in _ATTRIBUTE.findall(tag)] if "=" in tag else []
    by_meaning = (name in SKIP_TAGS and name != "form") or (" " in tag and bool(_HIDDEN.search(tag))) or any(k == "role" and v.lower() in SKIP_ROLES for k, v in found)
    words = {marked(t) for k, v in found if k != "role" for t in v.split()} if name not in HEADINGS and name not in ("html", "body", "main") else set()
    mark = "~" if by_meaning else "!" if "!" in words else "^" if "^" in words or name == "form" else ""
    shared = () if name in PLAIN else sorted({f"{k}={t}" for k, v in found for t in v.split() if not any(c.isdigit() for c in t)})
    rest = " ".join(shared)
    if len(rest) > 200:
        rest = f"{zlib.crc32(rest.encode('utf-8', 'replace'))}"
    key = name + mark + (" " + rest if rest else "")
    if len(_KEYS) < 20_000 and len(tag) < 500:
        _KEYS[tag] = key
    return key


def parse(page: str) -> Item:
    """The page as a tree of tags and texts; iterative, one pass."""
    top = Item("")
    kids: list[Item] = []
    top.seqs.append(kids)
    stack: list[tuple[str, list[Item]]] = [("", kids)]
    places: dict[str, list[int]] = defaultdict(list)
    limits = [0]
    pieces: list[str] = []
    link = [0]
    in_link = broken = False
    last = page.rfind(">")

    def flush() -> None:
        if pieces:
            text = " ".join(html_lib.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                item = Item("#")
                item.text, item.link, item.chars = text, min(link[0], len(text)), len(text)
                stack[-1][1].append(item)
        link[0] = 0

    def close_to(depth: int) -> None:
        flush()
        while len(stack) > depth:
            name, _ = stack.pop()
            places[name].pop()
            if limits[-1] == len(stack):
                limits.pop()

    i, n = 0, len(page)
    while i < n:
        j = page.find("<", i)
        over = j < 0 or j > last  # no tag can end any more, but a comment may open
        if over:
            j = page.find("<!--", i)
            j = n if j < 0 else j
        if j > i:
            pieces.append(page[i:j])
            if in_link:
                link[0] += j - i
        if over:
            break
        m = _START.match(page, j)
        if not m:
            if page.startswith("<!--", j):
                k = page.find("-->", j + 4)
                i = n if k < 0 else k + 3
            elif page[j + 1] in "!?/":
                i = page.find(">", j) + 1
            else:
                pieces.append("<")
                i = j + 1
            continue
        end = m.end()
        while not broken:
            stop = _STOP.search(page, end)
            if stop and stop.group() == ">":
                end = stop.start()
                break
            end = page.find(stop.group()[-1], stop.end()) + 1 if stop else 0
            broken = not end
        if broken:
            end = page.find(">", m.end())
        tag, name, i = page[j : end + 1], m.group(2).lower(), end + 1
        if name in RAW:
            if not m.group(1) and not (name == "svg" and tag.endswith("/>")):
                close = _CLOSE[name].search(page, i)
                i = close.end() if close else n
            continue
        if name in INLINE:
            if name == "a":
                in_link = not m.group(1)
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if m.group(1):
            if places.get(name):
                close_to(places[name][-1])
            elif name == "p":
                flush()
            continue
        ends = ENDS.get(name, ())
        while (at := max((places[e][-1] for e in ends if places.get(e)), default=0)) and at >= limits[-1]:
            close_to(at)
        flush()
        if name in VOID:
            continue
        item = Item(key_of(tag, name))
        kids = []
        item.seqs.append(kids)
        stack[-1][1].append(item)
        if name in LIMITS:
            limits.append(len(stack))
        places[name].append(len(stack))
        stack.append((name, kids))
    flush()
    return top


# alignment ---------------------------------------------------------------------------------------------------------


def _how(*hows: str) -> str:
    plus, maybe = any(h in ("+", "*") for h in hows), any(h in ("?", "*") for h in hows)
    return "*" if plus and maybe else "+" if plus else "?" if maybe else ""


def pairs(a: list[str], b: list[str]) -> Iterator[tuple[int, int]]:
    """Places of both sides in order, -1 where one lacks the other's; after a mismatch the nearer place of agreement is taken."""
    i = j = 0
    where: tuple[dict, dict] | None = None
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            yield i, j
            i, j = i + 1, j + 1
            continue
        if where is None:
            where = defaultdict(list), defaultdict(list)
            for side, keys in zip(where, (a, b), strict=True):
                for k, key in enumerate(keys):
                    side[key].append(k)
        in_a, in_b = where[0].get(b[j], ()), where[1].get(a[i], ())
        p, q = bisect_left(in_a, i), bisect_left(in_b, j)
        skip_a = in_a[p] - i if p < len(in_a) else len(a) + len(b)
        skip_b = in_b[q] - j if q < len(in_b) else len(a) + len(b)
        if skip_a == skip_b == len(a) + len(b):
            yield i, -1
            yield -1, j
            i, j = i + 1, j + 1
        elif skip_a <= skip_b:
            for k in range(i, i + skip_a):
                yield k, -1
            i += skip_a
        else:
            for k in range(j, j + skip_b):
                yield -1, k
            j += skip_b
    for k in range(i, len(a)):
        yield k, -1
    for k in range(j, len(b)):
        yield -1, k


def _period(key: str) -> list[str]:
    return key[1:].split("\x1f")


def _repeats(items: list[Item]) -> tuple[set[str], dict[str, list[str]]]:
    """(keys that repeat alone, periods by key of the groups that repeat together) of a level."""
    singles = {x.key for x in items if x.how in ("+", "*") and x.key[0] != "\x1e"}
    return singles, {x.key: _period(x.key) for x in items if x.key[0] == "\x1e"}


def _absorb(x: Item, y: Item, most: int, again: bool = False) -> None:
    """y becomes part of x; again: both stand on the same pages."""
    if again:
        x.how = "*" if x.how in ("?", "*") and y.how in ("?", "*") else "+"
    else:
        x.how = _how(x.how, y.how)
    x.pages = max(x.pages, y.pages) if again else min(most, x.pages + y.pages)
    x.seqs += y.seqs
    if x.key == "#":
        if x.text != y.text:
            x.text = None
        x.link, x.chars, x.out = x.link + y.link, x.chars + y.chars, x.out + y.out


def _units(items: list[Item], singles: set[str], groups: dict[str, list[str]]) -> list[Item]:
    """The level with its runs of repeating keys and periods put together."""
    out: list[Item] = []
    for x in items:
        if out and x.key in singles and out[-1].key == x.key:
            _absorb(out[-1], x, x.pages, True)
        else:
            out.append(x)
    if not groups:
        return out
    heads = defaultdict(list)
    for key, period in groups.items():
        heads[period[0]].append((len(period), key, period))
    items, out, i = out, [], 0
    keys = [x.key for x in items]
    while i < len(items):
        hit = next(((size, key) for size, key, period in sorted(heads.get(keys[i], ()), reverse=True) if keys[i : i + size] == period), None)
        if hit:
            unit = Item(hit[1], "", max(x.pages for x in items[i : i + hit[0]]))
            unit.seqs.append(items[i : i + hit[0]])
            i += hit[0]
        else:
            unit = items[i]
            i += 1
        if out and unit.key == out[-1].key and unit.key[0:1] == "\x1e":
            _absorb(out[-1], unit, unit.pages, True)
        else:
            out.append(unit)
    return out


def _fold(items: list[Item]) -> list[Item]:
    """Neighbours that repeat, where pages disagree on how often (one is optional) or the run is long, become repeated groups."""
    if len(items) < LONG_RUN and not any(x.how for x in items):
        return items
    out: list[Item] = []
    i = 0
    while i < len(items):
        j = i + 1
        while j < len(items) and items[j].key == items[i].key:
            j += 1
        run = items[i:j]
        if len(run) >= LONG_RUN or (len(run) > 1 and any(x.how for x in run)):
            always = any(x.how in ("", "+") for x in run)
            for x in run[1:]:
                _absorb(run[0], x, x.pages, True)
            run[0].how = "+" if always else "*"
            out.append(run[0])
        else:
            out += run
        i = j
    for size in range(2, PERIOD + 1):
        keys = [x.key for x in out]
        if len(keys) < 2 * size:
            break
        items, out, i = out, [], 0
        while i < len(items):
            times = 1
            if i + size < len(keys) and keys[i] == keys[i + size] and not any(k[0] == "\x1e" for k in keys[i : i + size]):
                period = keys[i : i + size]
                while keys[i + times * size : i + (times + 1) * size] == period:
                    times += 1
            span = items[i : i + times * size]
            if times > 1 and (times >= LONG_RUN or any(x.how in ("?", "*") for x in span)):
                never = all(x.how in ("?", "*") for x in span)
                group = Item("\x1e" + "\x1f".join(period), "*" if never else "+", max(x.pages for x in span))
                for x in span:
                    x.how = {"?": "", "*": "+"}.get(x.how, x.how)
                group.seqs = [span[k : k + size] for k in range(0, len(span), size)]
                out.append(group)
                i += times * size
            else:
                out.append(items[i])
                i += 1
    return out


def _merge_level(a: list[Item], b: list[Item], most: int) -> list[Item]:
    keys_a, keys_b = [x.key for x in a], [x.key for x in b]
    if keys_a == keys_b:
        for x, y in zip(a, b, strict=True):
            _absorb(x, y, most)
        return a
    singles, groups = _repeats(a + b)
    if singles or groups:
        a, b = _units(a, singles, groups), _units(b, singles, groups)
        keys_a, keys_b = [x.key for x in a], [x.key for x in b]
    out: list[Item] = []
    for i, j in pairs(keys_a, keys_b):
        x = a[i] if i >= 0 else b[j]
        if i >= 0 and j >= 0:
            _absorb(x, b[j], most)
        else:
            x.how = _how(x.how, "?")
        out.append(x)
    return _fold(out)


def settle(top: Item, everything: bool = False) -> Item:
    """Merge every item's pending levels into one, from the top down; iterative. everything: fold long runs of all levels too."""
    todo = [top]
    while todo:
        x = todo.pop()
        if len(x.seqs) > 1:
            level = x.seqs[0]
            for other in x.seqs[1:]:
                level = _merge_level(level, other, x.pages)
            x.seqs = [level]
        if x.seqs:
            if everything:
                x.seqs[0] = _fold(x.seqs[0])
            todo += [k for k in x.seqs[0] if len(k.seqs) > 1 or (everything and k.seqs)]
    return top


def merge(a: Item, b: Item) -> Item:
    """The wrapper of both sides' pages; uses up both."""
    _absorb(a, b, a.pages + b.pages)
    a.text = sorted({*a.text, *b.text})[:SKETCH]
    a.prose, a.out = a.prose + b.prose, a.out + b.out
    return settle(a)


def _walk(top: Item) -> Iterator[tuple[int, Item]]:
    """(depth, item) in order, without the top."""
    todo = [(0, x) for x in reversed(top.kids)]
    while todo:
        depth, x = todo.pop()
        yield depth, x
        todo += [(depth + 1, k) for k in reversed(x.kids)]


def bounded(top: Item, most: int = MOST_NODES) -> Item:
    """The wrapper without the optional groups of the fewest pages, as far as it has more than `most` items."""
    least = 1
    while sum(1 for _ in _walk(top)) > most:
        todo, gone = [top], 0
        while todo:
            x = todo.pop()
            for level in x.seqs:
                kept = [k for k in level if not (k.how in ("?", "*") and k.pages <= least)]
                gone += len(level) - len(kept)
                level[:] = kept
                todo += [k for k in level if k.key != "#"]
        if not gone and least >= top.pages:
            break
        least *= 2
    return top


def _text_hash(text: str) -> int:
    raw = text.encode("utf-8", "replace")
    return zlib.crc32(raw) | (len(raw) & 0xFFFFF) << 32


def as_wrapper(page: Item) -> Item:
    """A parsed page as a wrapper of its own: texts are hashed, and the top keeps a sketch of its long texts."""
    sketch, texts = set(), list(_texts(page))
    inside = any(ok and article for ok, article, *_ in texts)
    for ok, *_, x in texts:
        h = _text_hash(x.text)
        if ok and x.chars >= PROSE:
            page.prose += 1
            sketch.add(h & 0xFFFFFFFF)
        x.out = 0 if inside else max(0, x.chars - x.link)
        x.text = h
    page.text, page.out = sorted(sketch)[:SKETCH], int(not inside)
    return settle(page, True)


def _prose(page: Item) -> set[int]:
    """Of the groups of a page that may be furniture (by id) those that are main text by what they hold.

    A group of doubtful words is if it holds a text of PROSE characters outside links; a form is if it stands around an article, or around
    MOST of the page's characters, as on sites that put every page into one form.
    """
    order: list[tuple[Item, int]] = [(page, -1)]
    doubt = False
    for n, (x, _) in enumerate(order):  # grows as it goes
        doubt = doubt or x.key.partition(" ")[0].endswith("^")
        order += [(k, n) for k in x.kids]
    if not doubt:
        return set()
    mass, longest, article = ([0] * len(order) for _ in range(3))
    for n in range(len(order) - 1, -1, -1):
        x, up = order[n]
        if x.key == "#":
            mass[n] = longest[n] = max(0, x.chars - x.link)
        article[n] |= tag_name(x.key) in ("article", "main")
        if up >= 0 and not skipped(x.key):
            mass[up] += mass[n]
            longest[up] = max(longest[up], longest[n])
            article[up] |= article[n]
    out = set()
    for n, (x, _) in enumerate(order):
        if x.key.partition(" ")[0].endswith("^"):
            holds = article[n] or mass[n] >= MOST * mass[0] if tag_name(x.key) == "form" else article[n] or longest[n] >= PROSE
            if holds and mass[n]:
                out.add(id(x))
    return out


def _texts(page: Item, words: bool = True) -> Iterator[tuple[bool, bool, bool, Item]]:
    """(not in furniture, in an article, in the host's main group, text) of the texts of a page, in order."""
    prose = _prose(page)
    todo: list[tuple[Item, bool, bool, bool]] = [(x, True, False, page.root) for x in reversed(page.kids)]
    while todo:
        x, ok, article, root = todo.pop()
        root = x.bound.root if x.bound else root
        if x.key == "#":
            yield ok, article, root, x
            continue
        ok = ok and not skipped(x.key, words) and (not x.key.partition(" ")[0].endswith("^") or id(x) in prose)
        article = article or tag_name(x.key) in ("article", "main")
        todo += [(k, ok, article, root) for k in reversed(x.kids)]


def dump(top: Item) -> str:
    rows = [[d, x.key, x.how, x.pages, *((x.text, x.link, x.chars, x.out) if x.key == "#" else ())] for d, x in _walk(top)]
    return json.dumps([[top.pages, top.prose, top.out, top.text], *rows], separators=(",", ":"))


def load(text: str) -> Item:
    (pages, prose, out, sketch), *rows = json.loads(text)
    top = Item("", "", pages)
    top.prose, top.out, top.text = prose, out, sketch
    top.seqs.append([])
    line = [top]
    for depth, key, how, pages, *more in rows:
        x = Item(key, how, pages)
        if more:
            x.text, x.link, x.chars, x.out = more
        else:
            x.seqs.append([])
        del line[depth + 1 :]
        line[depth].seqs[0].append(x)
        line.append(x)
    return top


def expression(top: Item) -> str:
    """The wrapper as a union-free regular expression over tags, template text (as its hash) and #PCDATA."""
    out: list[str] = []
    todo: list[Item | str] = list(reversed(top.kids))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.key == "#":
            out.append(("#PCDATA" if x.text is None else f"'{x.text}'") + x.how)
        elif x.key[0] == "\x1e":
            out.append("(")
            todo += [")" + x.how, *reversed(x.kids)]
        else:
            out.append(f"(<{x.key}>")
            todo += [f"</{tag_name(x.key)}>)" + x.how, *reversed(x.kids)]
    return " ".join(out)


# main text ---------------------------------------------------------------------------------------------------------


def plan(top: Item) -> str:
    """What reading needs of a wrapper: per item its depth, key, how and a mark: 1 template, 2 in the host's main group."""
    distinct = len(top.text) if len(top.text) < SKETCH else (SKETCH - 1) / (top.text[-1] / 2**32)
    independent = top.pages * min(1.0, distinct / top.prose) if top.prose else 0
    items = list(_walk(top))
    n_items = len(items)
    up, end, line = [-1] * n_items, [n_items] * n_items, []
    for n, (depth, _) in enumerate(items):
        for k in line[depth:]:
            end[k] = n
        del line[depth:]
        up[n] = line[-1] if line else -1
        line.append(n)
    name, ok, by_words, template, inside = [""] * n_items, [True] * n_items, [False] * n_items, [False] * n_items, [False] * n_items
    for n, (_, x) in enumerate(items):
        above = up[n]
        group = x.key[0] == "\x1e"
        if above >= 0:
            name[n], ok[n], by_words[n], inside[n] = name[above], ok[above], by_words[above], inside[above]
        if x.key == "#":
            template[n] = x.text is not None and x.pages >= INDEPENDENT <= independent and name[n] not in (PARAGRAPHS if inside[n] else HEADINGS)
        elif not group:
            label = x.key.partition(" ")[0]
            name[n], ok[n], by_words[n] = tag_name(x.key), ok[n] and not label.endswith("~"), by_words[n] or label.endswith("!")
            inside[n] = inside[n] or name[n] in ("article", "main")
    # characters of slots outside links, of pages without an article; groups marked by words count only where little else is left
    mass = [x.out if x.key == "#" and ok[n] and not template[n] else 0 for n, (_, x) in enumerate(items)]
    plain = sum(m for m, w in zip(mass, by_words, strict=True) if not w)
    words = plain >= LEAST * sum(mass)
    if words:
        mass = [0 if w else m for m, w in zip(mass, by_words, strict=True)]
    whole = sum(mass)
    for n in range(n_items - 1, -1, -1):
        if up[n] >= 0:
            mass[up[n]] += mass[n]
    lo, hi = 0, n_items if whole else 0
    at = lo
    while at < hi:
        x = items[at][1]
        if mass[at] >= MOST * whole and x.how in ("", "?") and x.key != "#" and x.key[0] != "\x1e" and name[at] not in PARAGRAPHS:
            lo, hi = at + 1, end[at]
            at = lo
        else:
            at = end[at]
    rows = [[d, x.key, x.how, template[n] + 2 * (lo - 1 <= n < hi)] for n, (d, x) in enumerate(items)]
    return json.dumps([[words, whole > 0 and lo == 0], *rows], separators=(",", ":"))


def read_plan(text: str | None) -> tuple[bool, Item]:
    (words, root), *rows = json.loads(text or "[[true, false]]")
    top = Item("")
    top.root = root
    top.seqs.append([])
    line, groups = [top], [top]
    for depth, key, how, mark in rows:
        x = Item(key, how)
        x.template, x.root = bool(mark & 1), bool(mark & 2)
        x.seqs.append([])
        del line[depth + 1 :]
        line[depth].seqs[0].append(x)
        line.append(x)
        groups.append(x)
    for x in groups:
        x.keys = [k.key for k in x.kids]
        x.singles, x.groups = _repeats(x.kids)
    return words, top


def bind(wrapper: Item, page: Item) -> None:
    """Match a page with the wrapper: every text that has a place in it is bound to it."""
    page.root = wrapper.root
    todo = [(wrapper, page.kids)]
    while todo:
        w, kids = todo.pop()
        keys = [x.key for x in kids]
        if keys == w.keys:
            matched = zip(w.kids, ([x] for x in kids), strict=True)
        else:
            runs: list[tuple[str, list]] = []
            for x in kids:
                if runs and x.key in w.singles and runs[-1][0] == x.key:
                    runs[-1][1].append(x)
                else:
                    runs.append((x.key, [x]))
            if w.groups:
                keys, units, i = [k for k, _ in runs], [], 0
                heads = sorted(((len(p), g, p) for g, p in w.groups.items()), reverse=True)
                while i < len(runs):
                    hit = next(((n, g) for n, g, p in heads if keys[i : i + n] == p), None)
                    if hit:
                        part = [x for _, run in runs[i : i + hit[0]] for x in run]
                        if units and units[-1][0] == hit[1]:
                            units[-1][1].append(part)
                        else:
                            units.append((hit[1], [part]))
                        i += hit[0]
                    else:
                        units.append(runs[i])
                        i += 1
                runs = units
            matched = [(w.kids[i], runs[j][1]) for i, j in pairs(w.keys, [k for k, _ in runs]) if i >= 0 and j >= 0]
        for place, found in matched:
            for x in found:
                if isinstance(x, list):
                    todo.append((place, x))
                    continue
                x.bound = place
                if x.key != "#":
                    todo.append((place, x.kids))


def _own_group(page: Item, chosen: set[int]) -> set[int]:
    """Of the chosen texts (by id) those in the deepest group of equal paths that holds MOST of their characters."""
    order: list[tuple[Item, int]] = []
    todo = [(x, -1) for x in page.kids]
    while todo:
        x, up = todo.pop()
        order.append((x, up))
        todo += [(k, len(order) - 1) for k in x.kids]
    mass = [0] * len(order)
    for plain in (True, False):
        for n, (x, _) in enumerate(order):
            mass[n] = (max(0, x.chars - x.link) if plain else x.chars) if id(x) in chosen else 0
        if any(mass):
            break
    for n in range(len(order) - 1, -1, -1):
        if order[n][1] >= 0:
            mass[order[n][1]] += mass[n]
    kids: dict[int, list[int]] = defaultdict(list)
    for n, (_, up) in enumerate(order):
        kids[up].append(n)
    group, whole = [-1], sum(mass[n] for n in kids[-1])
    while True:
        share: dict[str, list[int]] = defaultdict(list)
        for g in group:
            for n in kids[g]:
                if order[n][0].key != "#" and mass[n]:
                    share[order[n][0].key].append(n)
        best = max(share, key=lambda k: sum(mass[n] for n in share[k]), default=None)
        if best is None or tag_name(best) in PARAGRAPHS or len(share[best]) > len(group) or sum(mass[n] for n in share[best]) < MOST * whole:
            break
        group = share[best]
    inside, todo = set(), list(group)
    while todo:
        n = todo.pop()
        if n >= 0:
            inside.add(id(order[n][0]))
        todo += kids[n]
    return inside & chosen


def main_text(page: str, wrapper: tuple[bool, Item]) -> str:
    """The main text of a page by its host's wrapper."""
    words, top = wrapper
    tree = parse(page)
    bind(top, tree)
    texts = list(_texts(tree, words))
    slots = [(article, root, x) for ok, article, root, x in texts if ok and not (x.bound and x.bound.template)]
    found = [x for article, _, x in slots if article] or [x for _, root, x in slots if root] or [x for ok, article, _, x in texts if ok and article]
    if not found:
        own = _own_group(tree, {id(x) for *_, x in slots})
        found = [x for *_, x in slots if id(x) in own]
    return "\n\n".join(x.text for x in found)


def _host() -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), "://([^/?#]*)", 1))


def _pages(pages: DataFrame) -> DataFrame:
    return pages.select(_host().alias("host"), F.col("html").cast("string").alias("html"))


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split(" ")[0] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n in ("page_id", "n_chars") else pa.string()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (see dump) of every host."""
    kind = "host string, wrapper string"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Item] = {}
        nodes = lambda top: 32 + sum(1 for _ in _walk(top))
        size = 0  # of all wrappers, at most
        for whole in batches:
            for batch in slices(whole, "html"):
                for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    new = as_wrapper(parse(page or ""))
                    size += nodes(new)
                    known[host] = merge(known[host], new) if host in known else new
                    if size > FLUSH_NODES:
                        size = sum(nodes(bounded(w)) for w in known.values())
                        if size > FLUSH_NODES // 2:
                            yield _batch(kind, [(h, dump(w)) for h, w in known.items()])
                            known, size = {}, 0
        if known:
            yield _batch(kind, [(h, dump(bounded(w))) for h, w in known.items()])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One wrapper of each run of rows of a host, which stand together."""
        at, held = None, None
        for batch in batches:
            for host, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held is not None and host == at:
                    held = bounded(merge(held, load(text)))
                else:
                    if held is not None:
                        yield _batch(kind, [(at, dump(held))])
                    at, held = host, load(text)
        if held is not None:
            yield _batch(kind, [(at, dump(held))])

    out = _pages(pages).mapInArrow(local, kind)
    for salts in ROUNDS:
        salted = out.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts)))
        out = salted.repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper").select("host", "wrapper").mapInArrow(joined, kind)
    return out


def wrapper_plans(pages: DataFrame) -> DataFrame:
    """host, plan (see plan) of every host; written to the shared folder."""

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _batch("host string, plan string", [(h, plan(load(w))) for h, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)])

    return materialise(infer_wrappers(pages).mapInArrow(planned, "host string, plan string"), "wrappers")


def _reader(plans: dict[str, str] | None) -> Callable:
    """A reader of (page_id, url, html, host, plan) batches; a plan comes from the dict, or in a row of its own before its pages."""
    kind = "page_id long, url string, text string, n_chars long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[bool, Item]] = {}
        for whole in batches:
            for batch in slices(whole, "html"):
                rows = []
                for page_id, url, page, host, text in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                    if text is not None:
                        held = {host: read_plan(text)}
                        continue
                    if host not in held:
                        if len(held) >= 256 or plans is None:
                            held.clear()
                        held[host] = read_plan(plans.get(host) if plans is not None else None)
                    text = main_text(page or "", held[host])
                    rows.append((page_id, url, text, len(text)))
                if rows:
                    yield _batch(kind, rows)

    return read


def extract_main(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text, n_chars of every page. Plans of more than broadcast_bytes meet their pages by a shuffle instead."""
    kind = "page_id long, url string, text string, n_chars long"
    plans = wrapper_plans(pages)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), _host().alias("host"))
    rows = rows.withColumn("plan", F.lit(None).cast("string"))
    size = plans.agg(F.sum(F.octet_length("plan") + F.octet_length("host") + 64)).first()[0] or 0
    if size <= broadcast_bytes:
        return rows.mapInArrow(_reader({r["host"]: r["plan"] for r in plans.collect()}), kind)
    # pages of a host are dealt to SALTS runs; a run starts with the plan
    deal = F.pmod(F.xxhash64("url", "page_id"), F.lit(SALTS))
    first = plans.select(F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "host", "plan", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("deal"))
    both = rows.withColumn("deal", deal.cast("long")).unionByName(first).repartition("host", "deal").sortWithinPartitions("host", "deal", F.col("plan").isNull())
    return both.select("page_id", "url", "html", "host", "plan").mapInArrow(_reader(None), kind)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main(spark.read.parquet(f"{sf_dir}/pages.parquet"))
