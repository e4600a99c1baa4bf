"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Character references that are decoded without a Python function, the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
BLANKS = "[ \\t\\n\\r\\f]+"
#: Letters that have no decomposition, and what they fold to.
LETTERS = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th"), ("ø", "o"), ("ł", "l"), ("đ", "d"), ("ð", "d"), ("ı", "i"))
#: Names of look-alike characters that are folded or dropped before answers are matched, as code points.
LOOKALIKES = {0x2010: "-", 0x2011: "-", 0x2212: "-", 0x00A0: " ", 0x200B: ""}


def _accents() -> tuple[str, str]:
    """Lower-case letters below U+0250 that decompose to one ASCII letter and combining marks, and those letters."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))) for c in range(0x80, 0x250)]
    pairs = [(c, d[0]) for c, d in pairs if c.islower() and d[0].isascii() and d[0].isalpha() and all(unicodedata.combining(x) for x in d[1:]) and len(d) > 1]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


def let(value: Column, body) -> Column:
    """body of a value that is worked out once, even where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeeze(c: Column) -> Column:
    """White space collapsed to single blanks, ends trimmed."""
    return F.trim(F.regexp_replace(c, BLANKS, " "))


def unescape(c: Column) -> Column:
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def clean_text(c: Column) -> Column:
    """Tags away, common character references decoded, white space collapsed; null gives the empty text."""
    return squeeze(unescape(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", "")))


def words(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits; an empty array for a text without any."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def word_count(c: Column) -> Column:
    """Runs of characters other than white space."""
    plain = squeeze(F.coalesce(c, F.lit("")))
    return F.when(plain == "", F.lit(0)).otherwise(F.size(F.split(plain, " ")))


def title_share(title: Column, text: Column, longer_than: int = 3) -> Column:
    """Share of the title's distinct longer words that occur in the text; 1 where it has none."""
    own = F.array_distinct(F.filter(words(title), lambda w: F.length(w) > longer_than))
    return F.when(F.size(own) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(own, words(text))) / F.size(own))


def opening(markdown: Column, n: int = 8000, headings: int = 3) -> Column:
    """What a title is looked for in: the first n characters and the first headings, wherever they stand."""
    found = F.regexp_extract_all(markdown, F.lit(r"(?m)^ {0,3}#{1,6}[ \t]+(.+)$"), F.lit(1))
    return F.concat_ws("\n", F.substring(markdown, 1, n), F.array_join(F.slice(found, 1, headings), "\n"))


def run_hashes(c: Column, n: int = 5) -> Column:
    """64-bit hashes of the runs of n words, in order; no run is put together as a string.

    Two of them stand for equal runs: in 10^10 texts of 6,000 runs, each held against 250 others, about one wrong match is expected in a thousand such corpora.
    """
    none = F.array().cast("array<bigint>")

    def runs(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
        return F.when(F.size(w) >= n, each).otherwise(none)

    return let(words(c), runs)


def abstract_share(abstract: Column, text: Column, n: int = 5, within: int = 30_000) -> Column:
    """Share of the abstract's distinct n-word runs that occur in the opening of the text; 1 where it has none."""
    rest = run_hashes(F.substring(text, 1, within), n)
    own = F.array_distinct(run_hashes(abstract, n))
    return let(own, lambda o: F.when(F.size(o) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(o, rest)) / F.size(o)))


def shorten(c: Column, limit: int = 400, mark: str = " …") -> Column:
    """Texts over the limit are cut there and back to the last blank."""
    return F.when(F.length(c) > limit, F.concat(F.regexp_replace(F.substring(c, 1, limit), " [^ ]*$", ""), F.lit(mark))).otherwise(c)


#: Forms of Markdown images and links.
IMAGE = r"!\[(\\.|[^\]\\])*\]\([^)]*\)"
LINK = r"\[((\\.|[^\]\\])*)\]\([^)]*\)"


def link_text(c: Column) -> Column:
    """Markdown links reduced to their text."""
    return F.regexp_replace(c, LINK, "$1")


def snippet(c: Column, limit: int = 60) -> Column:
    """The opening of a passage on one plain line."""
    plain = squeeze(F.regexp_replace(link_text(F.regexp_replace(c, IMAGE, "")), r"(?m)^[ \t]*#+[ \t]+", ""))
    return F.when(F.length(plain) <= limit, plain).otherwise(F.concat(F.regexp_replace(F.substring(plain, 1, limit), " [^ ]*$", ""), F.lit("…")))


def tidy_markdown(c: Column, site: str) -> Column:
    """Images and empty links away, relative links made absolute, odd blanks plain, rules and surplus empty lines away."""
    c = F.regexp_replace(F.regexp_replace(c, IMAGE, ""), r"\[\]\([^)]*\)", "")
    c = F.regexp_replace(c, r"\]\((/[^) \t\n]*)", "](" + site.replace("$", "\\$") + "$1")
    c = F.translate(c, "  ", "  ")
    c = F.regexp_replace(c, r"(?m)^[ \t]*-{3,}[ \t]*$", "")
    c = F.regexp_replace(c, r"(?m)[ \t]+$", "")
    return F.regexp_replace(F.regexp_replace(c, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def normalise_url(c: Column, root: str, home: str) -> Column:
    """One spelling of an address: https, no query or fragment, no trailing slash; the root is the home page."""
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[#?].*$", ""), "/+$", ""), "^http://", "https://")
    return F.when(url == root.rstrip("/"), F.lit(home)).otherwise(url)


def slug(url: Column, root: str) -> Column:
    return F.when(url.startswith(root), F.substring(url, len(root) + 1, 1 << 20)).otherwise(url)


def clean_title(title: Column, tail: str, head: str, fallback: Column) -> Column:
    """A page's title without the site's name at either end; the fallback where nothing is left."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(F.regexp_replace(title, tail, ""), head, "")), F.lit("")), fallback)


def fold_name(c: Column) -> Column:
    """Lower case, accents and special letters folded to ASCII, everything else to single blanks."""
    c = F.lower(c)
    for letter, plain in LETTERS:
        c = F.replace(c, F.lit(letter), F.lit(plain))
    return F.trim(F.regexp_replace(F.translate(c, *_accents()), "[^a-z0-9]+", " "))


def author_key(name: Column) -> Column:
    """The folded surname: what stands before the first comma."""
    return fold_name(F.get(F.split(name, ","), F.lit(0)))


#: Words of surnames that are no key by themselves.
PARTICLES = ("van", "von", "der", "den", "de", "del", "della", "di", "da", "dos", "du", "la", "le", "el", "al", "bin", "ter", "ten", "zu", "af", "av")


def surname_keys(name: Column) -> Column:
    """Every run of consecutive words of the folded surname, without runs that are one particle, in order."""
    w = F.filter(F.split(author_key(name), " "), lambda x: x != "")
    runs = F.flatten(F.transform(w, lambda _, i: F.transform(F.sequence(F.lit(1), F.size(w) - i), lambda n: F.array_join(F.slice(w, i + 1, n), " "))))
    return F.array_distinct(F.filter(runs, lambda k: ~k.isin(*PARTICLES)))


def strip_reasoning(c: Column) -> Column:
    """Tagged reasoning away; a tag that is never closed takes all before it away too."""
    c = F.regexp_replace(c, r"(?is)<(\w+:)?think>.*?</(\w+:)?think>\s*", "")
    return F.regexp_replace(F.regexp_replace(c, r"(?is)^.*?<(\w+:)?think>", ""), r"^\s+|\s+$", "")


def short_ref(authors: Column, year: Column) -> Column:
    """Unknown, A, A & B or A et al., with the year where there is one."""
    last = F.transform(F.coalesce(authors, F.array().cast("array<string>")), lambda a: F.trim(F.get(F.split(a, ","), F.lit(0))))
    n = F.size(last)
    who = F.when(n == 0, F.lit("Unknown")).when(n == 1, F.get(last, F.lit(0))).when(n == 2, F.array_join(last, " & ")).otherwise(F.concat(F.get(last, F.lit(0)), F.lit(" et al.")))
    return F.concat(who, F.when(F.coalesce(year, F.lit("")) != "", F.concat(F.lit(" ("), year, F.lit(")"))).otherwise(F.lit("")))


def authors_line(authors: Column, key: Column, shown: int = 6, hidden_matches: int = 3) -> Column:
    """The first authors, the number of the others, and the hidden ones that match a search key."""
    rest = F.slice(authors, shown + 1, 1_000_000)
    match = F.slice(F.filter(rest, lambda a: F.concat(F.lit(" "), author_key(a), F.lit(" ")).contains(F.concat(F.lit(" "), key, F.lit(" ")))), 1, hidden_matches)
    more = F.when(F.size(authors) > shown, F.concat(F.lit("; and "), (F.size(authors) - shown).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    named = F.when((F.coalesce(key, F.lit("")) != "") & (F.size(match) > 0), F.concat(F.lit(" (including "), F.array_join(match, "; "), F.lit(")"))).otherwise(F.lit(""))
    return F.concat(F.array_join(F.slice(authors, 1, shown), "; "), more, named)


def without_title(headers: Column, title: Column, least: int = 10, most: int = 25) -> Column:
    """A section path without its first header where that opens like the title."""
    first, full = F.lower(F.get(headers, F.lit(0))), F.lower(title)
    n = F.least(F.length(first), F.length(full), F.lit(most))
    same = (n >= least) & (F.substring(first, F.lit(1), n) == F.substring(full, F.lit(1), n))
    return F.when(F.coalesce(same, F.lit(False)), F.slice(headers, 2, 1_000_000)).otherwise(headers)


def without_page_title(headers: Column, title: Column) -> Column:
    """A page's section path without its first header where that is the title."""
    same = F.lower(F.trim(F.get(headers, F.lit(0)))) == F.lower(F.trim(title))
    return F.when(F.coalesce(same, F.lit(False)), F.slice(headers, 2, 1_000_000)).otherwise(headers)


def cited(c: Column) -> Column:
    """Contents of the citation tags, in order of first use."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit("(?s)<cite>(.*?)</cite>"), F.lit(1)), lambda x: F.trim(x)))


def renumber_citations(c: Column) -> Column:
    """Citation tags replaced by [1], [2] ... in order of first use; each part of the text is read once."""
    parts = F.split(c, "(?s)<cite>|</cite>", -1)
    # odd parts lie inside tags
    return let(cited(c), lambda order: F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.concat(F.lit("["), F.array_position(order, F.trim(p)).cast("string"), F.lit("]"))).otherwise(p)), ""))


def strip_citations(c: Column) -> Column:
    return F.regexp_replace(c, "(?s)<cite>.*?</cite>", "")


def cited_numbers(marks: Column, n_docs: Column) -> Column:
    """1-based passage numbers of the citations; null for one that is not a number or out of range."""
    return F.transform(marks, lambda m: F.when(m.rlike("^[0-9]{1,9}$") & F.try_to_number(m, F.lit("999999999")).between(1, n_docs), m.cast("int")))


def heading_text(c: Column, passes: int = 3) -> Column:
    """A heading without anchor spans and emphasis around it."""
    c = F.trim(F.regexp_replace(c, "<span[^>]*></span>|<a [^>]*></a>", ""))
    for _ in range(passes):
        for mark in (r"\*\*\*", r"\*\*", r"\*", "___", "__", "_"):
            c = F.trim(F.regexp_replace(c, f"^{mark}(.+){mark}$", "$1"))
    return c


#: Forms of numbered and appendix headings.
NUMBERED = r"^([0-9]{1,2}(\.[0-9]{1,2})*)\.?[ \t]*([A-Za-zÀ-ɏ].*)$"
APPENDIX = r"^([A-Z][0-9]{0,2}(\.[0-9]{1,2})*)\.?[ \t]+([A-Za-zÀ-ɏ].*)$"


def section_depth(c: Column, deepest: int = 4, largest: int = 30) -> Column:
    """Depth of a numbered heading: the parts of its number; null where it has none or an unlikely one."""
    number, letter = F.regexp_extract(c, NUMBERED, 1), F.regexp_extract(c, APPENDIX, 1)
    depth = F.size(F.split(F.when(number != "", number).otherwise(letter), r"\."))
    ok = F.when(number != "", F.try_to_number(F.get(F.split(number, r"\."), F.lit(0)), F.lit("99")) <= largest).otherwise(letter != "")
    return F.when(ok & (depth <= deepest), depth)


def numbered_heading(c: Column) -> Column:
    """A numbered heading with one blank after its number; any other as it is."""
    spaced = F.when(c.rlike(NUMBERED), F.regexp_replace(c, NUMBERED, "$1 $3")).otherwise(F.regexp_replace(c, APPENDIX, "$1 $3"))
    return F.when(section_depth(c).isNotNull(), spaced).otherwise(c)


def false_heading(c: Column, longest: int = 120) -> Column:
    """Bullets, lead-ins, prose and lines without letters that were taken for headings."""
    return c.rlike("^[•\\-*–—]") | c.endswith(":") | (F.length(c) > longest) | ~c.rlike(r"\p{L}")


def plain_fold(c: Column) -> Column:
    """Look-alike characters folded, so that answers can be matched."""
    kept = {k: v for k, v in LOOKALIKES.items() if v}
    gone = [k for k, v in LOOKALIKES.items() if not v]
    return F.translate(c, "".join(map(chr, [*kept, *gone])), "".join(kept.values()))


def has_leftover_tag(c: Column) -> Column:
    return c.rlike("(?i)</?(cite|think|tool)[^>]*>")


def has_cjk(c: Column) -> Column:
    return c.rlike("[぀-ヿ㐀-䶿一-鿿가-힯]")


def fingerprint(*parts: Column, length: int = 20) -> Column:
    """The first hexadecimal digits of the SHA-256 of the parts; null and empty parts differ."""
    return F.substring(F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]).cast("binary"), 256), 1, length)


def chunk_id(parent: Column, n: Column) -> Column:
    return F.concat(parent, F.lit("#"), F.lpad(n.cast("string"), 4, "0"))


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Version-5 UUID of a name: SHA-1 of the namespace's bytes and the name, version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), name.cast("binary")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 8))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def strip_wrappers(c: Column) -> Column:
    """Lines that are nothing but a structural tag, and footers, away; inline graphics become image references."""
    c = F.regexp_replace(c, r"(?is)<footer\b.*?</footer>", "")
    c = F.regexp_replace(c, r"(?is)<svg\b.*?</svg>", '<img src="graphic.svg">')
    return F.regexp_replace(c, r"(?im)^[ \t]*</?(article|section|header|footer|nav)\b[^>]*>[ \t]*\n?", "")


def url_encode_form(c: Column) -> Column:
    return F.url_encode(c)


def escape_html(c: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def rot13(c: Column) -> Column:
    low = "abcdefghijklmnopqrstuvwxyz"
    turned = low[13:] + low[:13]
    return F.translate(c, low + low.upper(), turned + turned.upper())
