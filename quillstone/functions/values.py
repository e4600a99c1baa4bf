"""Dates, numbers, arrays, maps and JSON as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def display_date(pubdate: Column, year: Column) -> Column:
    """YYYY-MM, or the year where the month is 00 or the date does not parse."""
    y, m = F.regexp_extract(pubdate, r"^(\d{4})-(\d{2})", 1), F.regexp_extract(pubdate, r"^(\d{4})-(\d{2})", 2)
    return F.when(F.coalesce(y, F.lit("")) == "", year).when(m == "00", y).otherwise(F.concat(y, F.lit("-"), m))


def iso_timestamp(c: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00"))


def site_date(c: Column) -> Column:
    """The day after 'last updated on', as an ISO date; the empty text where there is none."""
    day = F.regexp_extract(c, r"(?i)last updated on\s+(\d{1,2}\s+\w+\s+\d{4})", 1)
    day = F.regexp_replace(day, r"\s+", " ")
    parsed = F.coalesce(F.try_to_date(day, "d MMMM yyyy"), F.try_to_date(day, "d MMM yyyy"))
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), F.lit(""))


def date_line(c: Column) -> Column:
    """The date of a line that holds nothing else, such as (June 21, 2026) or 21 June 2026; else null."""
    inner = F.regexp_extract(c, r"^\s*\(?\s*([A-Z][a-z]+ \d{1,2}, \d{4}|\d{1,2} [A-Z][a-z]+ \d{4})\s*\)?\s*$", 1)
    return F.coalesce(F.try_to_date(inner, "MMMM d, yyyy"), F.try_to_date(inner, "d MMMM yyyy"))


def year_of(c: Column) -> Column:
    return F.substring(F.trim(c.cast("string")), 1, 4).try_cast("int")


def stamp(c: Column) -> Column:
    """A timestamp as UTC text to the second."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def retry_after(header: Column, attempt: Column, most: int = 120, step: int = 10) -> Column:
    """Seconds to wait: the server's wish up to a limit, else a step for each attempt."""
    wish = header.try_cast("int")
    return F.when(wish.isNotNull(), F.least(wish, F.lit(most))).otherwise(attempt * step)


def token_estimate(c: Column, chars: float = 2.5) -> Column:
    return F.floor(F.length(c) / F.lit(chars)).cast("int") + 1


def unit(v: Column) -> Column:
    """A vector divided by its length; a zero vector as it is."""
    from quillstone.functions.text import let

    def divided(both: Column) -> Column:
        return F.transform(both["v"], lambda x: F.when(both["n"] == 0, x.cast("double")).otherwise(x.cast("double") / both["n"]))

    return let(v, lambda u: let(F.struct(u.alias("v"), F.sqrt(F.aggregate(u, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("n")), divided))


def dot(a: Column, b: Column) -> Column:
    """The dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def to_hms(degrees: Column, decimals: int = 2) -> Column:
    """Right ascension in hours, minutes and seconds; seconds that round to 60 carry over."""
    return _sexagesimal(F.pmod(degrees, F.lit(360.0)) / 15, decimals, F.lit(""))


def to_dms(degrees: Column, decimals: int = 1) -> Column:
    """Signed degrees, minutes and seconds."""
    return _sexagesimal(F.abs(degrees), decimals, F.when(degrees < 0, F.lit("-")).otherwise(F.lit("+")))


def _sexagesimal(x: Column, decimals: int, sign: Column) -> Column:
    scale = 10**decimals
    total = F.floor(x * 3600 * scale + 0.5).cast("long")
    whole, part = F.expr("0").cast("long") + F.floor(total / scale), F.pmod(total, F.lit(scale))
    text = [F.lpad(v.cast("string"), 2, "0") for v in (F.floor(whole / 3600), F.pmod(F.floor(whole / 60), F.lit(60)), F.pmod(whole, F.lit(60)))]
    fraction = F.concat(F.lit("."), F.lpad(part.cast("string"), decimals, "0")) if decimals else F.lit("")
    return F.concat(sign, text[0], F.lit(":"), text[1], F.lit(":"), text[2], fraction)


SEXAGESIMAL = r"^\s*([+-]?)(\d{1,3})[:\sd°]+(\d{1,2})[:\sm']+(\d{1,2}(?:\.\d+)?)"


def from_dms(c: Column) -> Column:
    """Degrees of a sexagesimal text; null where it does not match."""
    part = lambda i: F.regexp_extract(c, SEXAGESIMAL, i)
    value = part(2).try_cast("double") + part(3).try_cast("double") / 60 + part(4).try_cast("double") / 3600
    return F.when(part(2) != "", F.when(part(1) == "-", -value).otherwise(value))


def is_integer(c: Column) -> Column:
    n = c.cast("string").try_cast("double")
    return F.coalesce(n == F.floor(n), F.lit(False))


def file_size(c: Column) -> Column:
    """Bytes of a text such as '3.5 kB'; null where it does not match."""
    number = F.regexp_extract(c, r"(?i)^\s*([0-9.]+)\s*([kmgt]?)b?", 1).try_cast("double")
    power = F.instr(F.lit("kmgt"), F.lower(F.regexp_extract(c, r"(?i)^\s*([0-9.]+)\s*([kmgt]?)b", 2)))
    power = F.when(F.regexp_extract(c, r"(?i)^\s*([0-9.]+)\s*([kmgt]?)b", 2) == "", F.lit(0)).otherwise(power)
    return number * F.pow(F.lit(1024.0), power)


def season(c: Column) -> Column:
    """A sort key of 'Q4.1' or 'C5': the number, with nothing for a missing decimal."""
    return F.regexp_extract(c, r"^[A-Za-z]+(\d+(?:\.\d+)?)", 1).try_cast("double")


def as_list(c: Column) -> Column:
    """A JSON array of texts, or a single text, as an array."""
    many = F.from_json(c, "array<string>")
    return F.when(c.startswith("["), F.coalesce(many, F.array(c))).when(c.isNull() | (c == ""), F.array().cast("array<string>")).otherwise(F.array(c))


def header_path(headers: Column) -> Column:
    return F.array_join(F.filter(headers, lambda h: h != ""), " > ")


def tool_arguments(c: Column) -> Column:
    """Why a tool call's arguments are refused, or 'ok': they must be JSON, an object, and hold a query."""
    first = F.substring(F.trim(c), 1, 1)
    valid = F.try_parse_json(c).isNotNull()
    return F.when(~F.coalesce(valid, F.lit(False)), "not JSON").when(first != "{", "not an object").when(F.coalesce(F.get_json_object(c, "$.query"), F.lit("")) == "", "no query").otherwise("ok")


def clamp_limit(c: Column, default: int = 10, most: int = 25) -> Column:
    n = c.cast("string").try_cast("int")
    return F.greatest(F.lit(1), F.least(F.coalesce(F.nullif(n, F.lit(0)), F.lit(default)), F.lit(most)))


def inputs_signature(arxiv_id: Column, esources: Column, property: Column, doi: Column) -> Column:
    """The first 12 digits of a hash over what decides where a paper's text can come from."""
    own = F.filter(property, lambda p: p.endswith("OPENACCESS"))
    parts = [F.coalesce(arxiv_id, F.lit("")), *[F.array_join(F.array_sort(a), ",") for a in (esources, own, doi)]]
    return F.substring(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), 1, 12)
