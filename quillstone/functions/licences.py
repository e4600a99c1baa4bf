"""Names and classes of licences as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Classes of licences, the most permissive first, and names of special cases.
OPEN, CONDITIONS, NO_LICENCE = "open licence", "with conditions", "no licence"
CLASSES = (OPEN, CONDITIONS, NO_LICENCE)
ARXIV_DEFAULT, FREE_TO_READ, NONE_FOUND = "arXiv default licence", "free to read, no licence", "none found"
ARXIV_DOI = "10.48550/"


def label_from_url(url: Column) -> Column:
    """A short name of a licence's address."""
    cc = r"(?i)creativecommons\.org/licen[cs]es/([a-z-]+)/([0-9](\.[0-9])?)"
    public = r"(?i)creativecommons\.org/(publicdomain/(zero|mark)|licen[cs]es/publicdomain)"
    host = F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1)
    host = F.regexp_replace(F.lower(F.when(host == "", url).otherwise(host)), r"^www\.", "")
    return (
        F.when(url.rlike(cc), F.concat(F.lit("CC "), F.upper(F.regexp_extract(url, cc, 1)), F.lit(" "), F.regexp_extract(url, cc, 2)))
        .when(url.rlike(public), F.when(F.lower(F.regexp_extract(url, public, 2)) == "zero", F.lit("CC0")).otherwise(F.lit("public domain")))
        .when(url.contains("arxiv.org/licenses/nonexclusive-distrib"), F.lit(ARXIV_DEFAULT))
        .when(url.contains("arxiv.org/licenses/assumed-1991-2003"), F.lit("arXiv, before licences (1991-2003)"))
        .otherwise(F.concat(F.lit("publisher's terms ("), host, F.lit(")")))
    )


def label_from_openalex(value: Column) -> Column:
    """A short name of a licence's id."""
    last = F.element_at(F.split(F.lower(value), "/"), -1)
    return (
        F.when(last.startswith("cc-"), F.concat(F.lit("CC "), F.upper(F.substring(last, 4, 100))))
        .when(last == "cc0", F.lit("CC0"))
        .when(last == "public-domain", F.lit("public domain"))
        .when(last == "publisher-specific-oa", F.lit("publisher's terms (OpenAlex)"))
        .otherwise(F.concat(F.lit("no open licence (OpenAlex: "), last, F.lit(")")))
    )


def licence_class(label: Column) -> Column:
    kind = F.get(F.split(label, " "), F.lit(1))
    by = F.when(kind.contains("NC") | kind.contains("ND"), F.lit(CONDITIONS)).otherwise(F.lit(OPEN))
    return F.when(label.isin("CC0", "public domain"), F.lit(OPEN)).when(label.startswith("CC BY"), by).otherwise(F.lit(NO_LICENCE))


def class_rank(label: Column) -> Column:
    c = licence_class(label)
    return F.when(c == OPEN, 0).when(c == CONDITIONS, 1).otherwise(2)


def publisher_dois(doi: Column) -> Column:
    return F.filter(F.transform(doi, lambda d: F.lower(d)), lambda d: ~d.startswith(ARXIV_DOI))
