"""Paper records, joins by alias, licences, states and fingerprint differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import licences as L

STATES = ("full text", "not indexable", "abstract only", "failed", "retry", "pending")
MOST_REMOVALS = 10
MOST_TRIES = 10
AUTHOR_SOURCES = ("arxiv-tex", "arxiv-pdf", "author-pdf")


def alias_map(papers: DataFrame) -> DataFrame:
    """alias, bib: every name a paper ever had."""
    return papers.select(F.explode("aliases").alias("alias"), "bib")


def resolve(rows: DataFrame, aliases: DataFrame, column: str, keep_unknown: bool = True) -> DataFrame:
    """rows with `bib`, the current name of the paper that `column` names."""
    out = rows.join(aliases.withColumnRenamed("alias", column), column, "left")
    return out.withColumn("bib", F.coalesce("bib", column)) if keep_unknown else out


def access_class(arxiv_id: Column, property: Column) -> Column:
    free = F.arrays_overlap(property, F.array(*map(F.lit, ("PUB_OPENACCESS", "EPRINT_OPENACCESS", "AUTHOR_OPENACCESS"))))
    return F.when(arxiv_id.isNotNull(), "arxiv").when(free, "open access").otherwise("paywalled")


def source_list(arxiv_id: Column, esources: Column, property: Column) -> Column:
    """Sources of the full text that apply, in order of preference."""
    has = lambda name: F.array_contains(esources, name)
    return F.array_compact(F.array(
        F.when(arxiv_id.isNotNull(), F.lit("arxiv-tex")), F.when(arxiv_id.isNotNull() | has("EPRINT_PDF"), F.lit("arxiv-pdf")), F.when(has("AUTHOR_PDF"), F.lit("author-pdf")),
        F.when(has("PUB_PDF") & F.array_contains(property, "PUB_OPENACCESS"), F.lit("publisher-pdf")),
    ))


def allowed_sources(sources: Column, published_class: Column) -> Column:
    """All sources where the published version has an open licence, else the authors' own."""
    return F.when(published_class == L.OPEN, sources).otherwise(F.filter(sources, lambda s: s.isin(*AUTHOR_SOURCES)))


def remaining_sources(sources: Column, tried: Column, most_tries: int = MOST_TRIES) -> Column:
    """Sources not tried yet, or tried in vain for a passing reason fewer than so many times. tried: map to (transient, count)."""
    return F.filter(sources, lambda s: tried[s].isNull() | (tried[s]["transient"] & (tried[s]["count"] < most_tries)))


def indexable(copy: Column, published_class: Column) -> Column:
    return F.when(copy.isNull(), False).when(copy.isin("arXiv preprint", "author's copy"), True).otherwise(F.coalesce(published_class.isin(L.OPEN, L.CONDITIONS), F.lit(False)))


def derive_state(has_text: Column, may_index: Column, sources: Column, remaining: Column, tried: Column) -> Column:
    return (
        F.when(has_text & may_index, "full text").when(has_text, "not indexable").when(F.size(sources) == 0, "abstract only")
        .when(F.size(remaining) == 0, "failed").when(F.size(F.map_keys(tried)) > 0, "retry").otherwise("pending")
    )


def licence_options(evidence: DataFrame, today: str) -> DataFrame:
    """Labels that count for the published version: doc_id, label, source_rank."""
    rank = F.when(F.col("source") == "crossref", 0).when(F.col("source") == "datacite", 1).otherwise(2)
    ok = (
        ((F.col("source") == "crossref") & F.col("applies_to").isin("vor", "unspecified") & (F.coalesce("valid_from", F.lit("")) <= today))
        | ((F.col("source") == "datacite") & ~F.col("value").startswith("info:eu-repo"))
        | (F.col("source") == "openalex")
    )
    label = F.when(F.col("value").startswith("http"), L.label_from_url(F.col("value"))).otherwise(L.label_from_openalex(F.col("value")))
    return evidence.filter(ok).select("doc_id", label.alias("label"), rank.alias("source_rank"), "value")


def published_licence(options: DataFrame) -> DataFrame:
    """doc_id, published, published_class: the most open option; the earlier source, then the value, on ties."""
    best = F.min_by("label", F.struct(L.class_rank(F.col("label")), "source_rank", "value"))
    out = options.groupBy("doc_id").agg(best.alias("published"))
    return out.withColumn("published_class", L.licence_class(F.col("published")))


def fingerprint_diff(wanted: DataFrame, state: DataFrame, aliases: DataFrame) -> DataFrame:
    """bib, action (keep, write, new) for wanted(bib, fingerprint) against state(parent_doc, chunk_id, fingerprint).

    A group whose stored fingerprints are not exactly the wanted one is written again, which repairs partly written groups.
    """
    old = resolve(state.withColumnRenamed("parent_doc", "alias_"), aliases, "alias_", keep_unknown=False).filter("bib IS NOT NULL")
    old = old.groupBy("bib").agg(F.min("fingerprint").alias("lo"), F.max("fingerprint").alias("hi"), F.count(F.lit(1)).alias("objects"))
    both = wanted.join(old, "bib", "left")
    same = (F.col("lo") == F.col("hi")) & (F.col("lo") == F.col("fingerprint"))
    return both.select("bib", F.when(F.col("objects").isNull(), "new").when(same, "keep").otherwise("write").alias("action"))


def orphans(state: DataFrame, aliases: DataFrame) -> DataFrame:
    """parent_doc, objects of groups that no listed paper claims."""
    return state.join(aliases.select(F.col("alias").alias("parent_doc")), "parent_doc", "left_anti").groupBy("parent_doc").agg(F.count(F.lit(1)).alias("objects"))


class RemovalRefused(RuntimeError):
    """More rows would go than a run may remove."""


def guard_removals(n: int, most: int = MOST_REMOVALS, allow: bool = False) -> None:
    if n > most and not allow:
        raise RemovalRefused(f"{n} removals, more than {most}")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with new's rows in place of those with the same key; columns that one side lacks are null."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key), key, "left_anti")


def replace_groups(old: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """old with whole groups replaced by new's."""
    return old.join(new.select(group).distinct(), group, "left_anti").unionByName(new, allowMissingColumns=True)


def coverage_of(state: DataFrame, aliases: DataFrame) -> DataFrame:
    """bib, coverage: full text if any object is (a missing coverage counts as that), else abstract only."""
    own = resolve(state.withColumnRenamed("parent_doc", "alias_"), aliases, "alias_", keep_unknown=False).filter("bib IS NOT NULL")
    full = F.max(F.coalesce(F.col("coverage"), F.lit("full text")) == "full text")
    return own.groupBy("bib").agg(F.when(full, "full text").otherwise("abstract only").alias("coverage"))


def one_per_key(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
