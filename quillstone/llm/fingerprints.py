"""Document fingerprints (operator 9): a Merkle tree over leaves, paragraphs and sections, in DataFrame functions only.

A text's paragraphs are its newline-separated parts, a section is SECTION consecutive paragraphs. Leaves of at most 80
characters that end at content-defined places tile a paragraph. A leaf is hashed with MD5, a paragraph with SHA-256
over its leaves' hashes, a section over its paragraphs' and the root over its sections', so equal roots mean equal texts.
A fingerprint holds the root and the shortened hashes of all levels (root:sections:paragraphs:leaves, the leaves
of a paragraph closed by '/'), so two stored fingerprints locate an edit: `edited_paragraphs` looks into differing sections
only. Likeness goes down the same tree: sections that both have are set aside, then paragraphs, then leaves; it is one
less the leaves that remain on either side as a share of the distinct leaves of both.

The next document comes from order by id in runs between quantiles of the ids (`with_next`).

Defined results: null texts count as empty; two empty texts are alike (1.0); a document without an id comes after
all others; rows with equal ids stand in order of the hash of their text, and repeated rows are fingerprinted each
by itself; the only document's successor is itself; ids may have any value; an empty table gives no rows; further columns are
ignored. Time is linear in a text's length and lines.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm.common import materialise

SECTION = 8
#: Up to a blank that follows one of these characters, else 80 characters or the rest of the paragraph.
LEAF = r"[^\n]{15,78}?[estn.,;:!?] |[^\n]{1,80}"
#: Hex digits that a fingerprint keeps of a leaf, and of a paragraph or section.
SHORT, MIDDLE = 8, 16
ROWS_A_BUCKET = 512
MOST_BUCKETS = 100_000
#: An id of more rows than this has parts of its own, by the hash that orders its rows.
HOT_ROWS = 4 * ROWS_A_BUCKET
HOT_PARTS = 4096
MOST_HEADS = 1_000_000


def _cut(hashes: Column, size: int) -> Column:
    return F.regexp_extract_all(hashes, F.lit(f".{{{size}}}"), F.lit(0))


def tree(rows: DataFrame, text: str, name: str) -> DataFrame:
    """rows with {name}_root, {name}_sections, {name}_paragraphs (hashes), {name}_leaves (one string, see above).

    Levels are cut from joined strings and not by position, since a lambda that reads another column would work that out again for each element.
    """
    leaves = F.transform(F.split(F.col(text), "\n", -1), lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda x: F.md5(x.cast("binary"))))
    rows = rows.withColumn("_t", leaves)
    rows = rows.withColumns({f"{name}_paragraphs": F.transform("_t", lambda p: F.sha2(F.array_join(p, "").cast("binary"), 256)), f"{name}_leaves": F.array_join(F.transform("_t", lambda p: F.concat(F.array_join(F.transform(p, lambda x: F.substring(x, 1, SHORT)), ""), F.lit("/"))), "")}).drop("_t")
    parts = F.regexp_extract_all(F.array_join(f"{name}_paragraphs", ""), F.lit(f".{{1,{64 * SECTION}}}"), F.lit(0))
    rows = rows.withColumn(f"{name}_sections", F.transform(parts, lambda s: F.sha2(s.cast("binary"), 256)))
    return rows.withColumn(f"{name}_root", F.sha2(F.array_join(f"{name}_sections", "").cast("binary"), 256))


def fingerprint(name: str) -> Column:
    short = lambda level: F.array_join(F.transform(f"{name}_{level}", lambda h: F.substring(h, 1, MIDDLE)), "")
    return F.concat_ws(":", f"{name}_root", short("sections"), short("paragraphs"), f"{name}_leaves")


def _parts(leaves: Column) -> Column:
    """The sections of a string of leaves."""
    return F.regexp_extract_all(leaves, F.lit(f"(?:[0-9a-f]*/){{1,{SECTION}}}"), F.lit(0))


def with_likeness(rows: DataFrame, x: str, y: str, out: str) -> DataFrame:
    """rows with `out`, the likeness of two strings of leaves, from sections down to leaves; a level is looked at where the one above differs."""
    both = (x, y)
    same = F.col(x) == F.col(y)
    rows = rows.withColumns({f"_n{k}": F.size(F.array_distinct(F.regexp_extract_all(F.col(c), F.lit(f"[0-9a-f]{{{SHORT}}}"), F.lit(0)))) for k, c in enumerate(both)})
    rows = rows.withColumns({f"_v{k}": _parts(F.when(~same, F.col(c)).otherwise(F.lit(""))) for k, c in enumerate(both)})
    for cut in (lambda v: F.split(v, "/"), lambda v: _cut(v, SHORT)):
        rest = {f"_v{k}": cut(F.array_join(F.array_except(f"_v{k}", f"_v{1 - k}"), "")) for k in (0, 1)}
        rows = rows.withColumns(rest)
    left = F.size(F.array_except("_v0", "_v1")) + F.size(F.array_except("_v1", "_v0"))
    return rows.withColumn(out, F.when(same, F.lit(1.0)).otherwise(F.lit(1.0) - left / (F.col("_n0") + F.col("_n1")))).drop("_n0", "_n1", "_v0", "_v1")


def edited_paragraphs(before: Column, after: Column) -> Column:
    """Numbers (from 0) of the paragraphs that differ between two fingerprints; equal roots and equal sections are not looked into."""
    levels = [(F.split_part(x, F.lit(":"), F.lit(2)), F.split_part(x, F.lit(":"), F.lit(3))) for x in (before, after)]
    # of each side its sections' hashes, and for each section the string of its paragraphs' hashes
    (sa, pa), (sb, pb) = ((_cut(sections, MIDDLE), F.regexp_extract_all(paragraphs, F.lit(f".{{1,{MIDDLE * SECTION}}}"), F.lit(0))) for sections, paragraphs in levels)
    pairs = F.arrays_zip(sa.alias("sa"), sb.alias("sb"), pa.alias("pa"), pb.alias("pb"))

    def inside(z: Column, i: Column) -> Column:
        a, b = (_cut(F.coalesce(z[k], F.lit("")), MIDDLE) for k in ("pa", "pb"))
        numbers = F.transform(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda same, k: F.when(~same, i * SECTION + k))
        return F.when(z["sa"].eqNullSafe(z["sb"]), F.array().cast("array<int>")).otherwise(F.filter(numbers, lambda n: n.isNotNull()))

    same = F.split_part(before, F.lit(":"), F.lit(1)) == F.split_part(after, F.lit(":"), F.lit(1))
    return F.when(same, F.array().cast("array<int>")).otherwise(F.flatten(F.transform(pairs, inside)))


def _run_of(cuts: list[int]) -> Column:
    """The number of cuts (ascending) that are at least doc_id, so larger ids come first; found by two levels of bounded arrays."""
    step = max(1, int(len(cuts) ** 0.5))
    heads, width = cuts[::step], len(cuts[::step])
    listed = lambda v, kind: F.from_json(F.lit(json.dumps(v)), kind)
    groups = listed([cuts[i : i + step] for i in range(0, len(cuts), step)], "array<array<bigint>>")
    block = F.size(F.filter(listed(heads, "array<bigint>"), lambda c: c < F.col("doc_id")))  # blocks that begin below the id
    inside = F.size(F.filter(F.get(groups, block - 1), lambda c: c < F.col("doc_id")))
    below = F.when(block == 0, 0).otherwise((block - 1) * step + inside)
    return (F.lit(len(cuts)) - below).cast("long") if width else F.lit(0).cast("long")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text: the document after each in descending order of id; after the last comes the first.

    Ids are cut into runs at approximate quantiles, about ROWS_A_BUCKET rows each whatever their values, so that the order is found
    within partitions; the successor of a run's last row is the head of the next run that has rows. There are MOST_BUCKETS
    runs at most, so the heads' ids are bounded. An id of more than HOT_ROWS rows is dealt to HOT_PARTS parts, which
    stand in their run where the id stands.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    n = min(MOST_BUCKETS, max(1, ids.count() // ROWS_A_BUCKET))
    # shares must be a constant: one literal, since a transform is none and an expression per share is long
    shares = F.split(F.lit(",".join(str(k / n) for k in range(1, n))), ",").cast("array<double>")
    found = ids.agg(F.percentile_approx("doc_id", shares, 20 * n).alias("q")).first()["q"] if n > 1 else None
    cuts = sorted(set(found or ()))
    # the rows without an id come last, dealt by the hash that orders them
    run_of = _run_of(cuts)
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1) + F.shiftrightunsigned(F.xxhash64("text"), 54)).otherwise(run_of)
    tie = F.conv(F.hex(F.xxhash64("text")), 16, 10).cast("decimal(20,0)")
    order = [F.col("doc_id").desc_nulls_last(), tie, F.col("text")]
    rows = rows.withColumn("bucket", bucket)
    hot = materialise(ids.groupBy("doc_id").count().filter((F.col("count") > HOT_ROWS) & F.col("doc_id").isNotNull()), "hot_ids")
    by_run = hot.groupBy(run_of.alias("bucket")).agg(F.collect_list("doc_id").alias("hot"))
    most = by_run.agg(F.max(F.size("hot"))).first()[0]
    if most:
        # places in a run: between, at and after its hot ids, of which there are few
        above = F.size(F.filter("hot", lambda h: h > F.col("doc_id")))
        part = F.shiftrightunsigned(F.xxhash64("text"), 64 - (HOT_PARTS.bit_length() - 1))
        place = F.when(F.array_contains("hot", F.col("doc_id")), (2 * above + 1) * HOT_PARTS + part).otherwise(2 * above * HOT_PARTS)
        rows = rows.join(by_run, "bucket", "left").withColumn("bucket", F.col("bucket") * ((2 * most + 2) * HOT_PARTS) + F.coalesce(place, F.lit(0))).drop("hot")
    first_ids = materialise(rows.groupBy("bucket").agg(F.max("doc_id").alias("head")), "heads")
    side = F.broadcast(first_ids) if first_ids.count() <= MOST_HEADS else first_ids
    heads = rows.join(side, (rows["bucket"] == first_ids["bucket"]) & rows["doc_id"].eqNullSafe(first_ids["head"])).drop(first_ids["bucket"]).drop("head")
    heads = heads.withColumn("k", F.row_number().over(Window.partitionBy("bucket").orderBy(*order))).filter("k = 1").select("bucket", F.col("text").alias("head_text"))
    line = Window.orderBy("bucket")
    follows = first_ids.select("bucket", F.coalesce(F.lead("bucket").over(line), F.first("bucket").over(line)).alias("after"))
    heads = materialise(follows.join(heads.withColumnRenamed("bucket", "after"), "after").select("bucket", "head_text"), "head_texts")
    ordered = rows.withColumn("lead_text", F.lead("text").over(Window.partitionBy("bucket").orderBy(*order)))
    return ordered.join(heads, "bucket", "left").select("doc_id", "text", F.coalesce("lead_text", "head_text").alias("next_text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    tail = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - tail), F.substring(F.col("next_text"), F.lit(1), tail)))
    for text, name in (("text", "a"), ("edited", "b"), ("next_text", "c")):
        rows = tree(rows, text, name)
    rows = with_likeness(with_likeness(rows, "a_leaves", "b_leaves", "near_edited"), "a_leaves", "c_leaves", "near_next")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint("a").alias("fingerprint"), fingerprint("b").alias("edited_fingerprint"),
        "near_edited", "near_next",
    )


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _tree_sql(text: str, name: str, source: str) -> str:
    """CTEs {name}1 to {name}3: doc_id and a document's levels."""
    leaf = f"list_transform(string_split({text}, chr(10)), lambda p: list_transform(regexp_extract_all(p, '{LEAF}'), lambda x: md5(x)))"
    return f"""
{name}1 AS MATERIALIZED (SELECT doc_id, list_transform(t, lambda p: sha256(array_to_string(p, ''))) AS p, array_to_string(list_transform(t, lambda p: array_to_string(list_transform(p, lambda x: substr(x, 1, {SHORT})), '') || '/'), '') AS l FROM (SELECT doc_id, {leaf} AS t FROM {source})),
{name}2 AS MATERIALIZED (SELECT *, list_transform(range(0, (len(p) + {SECTION - 1}) // {SECTION}), lambda i: sha256(array_to_string(p[i * {SECTION} + 1 : i * {SECTION} + {SECTION}], ''))) AS s FROM {name}1),
{name}3 AS MATERIALIZED (SELECT doc_id, l, sha256(array_to_string(s, '')) || ':' || array_to_string(list_transform(s, lambda h: substr(h, 1, {MIDDLE})), '') || ':' || array_to_string(list_transform(p, lambda h: substr(h, 1, {MIDDLE})), '') || ':' || l AS f FROM {name}2)"""


def _rest_sql(name: str, x: str, y: str) -> str:
    """CTEs that end in {name}(doc_id, n): leaves outside what both sides have, level by level."""
    out, pair = [], (f"{x}3", f"{y}3")
    for level, cut in enumerate((f"regexp_extract_all(v, '(?:[0-9a-f]*/){{1,{SECTION}}}')", "string_split(v, '/')", f"regexp_extract_all(v, '.{{{SHORT}}}')")):
        for k, source in enumerate(pair):
            out.append(f"{name}{level}{k} AS MATERIALIZED (SELECT DISTINCT doc_id, unnest({cut}) AS v FROM (SELECT doc_id, {'v' if level else 'l'} AS v FROM {source}))")
        pair = tuple(f"{name}{level}_{k}" for k in (0, 1))
        out += [f"{pair[k]} AS (SELECT * FROM {name}{level}{k} EXCEPT SELECT * FROM {name}{level}{1 - k})" for k in (0, 1)]
    return ",\n".join(out) + f",\n{name} AS (SELECT doc_id, count(*) AS n FROM (SELECT * FROM {pair[0]} UNION ALL SELECT * FROM {pair[1]}) GROUP BY doc_id)"


_counts = ", ".join(f"{t}n AS (SELECT doc_id, len(list_distinct(regexp_extract_all(l, '[0-9a-f]{{{SHORT}}}'))) AS n FROM {t}3)" for t in "abc")
_near = lambda t, r: f"CASE WHEN a3.l = {t}3.l THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - coalesce({r}.n, 0)::DOUBLE / (an.n + {t}n.n) END"
ORACLE = f"""
WITH n AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER w, first_value(coalesce(text, '')) OVER w) AS nx FROM documents WINDOW w AS (ORDER BY doc_id DESC)),
e AS (SELECT *, substr(t, 1, length(t) - length(t) // 3) || substr(nx, 1, length(t) // 3) AS ed FROM n),{_tree_sql("t", "a", "e")},{_tree_sql("ed", "b", "e")},{_tree_sql("nx", "c", "e")},
{_rest_sql("rb", "a", "b")}, {_rest_sql("rc", "a", "c")}, {_counts}
SELECT e.doc_id, length(t)::BIGINT AS n_chars, sha256(ed) AS edited_sha256, a3.f AS fingerprint, b3.f AS edited_fingerprint, {_near("b", "rb")} AS near_edited, {_near("c", "rc")} AS near_next
FROM e JOIN a3 USING (doc_id) JOIN b3 USING (doc_id) JOIN c3 USING (doc_id) JOIN an USING (doc_id) JOIN bn USING (doc_id) JOIN cn USING (doc_id) LEFT JOIN rb USING (doc_id) LEFT JOIN rc USING (doc_id)
"""
