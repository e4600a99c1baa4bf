"""Papers that were renamed more than once: names are nodes, lists that give a paper several names are edges, papers are components.

`canonical` finds the components by alternating large-star and small-star steps: every node links its larger neighbours to its smallest
one, then itself and its smaller neighbours to the smallest. Both steps only shrink links, and the number of rounds grows with the logarithm
of the longest chain of names. Each round is written to the shared folder, so its lineage is short. A name with very many
others (a hub) has its smallest neighbour found by partial aggregation; to tell it to them, its rows are dealt to SALTS parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.session import written

#: A name with more neighbours than this is dealt to so many parts.
HUB, SALTS = 10_000, 64
MOST_ROUNDS = 60


def links(*lists: DataFrame) -> DataFrame:
    """a, b: the names that each of the lists(bib, aliases) gives to one paper; the first with each of the others."""
    out = None
    for df in lists:
        names = F.array_distinct(F.filter(F.concat(F.array("bib"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: x.isNotNull()))
        rows = df.select(names.alias("n")).select(F.get("n", F.lit(0)).alias("a"), F.explode("n").alias("b"))
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def _told(edges: DataFrame) -> DataFrame:
    """u, v, m of edges(u, v): m is the smallest of u and its neighbours."""
    least = edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
    parts = F.when(F.col("n") > HUB, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    least = least.select("u", "m", (F.col("n") > HUB).alias("hub"), F.explode(parts).alias("part"))
    hubs = least.filter("hub").select("u").distinct()
    # hubs are few: each has more than HUB of the edges
    dealt = edges.join(hubs.withColumn("hub", F.lit(True)), "u", "left")
    dealt = dealt.withColumn("part", F.when(F.col("hub"), F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))).drop("hub")
    return dealt.join(least.drop("hub"), ["u", "part"]).select("u", "v", "m")


def canonical(pairs: DataFrame) -> DataFrame:
    """name, root of every name in pairs(a, b): root is the smallest name of its component. Null names are left out; a name alone is its own root."""
    known = pairs.filter("a IS NOT NULL AND b IS NOT NULL").select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"))
    names = written(known.select(F.col("a").alias("name")).unionAll(known.select("b")).distinct(), "names")
    edges = written(known.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    for _ in range(MOST_ROUNDS):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _told(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large, "links")
        small = _told(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v")))
        edges = written(small.filter("u <> v").distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            roots = edges.select(F.col("u").alias("name"), F.col("v").alias("root"))
            return names.join(roots, "name", "left").select("name", F.coalesce("root", "name").alias("root"))
        before = now
    raise RuntimeError(f"names not settled after {MOST_ROUNDS} rounds")


def transitive_aliases(papers: DataFrame, *earlier: DataFrame) -> DataFrame:
    """alias, bib for every name that the lists ever linked, over any number of renames, to a paper of papers(bib, aliases).

    A name that belongs to several current papers, by a mistaken link, goes to the smallest of them; their own names stay theirs.
    """
    roots = written(canonical(links(papers, *earlier)), "roots")
    own = papers.select(F.col("bib").alias("name")).distinct().join(roots, "name")
    current = own.groupBy("root").agg(F.min("name").alias("bib"))
    to = roots.join(current, "root").select(F.col("name").alias("alias"), "bib")
    # a current paper's name is its own
    mine = own.select(F.col("name").alias("alias"), F.col("name").alias("mine"))
    return to.join(mine, "alias", "left").select("alias", F.coalesce("mine", "bib").alias("bib"))
