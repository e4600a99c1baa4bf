"""Facet counts from bitmaps: papers by author key, first author key and year, so that totals of filters scan no papers.

Papers are numbered once; every value of a facet has, for each bucket of 32,768 numbers, a bitmap of its papers. A filter is the
intersection of facets, and a range of years the union of its years' bitmaps; bitmaps are combined bucket by bucket, and bits counted. What
a total reads is its values' bitmaps, whatever the papers hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators.ranks import numbered
from quillstone.operators.search import small


def facet_bitmaps(papers: DataFrame) -> DataFrame:
    """facet, value, bucket, bits of papers(bib, author_keys, first_author_keys, year); a null or empty facet has no bit, every paper one in `all`."""
    rows = numbered(papers.select("bib", "author_keys", "first_author_keys", "year"), [], ["bib"], "n").withColumn("n", F.col("n") - 1)
    listed = lambda c: F.coalesce(F.array_distinct(F.col(c)), F.array().cast("array<string>"))
    pair = lambda facet: lambda v: F.struct(F.lit(facet).alias("facet"), v.cast("string").alias("value"))
    values = F.concat(F.transform(listed("author_keys"), pair("author")), F.transform(listed("first_author_keys"), pair("first")), F.array(pair("year")(F.col("year")), pair("all")(F.lit(""))))
    each = rows.select("n", F.explode(values).alias("f")).select("n", "f.*").filter("value IS NOT NULL")
    # bucket numbers of the function start at 1, bit positions at 0
    return each.groupBy("facet", "value", F.bitmap_bucket_number(F.col("n") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("n") + 1)).alias("bits"))


def facet_totals(bitmaps: DataFrame, asked: DataFrame) -> DataFrame:
    """ask, total for each of asked(ask, author, first_author_only, year_from, year_to): papers that match all that is not null.

    An ask without any condition matches every paper.
    """
    facet = F.when(F.coalesce("first_author_only", F.lit(False)), F.lit("first")).otherwise(F.lit("author"))
    years = F.col("year_from").isNotNull() | F.col("year_to").isNotNull()
    wanted = F.array_compact(F.array(F.when(F.col("author").isNotNull(), F.struct(facet.alias("facet"), F.col("author").alias("value"))), F.when(F.col("author").isNull(), F.struct(F.lit("all").alias("facet"), F.lit("").alias("value")))))
    keys = asked.select("ask", F.explode(wanted).alias("w")).select("ask", "w.*")
    by_key = keys.join(bitmaps, ["facet", "value"]).select("ask", "bucket", F.lit("key").alias("part"), "bits")
    spans = asked.filter(years).select("ask", "year_from", "year_to")
    of_years = bitmaps.filter("facet = 'year'").withColumn("y", F.col("value").try_cast("int"))
    inside = (F.col("y") >= F.coalesce("year_from", "y")) & (F.col("y") <= F.coalesce("year_to", "y"))
    # a stated set of asks against the few years that there are
    by_year = of_years.join(small(spans), inside).groupBy("ask", "bucket").agg(F.bitmap_or_agg("bits").alias("bits")).select("ask", "bucket", F.lit("years").alias("part"), "bits")
    need = asked.select("ask", F.when(years, 2).otherwise(1).alias("need"))
    both = by_key.unionByName(by_year).groupBy("ask", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n"))
    hits = both.join(need, "ask").filter("n = need").groupBy("ask").agg(F.sum(F.bitmap_count("bits")).alias("total"))
    return asked.select("ask").join(hits, "ask", "left").select("ask", F.coalesce("total", F.lit(0)).cast("long").alias("total"))
