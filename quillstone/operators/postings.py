"""A kept BM25 index: postings in blocks of documents, with what bounds a block's scores, searched by skipping blocks (as MaxScore does).

A document belongs to a group and, within it, to a block, both by hashes of its key, so it never moves. The index has one row for each
(group, term, field, block): the number of postings, the largest count and the smallest length among them, and the postings
themselves. It is partitioned by group and sorted by term, so a search reads the row groups of its terms, and a changed document
rewrites its own group only. Lengths of all documents are kept by group too, since averages count documents without any of the terms.

A search takes the bounds of its terms first, without any posting. A block cannot score more than the sum over terms and fields of
the weight at its largest count and smallest length, as the weight grows with the count and falls with the length. Each query's most
promising blocks are scored first; the k-th score of these is a threshold that the query's result reaches in any case, and of the other
blocks only those whose bound reaches it are read. The result is exact and equal to `search.bm25`.

Sizes: a block holds about BLOCK_DOCS documents and a group about GROUP_DOCS, fixed when the index is built. A term of all documents has
one row a block. Terms, fields and blocks of a query meet by joins on (group, block, term), never in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.operators.search import B, K1, PER_RETRIEVER, small, terms, tokens, top_k
from quillstone.session import written

BLOCK_DOCS, GROUP_DOCS = 128, 65_536
#: Documents of a strip: the blocks of a group that are built in one task, into one file of the group.
STRIP_DOCS = 4_096
#: Blocks of a query that are scored before there is a threshold.
FIRST_BLOCKS = 8
#: Distinct terms up to which the scan's filter names them; more are found by a join alone.
MOST_NAMED = 2_000
_TABLES = {
    "postings": "term string, field string, block int, df long, max_tf long, min_len int, postings array<struct<doc: string, tf: bigint, len: int>>, group int",
    "lengths": "doc string, block int, field string, len int, group int",
}
#: Scores are rounded to six digits, so bounds get this much room.
ROOM = 1e-5


def _weight(boost: Column, idf: Column, tf: Column, length: Column, average: Column) -> Column:
    return boost * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


class PostingsIndex:
    """An index in a folder: `postings` and `lengths`, both partitioned by group, and `settings`."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(_TABLES[name]).parquet(f"{self.folder}/{name}")

    # building ---------------------------------------------------------------------------------------------------------

    def _dealt(self, docs: DataFrame, key: str, fields: list[str], groups: int, blocks: int) -> DataFrame:
        """doc, group, block, field, len, t (tokens) of every field of every document; of rows with the same key all count as one each."""
        return self._each(self._placed(docs, key, fields, groups, blocks))

    def _placed(self, docs: DataFrame, key: str, fields: list[str], groups: int, blocks: int) -> DataFrame:
        """doc, group, block and texts (field, text) of every document."""
        doc = F.col(key).cast("string")
        place = [doc.alias("doc"), F.pmod(F.xxhash64(doc), F.lit(groups)).cast("int").alias("group"), F.pmod(F.xxhash64(doc, F.lit(1)), F.lit(blocks)).cast("int").alias("block")]
        return docs.select(*place, F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields]).alias("texts"))

    def _each(self, placed: DataFrame) -> DataFrame:
        """A row of `_placed` as a row a field, with its tokens."""
        each = placed.withColumn("x", F.explode("texts")).drop("texts").withColumn("t", tokens(F.col("x.text")))
        return each.select(*[c for c in placed.columns if c != "texts"], "x.field", F.size("t").alias("len"), "t")

    def _counted(self, each: DataFrame) -> DataFrame:
        """How often each document's fields hold each term."""
        by = [c for c in each.columns if c != "t"]
        return each.select(*by, F.explode("t").alias("term")).groupBy(*by, "term").agg(F.count(F.lit(1)).alias("tf"))

    def _rows(self, counted: DataFrame) -> DataFrame:
        """Index rows of counted(doc, group, block, field, len, term, tf, and strip if there)."""
        listed = F.array_sort(F.collect_list(F.struct("doc", "tf", "len")))  # at most a block's documents
        by = [c for c in ("group", "strip", "block", "term", "field") if c in counted.columns]
        rows = counted.groupBy(*by).agg(F.count(F.lit(1)).alias("df"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"), listed.alias("postings"))
        return rows.select("group", "term", "field", "block", "df", "max_tf", "min_len", "postings")

    def _write(self, rows: DataFrame, lengths: DataFrame, mode: str) -> None:
        """Both tables, of their groups only where they exist; sorted by term, so statistics of row groups tell terms apart."""
        for df, name, order in ((rows, "postings", ["group", "term", "field", "block"]), (lengths.repartition("group"), "lengths", ["group", "doc"])):
            out = df.sortWithinPartitions(*order).write.mode(mode).option("partitionOverwriteMode", "dynamic")
            out.option("parquet.block.size", str(16 << 20)).partitionBy("group").parquet(f"{self.folder}/{name}")

    def build(self, docs: DataFrame, fields: dict[str, float], key: str = "doc_key", block_docs: int = BLOCK_DOCS, group_docs: int = GROUP_DOCS) -> PostingsIndex:
        n = docs.count()
        groups = max(1, -(-n // group_docs))
        blocks = max(1, -(-n // (groups * block_docs)))
        kept = self.spark.createDataFrame([(f, float(w), groups, blocks) for f, w in fields.items()], "field string, boost double, groups int, blocks int")
        kept.coalesce(1).write.parquet(f"{self.folder}/settings")
        # texts meet by strips of a group's blocks; counting, listing, sorting and writing follow in the same task, so no posting is shuffled
        strips = max(1, -(-min(n, group_docs) // STRIP_DOCS))
        placed = self._placed(docs, key, list(fields), groups, blocks).withColumn("strip", F.pmod("block", F.lit(strips)))
        dealt = placed.repartition(groups * strips, "group", "strip")
        self._write(self._rows(self._counted(self._each(dealt))), self._each(placed.drop("strip")).drop("t"), "overwrite")
        return self

    def settings(self) -> tuple[dict[str, float], int, int]:
        rows = self.spark.read.parquet(f"{self.folder}/settings").collect()  # a row a field
        return {r["field"]: r["boost"] for r in rows}, rows[0]["groups"], rows[0]["blocks"]

    def update(self, changed: DataFrame, key: str = "doc_key", removed: DataFrame | None = None) -> list[int]:
        """Put changed documents in the place of those with their keys, and take removed(key) away; only their groups are rewritten, and named in the result.

        The other documents of these groups keep their postings; their texts are not needed.
        """
        fields, groups, blocks = self.settings()
        gone = changed.select(F.col(key).cast("string").alias("doc"))
        if removed is not None:
            gone = gone.unionAll(removed.select(F.col(key).cast("string")))
        gone = written(gone.distinct(), "gone")
        touched = sorted(r[0] for r in gone.select(F.pmod(F.xxhash64("doc"), F.lit(groups)).cast("int")).distinct().collect())  # at most `groups`
        if not touched:
            return []
        held = self._read("postings").filter(F.col("group").isin(touched)).select("group", "term", "field", "block", F.inline("postings"))
        lengths = self._read("lengths").filter(F.col("group").isin(touched))
        dealt = self._dealt(changed, key, list(fields), groups, blocks)
        fresh = self._counted(dealt)
        counted = held.join(gone, "doc", "left_anti").unionByName(fresh)
        # written elsewhere first: a table is not overwritten while it is read
        rows = written(self._rows(counted), "index_rows")
        lengths = written(lengths.join(gone, "doc", "left_anti").unionByName(dealt.drop("t")), "index_lengths")
        self._write(rows.repartition("group"), lengths, "overwrite")
        for name, left in (("postings", rows), ("lengths", lengths)):
            empty = set(touched) - {r["group"] for r in left.select("group").distinct().collect()}
            for g in empty:  # a group that has lost all its rows is not overwritten by a dynamic overwrite
                path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/group={g}")
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        return touched

    # searching --------------------------------------------------------------------------------------------------------

    def _postings(self, wanted: DataFrame) -> DataFrame:
        """The index's rows of the wanted terms; the scan's filter names them if they are few."""
        rows = self._read("postings")
        named = [r["term"] for r in wanted.limit(MOST_NAMED + 1).collect()]
        if len(named) <= MOST_NAMED:
            return rows.filter(F.col("term").isin(named))
        return rows.join(wanted, "term", "left_semi")

    def bounds(self, queries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(terms with their weights: query_id, field, term, boost, idf, average; blocks: query_id, group, block, bound; the terms' index rows)."""
        fields, *_ = self.settings()
        q = written(queries.select("query_id", F.explode(terms(F.col("query"))).alias("term")), "query_terms")
        rows = self._postings(q.select("term").distinct())
        heads = written(rows.select("group", "block", "field", "term", "df", "max_tf", "min_len"), "heads")
        stats = self._read("lengths").groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("average"))
        boosts = F.create_map(*[F.lit(x) for f, w in fields.items() for x in (f, w)])
        weights = heads.groupBy("field", "term").agg(F.sum("df").alias("df")).join(F.broadcast(stats), "field").withColumn("boost", boosts[F.col("field")])
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weights = written(weights.select("field", "term", "boost", idf.alias("idf"), "average"), "weights")
        bound = _weight(F.col("boost"), F.col("idf"), F.col("max_tf"), F.col("min_len"), F.col("average"))
        by_block = heads.join(small(weights), ["field", "term"]).groupBy("group", "block", "term").agg(F.sum(bound).alias("bound"))
        blocks = by_block.join(small(q), "term").groupBy("query_id", "group", "block").agg(F.sum("bound").alias("bound"))
        return weights.join(q, "term"), blocks, rows

    def _scored(self, blocks: DataFrame, weights: DataFrame, rows: DataFrame) -> DataFrame:
        """query_id, doc, score of the documents of blocks(query_id, group, block) that hold a term of their query."""
        wanted = blocks.join(small(weights), "query_id")
        found = rows.select("group", "block", "field", "term", "postings").join(wanted, ["group", "block", "field", "term"])
        each = found.select("query_id", "boost", "idf", "average", F.inline("postings"))
        return each.groupBy("query_id", "doc").agg(F.round(F.sum(_weight(F.col("boost"), F.col("idf"), F.col("tf"), F.col("len"), F.col("average"))), 6).alias("score"))

    def search(self, queries: DataFrame, k: int = PER_RETRIEVER, key: str = "doc_key", first: int = FIRST_BLOCKS) -> DataFrame:
        """query_id, key, score, pos: the best k documents for each of queries(query_id, query), equal to those of `search.bm25`."""
        return self.traced(queries, k, key, first)[0]

    def traced(self, queries: DataFrame, k: int = PER_RETRIEVER, key: str = "doc_key", first: int = FIRST_BLOCKS) -> tuple[DataFrame, DataFrame]:
        """(the result of `search`, blocks: query_id, group, block, bound, read) to show which blocks were read."""
        weights, blocks, rows = self.bounds(queries)
        weights, blocks = written(weights, "query_weights"), written(blocks, "blocks")
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "group", "block")
        head = blocks.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= first).drop("_k")
        begun = written(self._scored(head, weights, rows), "scored_first")
        # the k-th score so far; without k documents everything is still to be read
        least = top_k(begun, k, "doc").filter(F.col("pos") == k).select("query_id", F.col("score").alias("least"))
        rest = blocks.join(head.select("query_id", "group", "block"), ["query_id", "group", "block"], "left_anti").join(small(least), "query_id", "left")
        rest = written(rest.filter(F.col("least").isNull() | (F.col("bound") + ROOM >= F.col("least"))).drop("least"), "blocks_left")
        found = top_k(begun.unionByName(self._scored(rest, weights, rows)), k, "doc")
        read = head.unionByName(rest).select("query_id", "group", "block", F.lit(True).alias("read"))
        return found.withColumnRenamed("doc", key), blocks.join(read, ["query_id", "group", "block"], "left").withColumn("read", F.coalesce("read", F.lit(False)))
