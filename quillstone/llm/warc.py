"""WARC fixity audit (operator 3): Merkle trees over records and ordered offset ranges of archive files.

A record's hash is the SHA-256 of its content. All records of an offset (one, in a sound file) are summed up by their number and
the sums of their hashes' quarters, so any number of them needs bounded state. Records are put in ranges of SPAN offsets; a
range's digest is the hash of its offsets' sums in order, and FANOUT neighbouring nodes make a node of the next level until a
file has one root. Two replicas are compared from the roots down: of a level only the children of nodes that differ
are looked at, and only offsets in differing ranges are compared at last. Sums and digests are written once per replica; the
levels are joined on (file, node), so a large file is spread over tasks. `read_warc` decompresses a file piece by piece and
hands on its records in batches of bounded size.

Defined results: a null content hashes like an empty one; a null file is a file '' and a null offset is offset 0;
repeated records (same file, offset and content) count, so a different number of them is a corruption; two empty
replicas agree; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import materialise

SPAN = 64
FANOUT = 8
FILE_RECORDS = 4096


#: Bytes of a file that are decompressed at once, and bytes of records that are handed on at once.
PIECE, BATCH_BYTES = 1 << 20, 8 << 20


def inflated(data: memoryview) -> Iterator[bytes]:
    """The file's bytes in pieces, of a gzipped file (of any number of members) decompressed."""
    if bytes(data[:2]) != b"\x1f\x8b":
        yield from (bytes(data[i : i + PIECE]) for i in range(0, len(data), PIECE))
        return
    at = 0
    while at < len(data) and bytes(data[at : at + 2]) == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        while not member.eof and at < len(data):
            piece = bytes(data[at : at + PIECE])
            out = member.decompress(piece, PIECE)
            yield out
            while member.unconsumed_tail and not member.eof:
                out = member.decompress(member.unconsumed_tail, PIECE)
                yield out
            at += len(piece) - len(member.unused_data)


def parse_warc(data: bytes) -> Iterator[tuple[int, int, str, str, bytes]]:
    """(offset, length, type, uri, block) of the records of an uncompressed or gzipped WARC file; offsets are those of the decompressed bytes.

    Holds one record and one piece at a time; a record that the file cuts off gives what there is of it.
    """
    pieces = inflated(memoryview(data))
    held, gone = bytearray(), 0

    def more() -> bool:
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        while (start := held.find(b"WARC/")) < 0:
            drop = max(0, len(held) - 4)
            del held[:drop]
            gone += drop
            if not more():
                return
        while (head_end := held.find(b"\r\n\r\n", start)) < 0:
            if not more():
                return
        head = dict(re.findall(r"^([\w-]+):[ \t]*(.*?)\r?$", held[start:head_end].decode("utf-8", "replace"), re.M))
        fields = {k.lower(): v for k, v in head.items()}
        size = fields.get("content-length", "0")
        stop = head_end + 4 + (int(size) if size.isdigit() else 0)
        while len(held) < stop and more():
            pass
        block = bytes(held[head_end + 4 : stop])
        yield gone + start, stop - start, fields.get("warc-type", ""), fields.get("warc-target-uri", ""), block
        stop = min(stop, len(held))
        del held[:stop]
        gone += stop


def write_record(uri: str, block: bytes, kind: str = "resource") -> bytes:
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {uri}\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, length, type, uri, content of every record under the path."""
    names = ["file", "offset", "length", "type", "uri", "content"]

    def records(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                rows, size = [], 0
                for r in parse_warc(content):
                    rows.append((name.rsplit("/", 1)[-1], *r))
                    size += len(r[-1]) + 200
                    if size > BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(records, "file string, offset long, length long, type string, uri string, content binary")


def _node(lines: Column) -> Column:
    """The digest of a bounded group's lines in order."""
    return F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(lines)), lambda x: x["line"]), ",").cast("binary"), 256)


def _up(nodes: DataFrame, fanout: int) -> DataFrame:
    child = F.struct("node", F.concat_ws(":", "node", "digest").alias("line"))
    return materialise(nodes.groupBy("file", F.floor(F.col("node") / fanout).alias("node")).agg(_node(child).alias("digest")), "nodes")


def digests(records: DataFrame, span: int = SPAN, fanout: int = FANOUT) -> tuple[DataFrame, list[DataFrame]]:
    """(offsets with the sum of their records, node tables from the ranges up to the roots); all written to the shared folder."""
    content = F.coalesce(F.col("content").cast("binary"), F.lit(b""))
    rows = records.select(F.coalesce(F.col("file").cast("string"), F.lit("")).alias("file"), F.coalesce(F.col("offset").cast("long"), F.lit(0)).alias("offset"), F.sha2(content, 256).alias("hash"))
    quarters = [F.sum(F.conv(F.substring("hash", 16 * k + 1, 15), 16, 10).cast("decimal(20,0)")).cast("string") for k in range(4)]
    rows = materialise(rows.groupBy("file", "offset").agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *quarters).alias("sum")), "records")
    item = F.struct("offset", F.concat_ws(":", "offset", "sum").alias("line"))
    level = rows.groupBy("file", F.floor(F.col("offset") / span).alias("node")).agg(_node(item).alias("digest"))
    levels = [materialise(level, "nodes")]
    while levels[-1].agg(F.max("node")).first()[0]:
        levels.append(_up(levels[-1], fanout))
    return rows, levels


def _differing(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    both = a.withColumnRenamed(value, "x").join(b.withColumnRenamed(value, "y"), keys, "full_outer")
    return both.filter(~F.col("x").eqNullSafe(F.col("y")))


def audit(primary: DataFrame, replica: DataFrame, span: int = SPAN, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """(files with both roots, bad records with file, offset, status). status: corrupt, missing or extra in the replica."""
    rows_a, a = digests(primary, span, fanout)
    rows_b, b = digests(replica, span, fanout)
    # replicas of different depth: the shallower tree's roots go up with the same rule until both have one level more
    while len(a) != len(b):
        short = a if len(a) < len(b) else b
        short.append(_up(short[-1], fanout))
    keys = ["file", "node"]
    roots = a[-1].withColumnRenamed("digest", "primary_root").join(b[-1].withColumnRenamed("digest", "replica_root"), keys, "full_outer").drop("node")
    bad = materialise(_differing(a[-1], b[-1], keys, "digest").select(*keys), "bad")
    for la, lb in zip(a[-2::-1], b[-2::-1], strict=True):
        def below(nodes: DataFrame, parents: DataFrame = bad) -> DataFrame:
            up = parents.withColumnRenamed("node", "up")
            return nodes.withColumn("up", F.floor(F.col("node") / fanout)).join(up, ["file", "up"], "left_semi").drop("up")

        bad = materialise(_differing(below(la), below(lb), keys, "digest").select(*keys), "bad")

    def within(rows: DataFrame) -> DataFrame:
        return rows.withColumn("node", F.floor(F.col("offset") / span)).join(bad, keys, "left_semi").select("file", "offset", "sum")

    records = _differing(within(rows_a), within(rows_b), ["file", "offset"], "sum")
    status = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").otherwise("corrupt")
    return roots, records.select("file", "offset", status.alias("status"))


def pages_archive(pages: DataFrame) -> DataFrame:
    """pages as archive records: FILE_RECORDS ids to a file, an id's place in it as the offset."""
    number = F.floor(F.col("page_id") / FILE_RECORDS)
    name = F.coalesce(F.concat(F.lit("pages-"), number.cast("string"), F.lit(".warc")), F.lit("pages-none.warc"))
    return pages.select(name.alias("file"), F.coalesce(F.pmod("page_id", F.lit(FILE_RECORDS)), F.lit(0)).alias("offset"), F.concat_ws("\n", F.col("url").cast("string"), F.col("html").cast("string")).alias("content"), "page_id")


def damaged(archive: DataFrame) -> DataFrame:
    """A replica with known damage: some records cut short, some lost."""
    lost = F.coalesce(F.pmod("page_id", F.lit(211)) == 5, F.lit(False))
    cut = F.coalesce(F.pmod("page_id", F.lit(101)) == 3, F.lit(False))
    return archive.filter(~lost).withColumn("content", F.when(cut, F.concat("content", F.lit("~"))).otherwise(F.col("content")))


def op3_warc_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file of the pages archive against a damaged replica: roots, and the ids of bad records found by descent."""
    archive = pages_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    roots, bad = audit(archive, damaged(archive))
    offsets = lambda s: F.sort_array(F.collect_list(F.when(F.col("status") == s, F.col("offset"))))
    found = bad.groupBy("file").agg(*[offsets(s).alias(f"{s}_offsets") for s in ("corrupt", "missing", "extra")])
    none = F.lit([]).cast("array<long>")
    return roots.join(found, "file", "left").select("file", "primary_root", "replica_root", *[F.coalesce(f"{s}_offsets", none).alias(f"{s}_offsets") for s in ("corrupt", "missing", "extra")])


def _tree_sql(name: str, source: str) -> str:
    quarters = " || ':' || ".join(f"sum(('0x' || substr(h, {16 * k + 1}, 15))::HUGEINT)" for k in range(4))
    return f"""
{name}_r AS (SELECT file, "offset", count(*) || ':' || {quarters} AS s FROM (SELECT file, "offset", sha256(content) AS h FROM {source}) GROUP BY ALL),
{name}_0 AS (SELECT file, "offset" // {SPAN} AS node, sha256(string_agg("offset" || ':' || s, ',' ORDER BY "offset")) AS d FROM {name}_r GROUP BY ALL),
{name}_1 AS (SELECT file, node // {FANOUT} AS up, sha256(string_agg(node || ':' || d, ',' ORDER BY node)) AS d FROM {name}_0 GROUP BY ALL),
{name}_2 AS (SELECT file, sha256(string_agg(up || ':' || d, ',' ORDER BY up)) AS d FROM {name}_1 GROUP BY file)"""


#: For files of more than SPAN * FANOUT records (with fewer, a tree is lower).
ORACLE = f"""
WITH a AS (SELECT coalesce('pages-' || (page_id // {FILE_RECORDS}) || '.warc', 'pages-none.warc') AS file, coalesce(page_id % {FILE_RECORDS}, 0) AS "offset", concat_ws(chr(10), url, html) AS content, page_id FROM pages),
b AS (SELECT file, "offset", CASE WHEN page_id % 101 = 3 THEN content || '~' ELSE content END AS content, page_id FROM a WHERE NOT coalesce(page_id % 211 = 5, false)),
{_tree_sql("a", "a")}, {_tree_sql("b", "b")},
depth AS (SELECT max("offset") // {SPAN} AS top FROM a),
roots AS (SELECT coalesce(x.file, y.file) AS file, x.d AS primary_root, y.d AS replica_root FROM a_2 x FULL JOIN b_2 y ON x.file = y.file WHERE (SELECT top FROM depth) >= {FANOUT}
  UNION ALL SELECT coalesce(x.file, y.file), x.d, y.d FROM a_1 x FULL JOIN b_1 y ON x.file = y.file AND x.up = y.up WHERE (SELECT top FROM depth) BETWEEN 1 AND {FANOUT - 1}
  UNION ALL SELECT coalesce(x.file, y.file), x.d, y.d FROM a_0 x FULL JOIN b_0 y ON x.file = y.file AND x.node = y.node WHERE (SELECT top FROM depth) = 0)
SELECT file, primary_root, replica_root,
  coalesce((SELECT list(page_id % {FILE_RECORDS} ORDER BY page_id) FROM a WHERE a.file = roots.file AND page_id % 101 = 3 AND page_id % 211 <> 5), []::BIGINT[]) AS corrupt_offsets,
  coalesce((SELECT list(page_id % {FILE_RECORDS} ORDER BY page_id) FROM a WHERE a.file = roots.file AND page_id % 211 = 5), []::BIGINT[]) AS missing_offsets,
  []::BIGINT[] AS extra_offsets
FROM roots
"""
