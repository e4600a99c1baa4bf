"""A paged listing as a Spark data source: one partition a page, keys pushed down to pages, and a stream of pages as they land.

`land_pages` writes a listing as a service would page it: a folder `pages/page=<n>` with the page's JSON ({"total", "results"}) and a
directory of the pages with their first and last key. Reading names the pages only; each is parsed in its own task. A
filter on the key (equality or a list) leaves out pages whose keys cannot match. A page that does not hold what it announces, or
a directory that does not hold the listing's total, raises. As a stream, the offset is the number of the last page.

    spark.dataSource.register(Listing)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.read.format("listing").schema(...).option("key", "bib").load(folder)
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition
from pyspark.sql.types import StructType


def land_pages(rows: DataFrame, folder: str, key: str, page: str, total: int) -> None:
    """Write rows as pages, numbered by the column `page`; `total` is what the service says the listing holds so far.

    Pages are of a bounded number of rows: they are what a service sends in one reply.
    """
    names = [c for c in rows.columns if c != page]
    told = rows.groupBy(F.col(page).alias("page")).agg(F.to_json(F.struct(F.lit(total).alias("total"), F.array_sort(F.collect_list(F.struct(key, *[c for c in names if c != key]))).alias("results"))).alias("value"))
    told.repartition("page").write.mode("append").partitionBy("page").text(f"{folder}/pages")
    known = rows.groupBy(F.col(page).alias("page")).agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count(F.lit(1)).alias("rows"), F.lit(total).alias("total"))
    known.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("append").text(f"{folder}/directory")


def _system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _texts(folder: str) -> Iterator[str]:
    """The lines of the text files of a folder."""
    from pyarrow import fs

    system, path = _system(folder)
    for info in sorted(system.get_file_info(fs.FileSelector(path, allow_not_found=True)), key=lambda i: i.path):
        if info.is_file and info.base_name.startswith("part-"):
            with system.open_input_stream(info.path) as f:
                yield from f.read().decode().splitlines()


class Page(InputPartition):
    def __init__(self, number: int, rows: int):
        super().__init__(number)
        self.number, self.rows = number, rows


class _Pages:
    """What both readers share: the directory, and a page's rows."""

    def __init__(self, options: dict, schema: StructType):
        self.folder, self.key, self.names = options["path"].rstrip("/"), options.get("key", "key"), schema.fieldNames()

    def directory(self) -> list[dict]:
        """The pages that have landed, by number; the newest total counts."""
        return sorted((json.loads(x) for x in _texts(f"{self.folder}/directory")), key=lambda p: p["page"])

    def rows_of(self, page: Page) -> Iterator[tuple]:
        held = [r for x in _texts(f"{self.folder}/pages/page={page.number}") for r in json.loads(x)["results"]]
        if len(held) != page.rows:
            raise ValueError(f"page {page.number} is cut: {len(held)} of {page.rows} rows")
        for r in held:
            yield tuple(r.get(n) for n in self.names)


class ListingReader(DataSourceReader, _Pages):
    def __init__(self, options: dict, schema: StructType):
        _Pages.__init__(self, options, schema)
        self.wanted: list | None = None

    def pushFilters(self, filters: list) -> Iterator:
        """Keys decide on pages; every filter still goes over the rows, as a page holds others too."""
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == (self.key,):
                self.wanted = values if self.wanted is None else [v for v in self.wanted if v in values]
            yield f

    def partitions(self) -> list[Page]:
        pages = self.directory()
        if pages and sum(p["rows"] for p in pages) < max(p["total"] for p in pages):
            raise ValueError(f"the listing is cut: {sum(p['rows'] for p in pages)} of {max(p['total'] for p in pages)} rows")
        if self.wanted is not None:
            pages = [p for p in pages if any(v is not None and p["first"] <= v <= p["last"] for v in self.wanted)]
        return [Page(p["page"], p["rows"]) for p in pages] or [Page(-1, 0)]

    def read(self, partition: Page) -> Iterator[tuple]:
        return self.rows_of(partition) if partition.number >= 0 else iter(())


class ListingStream(DataSourceStreamReader, _Pages):
    def __init__(self, options: dict, schema: StructType):
        _Pages.__init__(self, options, schema)

    def initialOffset(self) -> dict:
        return {"page": -1}

    def latestOffset(self) -> dict:
        return {"page": max((p["page"] for p in self.directory()), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [Page(p["page"], p["rows"]) for p in self.directory() if start["page"] < p["page"] <= end["page"]]

    def read(self, partition: Page) -> Iterator[tuple]:
        return self.rows_of(partition)

    def commit(self, end: dict) -> None:
        """Pages stay where they landed."""


class Listing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return "key string"

    def reader(self, schema: StructType) -> ListingReader:
        return ListingReader(dict(self.options), schema)

    def streamReader(self, schema: StructType) -> ListingStream:
        return ListingStream(dict(self.options), schema)
