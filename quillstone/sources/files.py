"""Files as sources and sinks: JSON maps, JSON lines, Markdown folders, archives, TeX bundles, XML records, versioned tables."""

from __future__ import annotations

import gzip
import io
import json
import os
import re
import tarfile
import time
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARCHIVE_LIMIT = 1500 << 20


def read_json_map(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """key, value of the map that a JSON document holds under a field."""
    doc = spark.read.text(path, wholetext=True)
    parsed = doc.select(F.from_json("value", f"{field} map<string, struct<{schema}>>").alias("d"))
    return parsed.select(F.explode(F.col(f"d.{field}")).alias("key", "value"))


def read_records(spark: SparkSession, path: str, total_field: str = "total") -> DataFrame:
    """Results of a paged listing; raises where the listing says that there are more than it holds."""
    doc = spark.read.option("multiLine", True).json(path)
    row = doc.select(F.col(total_field).cast("long").alias("total"), F.size("results").alias("n")).first()
    if row["total"] > row["n"]:
        raise ValueError(f"the listing is cut: {row['n']} of {row['total']}")
    return doc.select(F.explode("results").alias("r")).select("r.*")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with an event; any other line is passed over."""
    lines = spark.read.text(path)
    return lines.select(F.from_json("value", "event string, id string, error string, seconds double").alias("e")).filter("e.event IS NOT NULL").select("e.*")


def job_states(events: DataFrame) -> DataFrame:
    """The last state of each job: done or failed after its end, else running."""
    ended = F.max(F.when(F.col("event") == "done", F.struct(F.coalesce("error", F.lit("")).alias("error"), "seconds")))
    return events.groupBy("id").agg(ended.alias("d")).select("id", F.when(F.col("d").isNull(), "running").when(F.col("d.error") == "", "done").otherwise("failed").alias("state"), "d.seconds")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """name, markdown of the *.md files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("name"), F.decode("content", "UTF-8").alias("markdown"))


def match_markdown(files: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bib, name, markdown of one file for each paper; names that belong to none). A file with the current name wins, else the first."""
    from pyspark.sql import Window

    known = files.join(aliases.withColumnRenamed("alias", "name"), "name")
    w = Window.partitionBy("bib").orderBy(F.col("bib") != F.col("name"), "name")
    best = known.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")
    return best, files.join(aliases.withColumnRenamed("alias", "name"), "name", "left_anti").select("name")


def sniff(data: bytes) -> str:
    """pdf, tar, gzip or text."""
    if b"%PDF-" in data[:1024]:
        return "pdf"
    if data[:2] == b"\x1f\x8b":
        return "gzip"
    return "tar" if len(data) > 262 and data[257:262] == b"ustar" else "text"


def unpack(data: bytes, limit: int = ARCHIVE_LIMIT) -> dict[str, bytes]:
    """Regular files of a source bundle: a PDF, a text, a gzipped either, or a (gzipped) tar; never outside its folder, within a limit."""
    kind = sniff(data)
    if kind == "gzip":
        with gzip.GzipFile(fileobj=io.BytesIO(data)) as g:
            inner = g.read(limit + 1)
        if len(inner) > limit:
            raise ValueError("the archive is too large")
        return unpack(inner, limit)
    if kind != "tar":
        return {"paper.pdf" if kind == "pdf" else "main.tex": data}
    out, total = {}, 0
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        for m in t:
            name = os.path.normpath(m.name)
            if not m.isreg() or name.startswith(("/", "..")):
                continue
            total += m.size
            if total > limit:
                raise ValueError("the archive is too large")
            out[name] = t.extractfile(m).read()
    return out


def unpack_files(files: DataFrame) -> DataFrame:
    """bundle, name, content of binaryFile rows."""

    def each(frames):
        for f in frames:
            rows = [(p, n, c) for p, d in zip(f["path"], f["content"], strict=True) for n, c in unpack(bytes(d)).items()]
            yield pd.DataFrame(rows, columns=["bundle", "name", "content"])

    return files.select("path", "content").mapInPandas(each, "bundle string, name string, content binary")


def braced(text: str, at: int) -> str | None:
    """What a balanced pair of braces at a place holds."""
    if at >= len(text) or text[at] != "{":
        return None
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == "{") - (text[i] == "}") if i == 0 or text[i - 1] != "\\" else 0
        if not depth:
            return text[at + 1 : i]
    return None


def tex_title(tex: str) -> str | None:
    found = re.search(r"\\title\s*(?:\[[^\]]*\])?\s*(?=\{)", re.sub(r"(?<!\\)%.*", "", tex or ""))
    return braced(re.sub(r"(?<!\\)%.*", "", tex), found.end()) if found else None


def tex_title_udf():
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def title(s: pd.Series) -> pd.Series:
        return s.map(tex_title)

    return title


#: Names of files that come with a paper but are not it.
NOT_THE_PAPER = "guide|template|sample|example|response|reply|referee|cover|letter"


def listed_files(files: dict[str, str]) -> set[str]:
    """The files that a bundle's own README, in either of its forms, says are compiled; none where it cannot be read."""
    if "00README.json" in files:
        try:
            entries = json.loads(files["00README.json"])["sources"]
            return {e["filename"] for e in entries if e.get("usage") == "toplevel" and e.get("filename")}
        except (ValueError, LookupError, TypeError, AttributeError):
            return set()
    return set(re.findall(r"^[ \t]*(\S+)[ \t]+toplevelfile\b", files.get("00README.XXX", ""), re.M))


def main_tex(files: dict[str, str], title: str) -> str | None:
    """The file of a bundle to compile, None if no file has a class and a body.

    Those that the bundle's README lists go before all others; then the choice narrows to most of the title's words,
    to names that are not NOT_THE_PAPER, to the largest and to the first by name.
    """
    bare = {n: re.sub(r"(?<!\\)%.*", "", t) for n, t in files.items() if n.lower().endswith(".tex")}
    left = sorted(n for n, t in bare.items() if "\\documentclass" in t and "\\begin{document}" in t)
    wanted = {w for w in re.findall("[a-z0-9]+", title.lower()) if len(w) > 3}

    def words_found(n: str) -> int:
        return len(wanted.intersection(re.findall("[a-z0-9]+", (tex_title(bare[n]) or "").lower())))

    def plain(n: str) -> bool:
        return not re.search(NOT_THE_PAPER, n.rsplit("/", 1)[-1], re.I)

    for worth in (listed_files(files).__contains__, words_found, plain, lambda n: len(files[n])):
        most = max(map(worth, left), default=None)
        left = [n for n in left if worth(n) == most]
    return left[0] if left else None


def citation_pdf_url(page: str, base: str) -> str | None:
    """The address of a landing page's PDF, as the page's own metadata gives it."""
    from urllib.parse import urljoin

    for tag in re.findall(r"<meta\b[^>]*>", page, re.I):
        if re.search(r"name\s*=\s*[\"']?citation_pdf_url", tag, re.I):
            found = re.search(r"content\s*=\s*[\"']([^\"']+)", tag, re.I)
            return urljoin(base, found.group(1)) if found else None
    return None


def landing_pdf(page: Column, base: str) -> Column:
    """citation_pdf_url as an expression; only addresses of the forms http(s)://..., /... and name are resolved."""
    tag = F.regexp_extract(page, r"(?i)<meta\b(?=[^>]*name\s*=\s*[\"']?citation_pdf_url)[^>]*>", 0)
    found = F.regexp_extract(tag, r"(?i)content\s*=\s*[\"']([^\"']+)", 1)
    site, folder = re.match(r"\w+://[^/]*", base)[0], base.rsplit("/", 1)[0]
    whole = F.when(found.rlike(r"^\w+://"), found).when(found.startswith("/"), F.concat(F.lit(site), found)).otherwise(F.concat(F.lit(folder + "/"), found))
    return F.when(found != "", whole)


def xml_licence(column: str = "xml"):
    """The licence of a harvested XML record, namespaces aside; an error record raises."""
    plain = F.regexp_replace(F.regexp_replace(F.col(column), r"\sxmlns(:\w+)?=\"[^\"]*\"", ""), r"<(/?)\w+:", "<$1")
    error = F.xpath_string(plain, F.lit("//error"))
    return F.when(error != "", F.raise_error(error)).otherwise(F.nullif(F.trim(F.xpath_string(plain, F.lit("//license"))), F.lit("")))


class Fetcher:
    """A polite client: a pause for each host, a size limit, retries of passing failures and a breaker for hosts that refuse."""

    PASSING = frozenset((408, 425, 429, 500, 502, 503, 504))

    def __init__(self, get: Callable[[str], tuple[int, dict, bytes]], pause: float = 1.0, limit: int = 200 << 20, retries: int = 3, refusals: int = 8, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        self.get, self.pause, self.limit, self.retries, self.refusals, self.sleep, self.clock = get, pause, limit, retries, refusals, sleep, clock
        self.last: dict[str, float] = {}
        self.refused: dict[str, int] = {}

    def fetch(self, url: str) -> bytes:
        host = re.sub(r"^\w+://([^/:]+).*$", r"\1", url)
        for attempt in range(1, self.retries + 1):
            if self.refused.get(host, 0) >= self.refusals:
                raise OSError(f"{host} refuses")
            wait = self.last.get(host, -1e9) + self.pause - self.clock()
            if wait > 0:
                self.sleep(wait)
            self.last[host] = self.clock()
            status, headers, body = self.get(url)
            if status == 200:
                self.refused[host] = 0
                if len(body) > self.limit:
                    raise OSError("too large")
                return body
            self.refused[host] = self.refused.get(host, 0) + (status in (403, 429))
            if status not in self.PASSING or attempt == self.retries:
                raise OSError(f"status {status}")
            after = headers.get("retry-after", "")
            self.sleep(min(int(after), 120) if after.isdigit() else 10 * attempt)
        raise OSError("no attempt left")


def fetched(urls: DataFrame, client: Callable[[], Fetcher]) -> DataFrame:
    """url, content, error, seconds of urls(url, host): each host's requests one after another in one task, by one client a task."""

    def run(frames):
        c = client()
        for f in frames:
            rows = []
            for url in f["url"]:
                begun = c.clock()
                try:
                    rows.append((url, c.fetch(url or ""), None, c.clock() - begun))
                except OSError as e:
                    rows.append((url, None, str(e), c.clock() - begun))
            yield pd.DataFrame(rows, columns=["url", "content", "error", "seconds"])

    dealt = urls.select("url", "host").repartition("host").sortWithinPartitions("host")
    return dealt.select("url").mapInPandas(run, "url string, content binary, error string, seconds double")


#: Signs of a page that asks whether its reader is a person.
BOT_CHECK = "captcha|are you a robot|casino"


def full_text(record: dict, getters: dict[str, Callable[[dict], bytes]]) -> dict:
    """The first of a record's sources that gives its text, and why those before it did not.

    A source whose name ends in -pdf has to give a PDF, any other a bundle with a TeX file; a source without a getter is an error of its own.
    """
    errors = []
    for source in record["sources"]:
        if source not in getters:
            errors.append(f"{source}: no such source")
            continue
        try:
            data = getters[source](record)
            if source.endswith("-pdf"):
                if sniff(data) != "pdf":
                    page = data[:20000].decode("utf-8", "replace")
                    raise OSError("a bot check" if re.search(BOT_CHECK, page, re.I) else "not a PDF")
                return {"source": source, "kind": "pdf", "errors": errors}
            if not any(n.endswith(".tex") for n in unpack(data)):
                raise OSError("no TeX file")
            return {"source": source, "kind": "tex", "errors": errors}
        except (OSError, EOFError, ValueError, tarfile.TarError) as e:
            errors.append(f"{source}: {e}")
    return {"source": None, "kind": None, "errors": errors}


def full_texts(papers: DataFrame, getters: dict[str, Callable[[dict], bytes]]) -> DataFrame:
    """bib, source, kind, errors of papers(bib, sources, ...); a getter sees the whole row."""

    def run(frames):
        for f in frames:
            got = [full_text(r | {"sources": list(r["sources"]) if r["sources"] is not None else []}, getters) for r in f.to_dict("records")]
            yield pd.DataFrame({"bib": f["bib"]} | {k: [g[k] for g in got] for k in ("source", "kind", "errors")})

    return papers.mapInPandas(run, "bib string, source string, kind string, errors array<string>")


def main_files(bundles: DataFrame) -> DataFrame:
    """bundle, name of the main TeX file, null where there is none, of bundles(bundle, title, files: map of name to text)."""

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"bundle": f["bundle"], "name": [main_tex(dict(m), t or "") for m, t in zip(f["files"], f["title"], strict=True)]})

    return bundles.select("bundle", "title", "files").mapInPandas(run, "bundle long, name string")


def read_document(spark: SparkSession, path: str) -> str:
    """A document that goes into prompts as a whole."""
    return "".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()).strip()


class TableStore:
    """Versioned tables without a table format: every write is a new folder, and an empty pointer file of its name.

    The pointer is made through Spark's file system, last, and none is replaced: the current version is the pointer of the
    largest name, so a reader or a crash at any time finds the old version or the new one. One writer.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self, name: str) -> list[str]:
        folder = self._path(f"{self.root}/{name}/_versions")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def exists(self, name: str) -> bool:
        return bool(self._versions(name))

    def version(self, name: str) -> str:
        return self._versions(name)[-1]

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/{self.version(name)}")

    def write(self, name: str, df: DataFrame) -> str:
        held = self._versions(name)
        # later than every version before it, whatever the clock says
        number = max(time.time_ns(), int(held[-1][1:21]) + 1 if held else 0)
        version = f"v{number:020d}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.root}/{name}/{version}")
        self._fs.create(self._path(f"{self.root}/{name}/_versions/{version}"), False).close()
        return version

    def upsert(self, name: str, new: DataFrame, key: str) -> None:
        from quillstone.operators.records import upsert

        self.write(name, upsert(self.read(name), new, key) if self.exists(name) else new)

    def delete(self, name: str, keys: DataFrame, key: str) -> int:
        old = self.read(name)
        n = old.join(keys.select(key), key, "left_semi").count()
        self.write(name, old.join(keys.select(key), key, "left_anti"))
        return n

    def replace_groups(self, name: str, new: DataFrame, group: str) -> None:
        from quillstone.operators.records import replace_groups

        self.write(name, replace_groups(self.read(name), new, group))

    def patch(self, name: str, changes: dict) -> None:
        self.write(name, self.read(name).withColumns(changes))

    def evolve(self, name: str, schema: str) -> None:
        """Columns that the table lacks are added, null in old rows."""
        empty = self.spark.createDataFrame([], schema)
        self.write(name, self.read(name).unionByName(empty, allowMissingColumns=True))

    def drop(self, name: str, sure: bool = False) -> None:
        if not sure:
            raise ValueError("dropping a table has to be confirmed")
        self._fs.delete(self._path(f"{self.root}/{name}"), True)


def settings(name: str, env: dict[str, str], dotenv: str = "") -> str:
    """A credential from the environment, else from a .env text."""
    if env.get(name):
        return env[name]
    for line in dotenv.splitlines():
        k, eq, v = line.partition("=")
        if eq and k.strip() == name:
            return v.strip().strip("\"'")
    raise KeyError(f"{name} is not set")


def questions_of(text: str, mode: str = "full") -> list[dict]:
    """Items of a questions or results file; results of another mode are refused."""
    got = json.loads(text)
    if isinstance(got, dict):
        if got.get("mode") != mode:
            raise ValueError(f"results of mode {got.get('mode')}")
        return got["items"]
    return got
