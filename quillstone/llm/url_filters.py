"""URL filters (operator 4): host and path rules, then a Bloom filter cascade over the hosts, in DataFrame functions only.

The listed keys are the hosts of the corpus that stand in a table of listed domains, or below one. The cascade holds them over the
corpus's complete key universe: level 0 is a Bloom filter of the listed
keys; level 1 encodes the unlisted keys that pass level 0, level 2 the listed keys that pass level 1, and so on
until no key is left. A key of the universe is listed exactly if the first level that it fails is odd (or, where it
passes all levels, if the last level is even), so membership needs no look-up of the key. Up to MAX_BITS the levels are literals in the
query. A larger cascade is dealt to shards by the hash of the key: each shard has levels of its own, of about SHARD_BITS,
and a row meets the levels of its shard (salted, so that a hot host is spread), never the list.

Defined results: a null url or one without :// has an empty host and path, fits no rule and is allowed; repeated rows
are judged each by itself; null, empty and repeated domains of the list count for nothing; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import materialise

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Names of listed sites; the default table of domains holds each under ENDINGS.
LISTED = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
ENDINGS = ("com", "net", "org", "example.com", "example.net", "example.org")
FPP = 0.02
MAX_BITS = 1 << 25
SHARD_BITS = 1 << 15
SALTS = 16


@dataclass(frozen=True)
class Level:
    bits: int  # of a shard
    hashes: int
    words: str | None  # JSON array of 64-bit words; None where the words are in the cascade's table


@dataclass(frozen=True)
class Cascade:
    levels: list[Level]
    shards: int
    table: DataFrame | None  # shard, w0, w1, ...: words by level

    def shard(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit("shard")), F.lit(self.shards)).cast("int")


def _places(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(j)), F.lit(bits)) for j in range(hashes)]


def passes(key: Column, number: int, level: Level) -> Column:
    words = F.col(f"w{number}") if level.words is None else F.from_json(F.lit(level.words), "array<bigint>")
    out = F.lit(True)
    for p in _places(key, number, level.bits, level.hashes):
        word = F.element_at(words, (F.floor(p / 64) + 1).cast("int"))
        out = out & (F.getbit(word, F.pmod(p, F.lit(64)).cast("int")) == 1)
    return F.coalesce(out, F.lit(False))  # a shard without keys on a level lets nothing through


def member(key: Column, levels: list[Level]) -> Column:
    """Whether a key of the universe is listed."""
    out = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        out = F.when(passes(key, i, levels[i]), out).otherwise(F.lit(i % 2 == 1))
    return out


def build_cascade(universe: DataFrame, fpp: float = FPP, max_bits: int = MAX_BITS, shard_bits: int = SHARD_BITS) -> Cascade:
    """The cascade over universe(key, listed), whose keys are distinct."""
    size = universe.agg(F.count_if("listed").alias("listed"), F.count_if(~F.col("listed")).alias("free")).first()
    a_key = -math.log(fpp) / math.log(2) ** 2
    # a listed key stands in level 0, an unlisted one in level 1 with the probability fpp, and so on
    expected = a_key * (size["listed"] + fpp * size["free"]) / (1 - fpp)
    cascade = Cascade([], 1 if expected <= max_bits else math.ceil(expected / shard_bits), None)
    levels, table = cascade.levels, None
    left = universe.withColumn("shard", cascade.shard(F.col("key")))
    while True:
        number = len(levels)
        own = left.filter(F.col("listed") == (number % 2 == 0))
        n = own.groupBy("shard").count().agg(F.max("count")).first()[0]
        if not n:
            return Cascade(levels, cascade.shards, table)
        bits = max(64, math.ceil(n * a_key / 64) * 64)
        hashes = max(1, round(bits / n * math.log(2))) if n > 8 else 4
        place = F.explode(F.array(*_places(F.col("key"), number, bits, hashes))).alias("p")
        words = own.select("shard", place).groupBy("shard", F.floor(F.col("p") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("v"))
        if cascade.shards == 1:
            flat = [0] * (bits // 64)
            for r in words.collect():
                flat[r["w"]] = r["v"]
            levels.append(Level(bits, hashes, "[" + ",".join(map(str, flat)) + "]"))
            # keys of the other side that this level lets through go to the next one; its own keys stay to be told from them
            left = left.filter(passes(F.col("key"), number, levels[-1]))
        else:
            empty = own.select("shard").distinct().select("shard", F.explode(F.sequence(F.lit(0), F.lit(bits // 64 - 1))).alias("w"), F.lit(0).cast("long").alias("v"))
            full = words.unionByName(empty).groupBy("shard", "w").agg(F.bit_or("v").alias("v"))
            full = full.groupBy("shard").agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "v"))), lambda x: x["v"]).alias(f"w{number}"))
            full = materialise(full, "level")
            levels.append(Level(bits, hashes, None))
            left = materialise(left.join(full, "shard", "left").filter(passes(F.col("key"), number, levels[-1])).select(left.columns), "left")
            table = full if table is None else materialise(table.join(full, "shard", "full_outer"), "levels")


def with_membership(rows: DataFrame, cascade: Cascade, key: str, name: str) -> DataFrame:
    """rows with `name`: whether the key is listed."""
    if cascade.table is None:
        return rows.withColumn(name, member(F.col(key), cascade.levels))
    salted = cascade.table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumns({"_shard": cascade.shard(F.col(key)), "_salt": F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")})
    met = dealt.join(salted.withColumnRenamed("shard", "_shard").hint("merge"), ["_shard", "_salt"], "left")
    return met.select(*rows.columns, member(F.col(key), cascade.levels).alias(name))


def url_parts(url: Column) -> tuple[Column, Column]:
    pattern = "://([^/?#]*)([^?#]*)"
    url = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), string.ascii_uppercase, string.ascii_lowercase), F.regexp_extract(url, pattern, 2)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def listed_domains(spark: SparkSession) -> DataFrame:
    """The default table of listed domains."""
    names = [f"{name}.{end}" for name in LISTED for end in ENDINGS]
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(names)), "array<string>")).alias("domain"))


def host_universe(hosts: DataFrame, domains: DataFrame) -> DataFrame:
    """key, listed of the distinct hosts(key): listed if the host or a domain above it is in domains(domain)."""
    names = domains.select(F.lower(F.trim("domain")).alias("name")).filter("name <> ''").distinct()
    labels = F.split("key", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = hosts.select("key", F.explode(above).alias("name")).join(names, "name", "left_semi").select("key").distinct()
    return hosts.join(found.withColumn("hit", F.lit(True)), "key", "left").select("key", F.coalesce("hit", F.lit(False)).alias("listed"))


def filter_urls(pages: DataFrame, domains: DataFrame | None = None, rules=RULES, fpp: float = FPP, max_bits: int = MAX_BITS, shard_bits: int = SHARD_BITS) -> DataFrame:
    """page_id, host, path, rule and verdict of every url. domains: a table with the column domain."""
    if domains is None:
        domains = listed_domains(pages.sparkSession)
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    universe = materialise(host_universe(rows.select(F.col("host").alias("key")).distinct(), domains), "hosts")
    rows = with_membership(rows, build_cascade(universe, fpp, max_bits, shard_bits), "host", "bad")
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("bad"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _oracle() -> str:
    whens = []
    for what, text in sorted(RULES, key=lambda r: -len(r[1])):
        name, slash, rest = text.partition("/")
        whens.append((f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash}{rest}')", what, text))
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{t}'" for c, _, t in whens) + " END"
    names = [f"{name}.{end}" for name in LISTED for end in ENDINGS]
    listed = f"len(list_filter({names}, lambda d: host = d OR ends_with(host, '.' || d))) > 0"
    verdict = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v, _ in whens) + f" WHEN {listed} THEN 'block' ELSE 'allow' END"
    up, low = string.ascii_uppercase, string.ascii_lowercase
    return f"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), '{up}', '{low}') AS host, regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages)
SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict FROM u"""


ORACLE = _oracle()
