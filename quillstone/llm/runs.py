"""Periodic runs of words (operator 13), after Ellert and Fischer: Lyndon arrays over an ordered alphabet of words.

For both orders of the alphabet the next smaller suffix of every position is found from left to right (`lyndon_edges`). A comparison
of two suffixes starts from what is known: two common extensions of different length fix a third; within the matched stretch that
reaches furthest to the right a position has the edges of its copy, and only where such an edge reaches the stretch's end are
words compared, beyond it. So the furthest matched place only moves to the right. A run's repeated unit starts, for one of the orders, as
a longest Lyndon word, so every edge whose extension is at least as long as itself gives a run, and every run
of three periods is given. No suffix array, suffix tree or hash is used: words become symbols by sorting their bytes.

Before that a stretch of words that can hold no run is set aside, exactly: in a run every three neighbouring words occur again in
the same text, so only stretches of such triples, long enough for a run, are looked at (`stretches`). A run lies within one
stretch and its ends are the same there as in the text.

Defined results: null and empty texts have no words and no runs, and collapse to the empty text; words are cut at ASCII white space only;
repeated rows are each judged by themselves; ties of the strongest run go to the smaller start, then period; an empty table gives
no rows; further columns are ignored. Memory is bounded by the slices of a batch (about SLICE bytes) or one text, if it is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import slices, utf8

LEAST, REPEATS = 24, 3
SLICE = 1 << 21
WORD = r"[^\x20\x09-\x0D]+"
_RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def lyndon_edges(t: list[int]) -> tuple[list[int], list[int], int]:
    """(next smaller suffix of each position, length of the common extension with it, words compared); the end is the smallest symbol."""
    n = len(t)
    nxt, n_ext, prv, p_ext = [n] * n, [0] * n, [-1] * n, [0] * n
    x = y = reach = compared = 0  # t[x : x + reach - y] is t[y : reach], and nothing was matched beyond reach
    for i in range(1, n):
        j, ext, exact = i - 1, 0, False
        while True:
            if not exact:
                if y < i < reach:
                    # the copy of i within the matched stretch, and the pair that j and i have there
                    c = i - y + x
                    k = j - y + x if j >= y else j
                    m = n_ext[k] if nxt[k] == c else p_ext[c] if prv[c] == k else -1
                    if 0 <= m < reach - i:
                        ext, exact = m, True
                    elif m >= 0 and reach - i > ext:
                        ext = reach - i
                if not exact:
                    begun = ext
                    while i + ext < n and t[j + ext] == t[i + ext]:
                        ext += 1
                    compared += ext - begun + 1
                    if i + ext > reach:
                        x, y, reach = j, i, i + ext
            if i + ext < n and t[j + ext] < t[i + ext]:
                prv[i], p_ext[i] = j, ext
                break
            nxt[j], n_ext[j] = i, ext
            k = prv[j]
            if k < 0:
                break
            # common extensions of (k, j) and (j, i): where they differ, that of (k, i) is the shorter one
            exact = p_ext[j] != ext
            ext = min(p_ext[j], ext)
            j = k
    return nxt, n_ext, compared


def runs_of(t: list[int], least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs of at least `least` symbols and `repeats` (two or more) periods, by start, then period."""
    found = {}
    for symbols in (t, [-s for s in t]):
        nxt, ext, _ = lyndon_edges(symbols)
        for i, j in enumerate(nxt):
            p, end = j - i, j + ext[i]
            # a run of `repeats` periods has an edge that starts within its first period
            if ext[i] >= (repeats - 2) * p and j < len(t) and (end, p) not in found:
                start = i
                while start and symbols[start - 1] == symbols[start - 1 + p]:
                    start -= 1
                found[end, p] = (start, end - start, p)
    return sorted((s, n, p) for s, n, p in found.values() if n >= max(least, repeats * p))


def _dense(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Ranks from 0 of rows that `order` sorts by the keys; equal rows share one."""
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def symbols(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A number for each word raw[start : start + length], equal for equal words only, by sorting: up to 8 bytes, then up to 32, then longer."""
    out, at = np.zeros(len(starts), np.int64), 0
    for low, high in ((0, 8), (8, 32)):
        pick = np.flatnonzero((lengths > low) & (lengths <= high))
        if not len(pick):
            continue
        begin, size = starts[pick], lengths[pick]
        keys = []
        for word in range(0, high, 8):
            key = np.zeros(len(pick), np.uint64)
            for k in range(word, word + 8):
                inside = size > k
                key = key << np.uint64(8) | np.where(inside, raw[np.where(inside, begin + k, 0)], 0).astype(np.uint64)
            keys.append(key)
        keys.append(size)  # tells padding from zero bytes
        order = np.lexsort(keys[::-1]) if len(keys) > 2 or (raw == 0).any() else np.argsort(keys[0], kind="stable")
        ranks = _dense(order, *keys)
        out[pick] = at + ranks
        at += int(ranks.max()) + 1
    long = [(raw[starts[k] : starts[k] + lengths[k]].tobytes(), k) for k in np.flatnonzero(lengths > 32)]
    before = None
    for word, k in sorted(long):
        at += word != before
        out[k], before = at, word
    return out


def words_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, of each text the number of words before it and after the last) of the words of the texts raw[off[i] : off[i + 1]]."""
    black = ~((raw == 0x20) | ((raw >= 9) & (raw <= 13)))
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    before = np.concatenate(([False], black[:-1])) & ~edge[:-1]
    after = np.concatenate((black[1:], [False])) & ~edge[1:]
    starts, ends = np.flatnonzero(black & ~before), np.flatnonzero(black & ~after) + 1
    return starts, ends - starts, np.searchsorted(starts, off)


def stretches(seq: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> Iterator[tuple[int, int, int]]:
    """(text, from, to) of the stretches of words, `least` at least, whose triples all occur again in the same text."""
    if len(seq) < 3 or least < 3:
        yield from ((k, a, b) for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)) if b - a >= least)
        return
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    width = int(seq.max()) + 1
    if width**3 < 1 << 63:
        keys = [seq[:-2] * width * width + seq[1:-1] * width + seq[2:]]
        order = np.argsort(keys[0], kind="stable")  # equal triples stay in order of text
    else:
        keys = [seq[:-2], seq[1:-1], seq[2:]]
        order = np.lexsort(keys[::-1])
    same = text[:-2][order][1:] == text[:-2][order][:-1]
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    again = np.zeros(len(seq), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    again[:-2] &= text[:-2] == text[2:]
    again[-2:] = False
    change = np.flatnonzero(np.diff(np.concatenate(([0], again.view(np.int8), [0]))))
    for a, b in zip(change[::2].tolist(), change[1::2].tolist(), strict=True):
        if b + 2 - a >= least:
            yield int(text[a]), a, b + 2


def collapse(raw: bytes, runs: list[tuple[int, int, int]]) -> bytes:
    """The words of a text joined by one space, without what each run repeats after its first period."""
    words = raw.split()  # of bytes: cut at ASCII white space
    for start, length, period in sorted(runs, reverse=True):
        words[start + period : start + length] = [None] * (length - period)
    return b" ".join([w for w in words if w is not None] if runs else words)


def periodic_runs(docs: DataFrame, least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """doc_id, runs (start, length, period of each, by start, then period), collapsed (the text without repeats) of every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                raw, off = utf8(batch.column(1))
                starts, lengths, bounds = words_of(raw, off)
                seq = symbols(raw, starts, lengths)
                found: list[list] = [[] for _ in range(batch.num_rows)]
                for k, a, b in stretches(seq, bounds, least):
                    found[k] += [(int(a - bounds[k]) + s, n, p) for s, n, p in runs_of(seq[a:b].tolist(), least, repeats)]
                texts = [collapse(raw[off[k] : off[k + 1]].tobytes(), r).decode() for k, r in enumerate(found)]
                listed = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in found]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(listed, kind), pa.array(texts, pa.string())], names=["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scan, f"doc_id long, runs {_RUNS}, collapsed string")


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text; every tenth document, by the checksum of its id, repeats some of its words to its end. Rows without an id stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), h.alias("h")).withColumn("w", words)
    rows = rows.withColumns({"g": F.floor(F.col("h") / 10), "n": F.coalesce(F.size("w"), F.lit(0))})
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    unit = F.slice("w", F.col("a") + 1, F.col("p"))
    rest = F.col("n") - F.col("a")
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs(with_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    # length / period compared by cross products, so exactly; runs come by start, then period, and the first of equals stays
    stronger = lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b)
    rows = rows.withColumn("best", F.aggregate("runs", F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), stronger))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
