"""N-gram Jaccard self-join (operator 8): MinHash bands, Bayesian pruning of candidates, exact verification.

Texts are lower-cased and cut into words (runs of characters other than space and 0x09-0x0D); a text's features are
the distinct runs of N words, or all its words where it has fewer. Texts with the same words form a class of copies,
which counts once from there on. Signatures of BANDS * ROWS MinHash values, kept to 8 bits each, are cut into bands;
classes that share a band are candidates. Within a band's group the values of two signatures are compared STEP at a
time, and a pair is dropped once the posterior probability that its Jaccard similarity reaches the threshold falls
below TOLERANCE. What is left is verified exactly on the features. A pair is looked at only in the first band that
it shares. Groups of more than BLOCK classes, or of more than BLOCK_BYTES of features, are cut into blocks, and pairs of
blocks are compared in tasks of their own, whose memory follows neither the group nor the length of its texts. Tasks give each class its number of links and a spanning forest of the links, never all pairs, so the output
is linear in the rows even where a group is dense.

Result: one row per input row with class_id (the smallest doc_id of the connected component of its links) and
n_links (the number of other rows with a similarity of the threshold or more, copies included).

A pair at the threshold shares no band with a probability of 3e-6 (32 bands of 5 rows at 0.8).

Defined results: null texts count as empty; a text without words has no features and is a class by itself without
links; repeated rows are copies of each other; a null doc_id is ignored when the smallest is taken and gives a null
class where there is no other; an empty table gives no rows; further columns are ignored; bytes that are not UTF-8 count as U+FFFD.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import discard, materialise, slices, utf8
from quillstone.llm.components import components
from quillstone.llm.textstats import Words, mix, windows, words_of

N = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 5
STEP = 16
TOLERANCE = 1e-6
BLOCK = 1024
BLOCK_BYTES = 64 << 20
AT_ONCE = 1 << 21  # features that are compared at once
BROADCAST_ROWS = 2_000_000
_MULT = (np.random.default_rng(20240607).integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_XOR = np.random.default_rng(20240608).integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)


def features(w: Words, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct features, in order of row and hash."""
    at, h = windows(w, n)
    doc = w.doc[at]
    words = np.diff(w.first)
    short = np.flatnonzero((words > 0) & (words < n))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = words[short] > k
            whole[has] = mix(whole[has] * np.uint64(0x9FB21C651E98DF25) + w.hash[w.first[short[has]] + k] + np.uint64(k + 1))
        doc, h = np.concatenate((doc, short)), np.concatenate((h, whole))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[fresh], h[fresh]


def bands_of(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(features a row, band values): 8 bits of each MinHash value, ROWS to a value, the band's number above them."""
    size = np.bincount(doc, minlength=n)
    has = np.flatnonzero(size)
    sig = np.zeros((n, BANDS * ROWS), np.uint32)
    if len(has):
        first = np.concatenate(([0], np.cumsum(size[has])))[:-1]
        low = (h >> np.uint64(32)).astype(np.uint32)
        for k in range(BANDS * ROWS):
            sig[has, k] = np.minimum.reduceat((low ^ _XOR[k]) * _MULT[k], first)
    sig = (sig ^ (sig >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    sig = (sig ^ (sig >> np.uint32(12))) & np.uint32(255)
    value = np.zeros((n, BANDS), np.int64)
    for k in range(ROWS):
        value |= sig.reshape(n, BANDS, ROWS)[:, :, k].astype(np.int64) << (8 * k)
    return size, value | (np.arange(BANDS, dtype=np.int64) << 40)


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> np.ndarray:
    """For 0, STEP, 2 * STEP ... values compared: the fewest matches at which the posterior stays at the tolerance (uniform prior)."""
    s = (np.arange(2000) + 0.5) / 2000
    p = s + (1 - s) / 256
    out = [0]
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        m = np.arange(n + 1)[:, None]
        like = m * np.log(p) + (n - m) * np.log1p(-p)
        like = np.exp(like - like.max(1, keepdims=True))
        mass = like[:, s >= threshold].sum(1) / like.sum(1)
        out.append(int(np.argmax(mass >= tolerance)))
    return np.array(out)


def _key(words: bytes) -> tuple[int, int]:
    d = hashlib.md5(words, usedforsecurity=False).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _keys(data: np.ndarray, off: np.ndarray) -> list[tuple[int, int]]:
    raw = data.tobytes()
    return [_key(b" ".join(raw[a:b].split())) for a, b in zip(off[:-1], off[1:], strict=True)]


def _whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, start of each run) with all rows of a key together, from batches sorted by the keys."""
    held: list[pa.Table] = []

    def changes(t: pa.Table) -> np.ndarray:
        change = np.zeros(t.num_rows, bool)
        change[0] = True
        for k in keys:
            v = t.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        return change

    def whole(parts: list[pa.Table]) -> tuple[pa.Table, np.ndarray]:
        t = pa.concat_tables(parts).combine_chunks()
        return t, np.flatnonzero(changes(t))

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        cut = int(np.flatnonzero(changes(t))[-1])
        if held and not cut and not changes(pa.concat_tables([held[-1].slice(held[-1].num_rows - 1), t.slice(0, 1)]))[1]:
            held.append(t)
            continue
        if held or cut:
            yield whole([*held, t.slice(0, cut)])
        held = [t.slice(cut)]
    if held:
        yield whole(held)


def _fixed(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The features of every row, as views of the column's bytes."""
    return [data[i:j].view(np.uint64) for data, off in map(utf8, column.chunks) for i, j in zip(off[:-1], off[1:], strict=True)]


def candidate_pairs(band: np.ndarray, n: np.ndarray, own: np.ndarray, crossed: np.ndarray, starts: np.ndarray, values: np.ndarray, threshold: float, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of the same run that survive the pruning. crossed: only pairs of different blocks count."""
    rows = len(n)
    stop = np.repeat(np.append(starts[1:], rows), np.diff(np.append(starts, rows)))
    sig = values.astype("<i8").view(np.uint8).reshape(rows, BANDS, 8)[:, :, :ROWS].reshape(rows, BANDS * ROWS)
    columns = np.arange(BANDS)
    pending_a, pending_b, waiting = [], [], 0

    def prune(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shared = values[a] == values[b]
        first = ~(shared & (columns[None, :] < band[a][:, None])).any(1)
        a, b = a[first], b[first]
        matches = np.zeros(len(a), np.int64)
        for k in range(1, len(least)):
            part = slice((k - 1) * STEP, k * STEP)
            matches = matches + (sig[a, part] == sig[b, part]).sum(1)
            alive = matches >= least[k]
            a, b, matches = a[alive], b[alive], matches[alive]
        return a, b

    d, at = 1, np.arange(rows)
    while True:
        at = at[stop[at] > at + d]
        if not len(at):
            break
        b = at + d
        ok = (np.minimum(n[at], n[b]) >= threshold * np.maximum(n[at], n[b]) - 1e-9) & (~crossed[at] | (own[at] != own[b]))
        pending_a.append(at[ok])
        pending_b.append(b[ok])
        waiting += int(ok.sum())
        if waiting > 30_000:
            yield prune(np.concatenate(pending_a), np.concatenate(pending_b))
            pending_a, pending_b, waiting = [], [], 0
        d += 1
    if waiting:
        yield prune(np.concatenate(pending_a), np.concatenate(pending_b))


def exact_links(a: np.ndarray, b: np.ndarray, sets: list[np.ndarray], threshold: float, at_once: int = AT_ONCE) -> np.ndarray:
    """Which pairs reach the threshold. sets: sorted features of each row.

    Intersections are counted against a marked vocabulary, one left side at a time, and for one range of the features after the other,
    so that about `at_once` of them are copied.
    """
    if not len(a):
        return np.zeros(0, bool)
    order = np.argsort(a, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(a[order])) + 1)
    used = np.unique(np.concatenate((a, b)))
    size = np.array([len(sets[i]) for i in used])
    ranges = max(1, -(-int(size.sum()) // at_once))
    ends = np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)
    cuts = np.array([[0, *np.searchsorted(sets[i], ends), n] for i, n in zip(used, size, strict=True)])
    common = np.zeros(len(a), np.int64)
    for k in range(ranges):
        vocabulary, ids = np.unique(np.concatenate([sets[i][x:y] for i, x, y in zip(used, cuts[:, k], cuts[:, k + 1], strict=True)]), return_inverse=True)
        bounds = np.concatenate(([0], np.cumsum(cuts[:, k + 1] - cuts[:, k])))
        place = {int(i): ids[x:y] for i, x, y in zip(used, bounds[:-1], bounds[1:], strict=True)}
        marked = np.zeros(len(vocabulary), bool)
        for group in groups:
            left = place[int(a[group[0]])]
            marked[left] = True
            for part in np.array_split(group, max(1, len(group) // 256)):
                rights = [place[int(x)] for x in b[part]]
                first = np.concatenate(([0], np.cumsum([len(x) for x in rights])))
                hits = np.concatenate(([0], np.cumsum(marked[np.concatenate(rights)])))
                common[part] += hits[first[1:]] - hits[first[:-1]]
            marked[left] = False
    total = size[np.searchsorted(used, a)] + size[np.searchsorted(used, b)]
    return common >= threshold * (total - common) - 1e-9


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    root = np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
    return np.array([find(x) for x in range(n)], np.int64)


def _profile(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, th (hash of the raw text), k1, k2 (of its words), size and bands."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                data, off = utf8(pc.utf8_lower(batch.column(2).fill_null("")))
                size, bands = bands_of(*features(words_of(data, off), n), batch.num_rows)
                k1, k2 = zip(*_keys(data, off), strict=True)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * batch.num_rows + 1, BANDS, dtype=np.int32)), pa.array(bands.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(size.astype(np.int32)), lists], names=["doc_id", "th", "k1", "k2", "size", "bands"])

    return _raw(docs).mapInArrow(profile, "doc_id long, th long, k1 long, k2 long, size int, bands array<long>")


def _raw(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.make_valid_utf8(text).alias("text"))


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, block: int = BLOCK, tolerance: float = TOLERANCE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, th (xxhash64 of the text), group (a name of the class), class_id and n_links of every row."""
    least = least_matches(threshold, tolerance)
    base = materialise(_profile(docs, n), "profiles")
    reps = base.filter("size > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("th").alias("th"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    reps = materialise(reps, "classes")

    exploded = reps.select("k1", "k2", "size", F.explode("bands").alias("band"))
    groups = exploded.groupBy("band").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("features"), F.bit_xor(F.xxhash64("k1", "k2")).alias("who")).filter("members > 1")
    groups = groups.groupBy("members", "features", "who").agg(F.min("band").alias("band"))  # of bands with the same members the first is enough
    groups = materialise(groups.select("band", "members", "features"), "groups")
    members = exploded.drop("size").join(groups, "band")
    n_blocks = F.ceil(F.greatest(F.col("members") / F.lit(block), F.col("features") * 8 / F.lit(block_bytes))).cast("int")
    members = members.withColumn("own", F.pmod(F.xxhash64("k1", "k2", F.lit("block")), n_blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    members = members.select("band", F.least("own", "other").alias("gi"), F.greatest("own", "other").alias("gj"), "own", "k1", "k2")

    def pairs_of(t: pa.Table, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        col = {k: t.column(k).to_numpy() for k in ("band", "gi", "gj", "own", "size")}
        return candidate_pairs(col["band"] >> 40, col["size"].astype(np.int64), col["own"], col["gi"] != col["gj"], starts, _fixed(t.column("bands"), BANDS), threshold, least)

    keys = ["band", "gi", "gj"]

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _whole_runs(batches, keys):
            alive = np.zeros(t.num_rows, bool)
            for a, b in pairs_of(t, starts):
                alive[a] = alive[b] = True
            if alive.any():
                yield from t.select([*keys, "own", "k1", "k2"]).filter(pa.array(alive)).combine_chunks().to_batches()

    with_bands = members.join(reps.select("k1", "k2", "size", "bands"), ["k1", "k2"]).select(*keys, "own", "k1", "k2", "size", "bands")
    alive = with_bands.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(candidates, "band long, gi int, gj int, own int, k1 long, k2 long")
    alive = materialise(alive, "candidates")

    # features of the candidates alone, from one row of each class
    wanted = materialise(reps.join(alive.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").select("th").distinct(), "wanted")
    small = wanted.count() <= BROADCAST_ROWS
    picked = _raw(docs).join(F.broadcast(wanted) if small else wanted, "th", "left_semi").select("doc_id", "th", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                data, off = utf8(pc.utf8_lower(batch.column(2).fill_null("")))
                doc, h = features(words_of(data, off), n)
                cut = np.searchsorted(doc, np.arange(batch.num_rows + 1))
                k1, k2 = zip(*_keys(data, off), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array([h[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["k1", "k2", "f"])

    # of rows with the same raw text one goes on, picked before the shuffle: copies never meet in one task
    own_sets = materialise(picked.dropDuplicates(["th"]).mapInArrow(sets, "k1 long, k2 long, f binary").dropDuplicates(["k1", "k2"]), "features")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _whole_runs(batches, keys):
            found = [np.zeros((2, 0), np.int64)]
            feats = _sets(t.column("f"))
            for a, b in pairs_of(t, starts):
                yes = exact_links(a, b, feats, threshold)
                found.append(np.stack((a[yes], b[yes])))
            a, b = np.concatenate(found, 1)
            copies = t.column("copies").to_numpy()
            links = np.bincount(a, copies[b], minlength=t.num_rows) + np.bincount(b, copies[a], minlength=t.num_rows)
            on = np.flatnonzero(links)
            root = _roots(t.num_rows, a, b)[on]
            k1, k2 = t.column("k1").to_numpy(), t.column("k2").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[on], k2[on], k1[root], k2[root], links[on].astype(np.int64))], names=["k1", "k2", "r1", "r2", "links"])

    full = alive.join(reps.select("k1", "k2", "size", "copies", "bands"), ["k1", "k2"]).join(own_sets, ["k1", "k2"])
    full = full.select(*keys, "own", "k1", "k2", "size", "copies", "bands", "f").repartition(*keys).sortWithinPartitions(*keys)
    forest = materialise(full.mapInArrow(verify, "k1 long, k2 long, r1 long, r2 long, links long"), "links")

    nodes = forest.groupBy("k1", "k2").agg(F.sum("links").alias("links"))
    nodes = materialise(nodes.withColumn("v", F.monotonically_increasing_id()), "nodes")
    ends = nodes.select(F.col("k1").alias("r1"), F.col("k2").alias("r2"), F.col("v").alias("u"))
    edges = forest.select("k1", "k2", "r1", "r2").join(nodes.select("k1", "k2", "v"), ["k1", "k2"]).join(ends, ["r1", "r2"]).select("u", "v")
    roots = components(edges)
    linked = nodes.join(roots, "v", "left").join(reps.select("k1", "k2", "rep"), ["k1", "k2"])
    smallest = linked.groupBy("root").agg(F.min("rep").alias("class_id"))
    linked = linked.join(smallest, "root").select("k1", "k2", "links", "class_id", "root")
    classes = reps.select("k1", "k2", "rep", "copies").join(linked, ["k1", "k2"], "left")
    group = F.coalesce(F.concat(F.lit("c"), "root"), F.concat_ws(":", "k1", "k2"))
    classes = materialise(classes.select("k1", "k2", group.alias("group"), F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "answers")
    discard(reps, groups, alive, wanted, own_sets, forest, nodes)
    rows = base.select("doc_id", "th", "k1", "k2", "size").join(classes, ["k1", "k2"], "left")
    alone = F.col("size") == 0
    group = F.when(alone, F.concat_ws(":", F.lit("e"), "doc_id", "th")).otherwise(F.col("group"))
    return rows.select("doc_id", "th", group.alias("group"), F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"))


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """doc_id, class_id, n_links of every row."""
    return near_classes(docs, threshold, n).drop("th", "group")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """The rows of docs with the smallest doc_id of their component (ties: the smallest hash of the text), one of each.

    Texts without words all stay, identical rows once.
    """
    near = near_classes(docs, threshold, n)
    # nulls are the smallest in a struct; an id counts as smaller than none
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("w")
    winners = near.groupBy("group").agg(best).select("w.doc_id", "w.th")
    # the row goes into a struct, so its columns may have any names
    keys = {"d": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "z": F.col("doc_id").isNull()}
    winners = winners.select(*[c.alias(k) for k, c in keys.items()], F.col("th").alias("h"))
    row = F.struct(*docs.columns).alias("row")
    rows = docs.select(*[c.alias(k) for k, c in keys.items()], F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("h"), row)
    # repeated rows are reduced before the shuffle as well as after it, so they never meet in one task
    return rows.join(winners, ["d", "z", "h"], "left_semi").dropDuplicates(["d", "z", "h"]).select("row.*")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
