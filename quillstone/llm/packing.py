"""Best-fit packing of token sequences (operator 10), bulk-synchronous.

Pieces are sorted by length and gaps (the free ends of open sequences) by size, both as runs of equal values: equal
pieces are interchangeable, and so are equal gaps. In a sweep every run of pieces looks for its successor among the gaps, the
smallest that is large enough. Where several runs meet on the same gaps, ranks decide: a run begins at its successor's
rank or behind the runs before it (a running maximum over prefix sums), so every gap gets one piece, and pieces that find
no gap wait. Then all gaps are updated and the next sweep begins. Pieces take part by classes of
length, long ones first (as in best-fit decreasing); short ones of equal length travel in bundles first, so a
large gap fills in few sweeps. When no piece of a class finds a gap any more, as many sequences are opened as its rest needs.

What is swept are runs, of which there are at most `capacity` of pieces, and in a sweep one more of gaps for each run of pieces that
takes part, whatever the corpus. So all sweeps together are one small task of one job (`plan_sequences`), and nothing comes to the
driver; what grows with the corpus is distributed: pieces are cut, counted by shard and length, ranked and placed where they
lie. The pieces themselves are never collected or sorted: a piece's rank within its run comes from counts by shard and
length (prefix sums by length), and its place from the matches of its length, which are broadcast: at most `capacity`
rows of bounded arrays.

Defined results: a null text counts as empty and gives one piece (the end id alone); repeated rows are packed
like any others, each by itself; ties of length are ordered by input shard and position; an empty table gives
no pieces; further columns of the input are ignored; bytes that are not UTF-8 count as U+FFFD.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, batched

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm.common import materialise, slices

CAPACITY = 2048
END_ID = 0
_PIECES = "doc_id long, shard int, local long, piece int, start long, length long, ids_crc32 long"
_ENCODERS: dict = {}


def _public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(json_path: str, rank_path: str | None):
    """A function text -> uint32 ids, equal to the tokenizers file's encode(add_special_tokens=False).

    The rank file holds the same vocabulary for a faster library; texts that spell a special token, and those
    that the faster library refuses, go to the tokenizers file itself.
    """
    key = (json_path, rank_path)
    if key in _ENCODERS:
        return _ENCODERS[key]
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]

    def exact(text: str) -> np.ndarray:
        return np.asarray(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    fast = exact
    if rank_path:
        import public_tokenizers
        import tiktoken

        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def fast(text: str) -> np.ndarray:
            if any(s in text for s in special):
                return exact(text)
            try:
                return quick.encode_to_numpy(text, disallowed_special=())
            except Exception:  # the quick library's regular expressions give up on some extreme texts
                return exact(text)

    _ENCODERS[key] = fast
    return fast


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, json_path: str | None = None, rank_path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """One row per piece: a document's ids and the end id, cut only where they exceed the capacity."""
    json_path = json_path or _public("byte_bpe_50k.json")
    rank_path = rank_path or _public("byte_bpe_50k.tiktoken")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(json_path, rank_path)
        shard, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids_of, rows = batch.column(0).to_pylist(), []
                for doc_id, text in zip(ids_of, batch.column(1).to_pylist(), strict=True):
                    ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                    at, first = 0, len(ids) % capacity or capacity
                    for piece in range(-(-len(ids) // capacity)):
                        n = first if piece == 0 else capacity
                        rows.append((doc_id, shard, int(seen[n]), piece, at, n, zlib.crc32(ids[at : at + n].tobytes())))
                        seen[n] += 1
                        at += n
                if rows:
                    names = ("doc_id", "shard", "local", "piece", "start", "length", "ids_crc32")
                    types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.make_valid_utf8(F.col("text").cast("string")).alias("text")).mapInArrow(cut, _PIECES)


MATCH = "rank long, n long, first long, offset long, q long"


def sweep(pieces: list[tuple[int, int]], gaps: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int | None, int | None]]:
    """One sweep over runs of pieces (size, k) and of gaps (size, first, n).

    Every gap appears once in the result: first, n and size of a run of gaps, and the size of the pieces they take with the
    number of pieces of that size before them, None where they take none.
    """
    gaps = sorted(gaps)
    before = [0, *accumulate(n for *_, n in gaps)]
    sizes, total = [g[0] for g in gaps], before[-1]
    taken: list[tuple[int, int, int]] = []
    end = 0
    for size, k in sorted(pieces):
        # its successor's rank, or behind the runs before it
        begin = max(end, before[bisect_left(sizes, size)])
        if begin < total:
            end = min(begin + k, total)
            taken.append((begin, end, size))
    taken.append((total, total + 1, 0))
    out, t = [], 0
    for (size, first, n), rank in zip(gaps, before, strict=False):
        at = rank
        while at < rank + n:
            while taken[t][1] <= at:
                t += 1
            begin, end, piece = taken[t]
            upto = min(end if begin <= at else begin, rank + n)
            out.append((first + at - rank, upto - at, size, *((piece, at - begin) if begin <= at else (None, None))))
            at = upto
    return out


def classes(capacity: int) -> list[tuple[int, int]]:
    """(lower, upper] bounds of lengths: of 1 to 8 pieces a sequence, then by halves."""
    uppers = [capacity // k for k in range(1, 9)] + [capacity >> k for k in range(4, capacity.bit_length())]
    uppers = sorted({u for u in uppers if u}, reverse=True)
    return list(zip(uppers[1:] + [0], uppers, strict=True))


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Matches (length, rank, n, first, offset, q) of all pieces, counted by length: the pieces of these ranks lie q to a sequence from `first` on."""
    left, rank = {k: n for k, n in counts.items() if n > 0}, dict.fromkeys(counts, 0)
    gaps: list[tuple[int, int, int]] = []
    matches: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0
    for lower, upper in classes(capacity):
        most = capacity // upper
        bundles = sorted({most, *(1 << k for k in range(most.bit_length()))}, reverse=True)
        while any(lower < k <= upper for k in left):
            for q in bundles:
                while True:
                    lengths = {k * q: k for k in left if lower < k <= upper and left[k] >= q}
                    least = min(lengths, default=capacity + 1)
                    large = [g for g in gaps if g[0] >= least]
                    if not large:
                        break
                    gaps = [g for g in gaps if g[0] < least]
                    took: Counter = Counter()
                    for first, n, size, piece, at in sweep([(s, left[k] // q) for s, k in lengths.items()], large):
                        if piece is not None:
                            length = lengths[piece]
                            matches.append((length, rank[length] + at * q, n * q, first, capacity - size, q))
                            took[length] += n * q
                            size -= piece
                        if size:
                            gaps.append((size, first, n))
                    for length, n in took.items():
                        rank[length] += n
                        left[length] -= n
                        if not left[length]:
                            del left[length]
            rest = sum(n for k, n in left.items() if lower < k <= upper)
            if rest:
                fresh = -(-rest // most)
                gaps.append((capacity, sequences, fresh))
                sequences += fresh
    return matches


def planned(totals: DataFrame, capacity: int) -> DataFrame:
    """The matches of `plan_sequences` for totals(length, n): at most `capacity` rows, so one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {k: n for b in batches for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
        names = ["length", *(c.split()[0] for c in MATCH.split(", "))]
        for rows in batched(plan_sequences(counts, capacity), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    return totals.select("length", "n").coalesce(1).mapInArrow(run, f"length long, {MATCH}")


def best_fit_pack(docs: DataFrame, capacity: int = CAPACITY, json_path: str | None = None, rank_path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece's place in sequences of at most `capacity` ids."""
    pieces = materialise(token_pieces(docs, capacity, json_path, rank_path, end_id), "pieces")
    runs = pieces.groupBy("shard", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    runs = materialise(runs.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long")), "runs")
    matches = planned(runs.groupBy("length").agg(F.sum("n").cast("long").alias("n")), capacity)
    places = matches.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("rank", "n", "first", "offset", "q"))).alias("places"))
    places = F.broadcast(materialise(places.coalesce(1), "places"))
    # counts by shard grow with the shards, so they meet the pieces by a shuffle
    ranked = pieces.join(runs.drop("n").hint("merge"), ["shard", "length"]).withColumn("rank", F.col("local") + F.col("before")).join(places, "length")
    place = F.element_at(F.filter("places", lambda p: p["rank"] <= F.col("rank")), -1)
    ranked = ranked.withColumn("place", place).withColumn("i", F.col("rank") - F.col("place.rank"))
    sequence = (F.col("place.first") + F.floor(F.col("i") / F.col("place.q"))).cast("long")
    offset = F.col("place.offset") + F.pmod("i", F.col("place.q")) * F.col("length")
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), offset.cast("long").alias("offset"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
