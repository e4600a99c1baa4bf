import bisect
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillstone.llm.packing import _public, best_fit_pack, classes, op10_best_fit_packing, plan_sequences, sweep


def whole(rows, cap=2048):
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= cap
    return len(seqs)


def placed(matches):
    """A row for each piece of the matches."""
    return [{"length": k, "rank": r + i, "sequence_id": s + i // q, "offset": o + i % q * k} for k, r, n, s, o, q in matches for i in range(n)]


def brute_sequences(lengths, cap):
    """Best-fit decreasing, one piece after another."""
    free = []
    for k in sorted(lengths, reverse=True):
        at = bisect.bisect_left(free, k)
        gap = free.pop(at) if at < len(free) else cap
        if gap > k:
            bisect.insort(free, gap - k)
        brute_sequences.n = getattr(brute_sequences, "n", 0) + (gap == cap)
    n, brute_sequences.n = brute_sequences.n, 0
    return n


def test_sweep_gives_successors():
    """One sweep against the plain form: pieces in order of size, each takes the smallest gap that is left and large enough."""
    rng = random.Random(5)
    for _ in range(400):
        pieces = [(k, rng.randint(1, 6)) for k in rng.sample(range(1, 40), rng.randint(1, 12))]
        gaps, first = [], 0
        for _ in range(rng.randint(1, 12)):
            n = rng.randint(1, 6)
            gaps.append((rng.randint(1, 45), first, n))
            first += n
        free, want = sorted(g for g, _, n in gaps for _ in range(n)), []
        for k in sorted(k for k, n in pieces for _ in range(n)):
            at = bisect.bisect_left(free, k)
            if at < len(free):
                want.append((free.pop(at), k))
        rows = sweep(pieces, gaps)
        assert sorted((size, piece) for _, n, size, piece, _ in rows if piece for _ in range(n)) == sorted(want)
        seen = sorted(x for f, n, *_ in rows for x in range(f, f + n))
        assert seen == list(range(first))
        size_of = {x: g for g, f, n in gaps for x in range(f, f + n)}
        assert all(size_of[x] == size for f, n, size, *_ in rows for x in range(f, f + n))
        ranks = sorted((p, at + i) for _, n, _, p, at in rows if p for i in range(n))
        assert len(set(ranks)) == len(ranks) and all((p, i) in set(ranks) for p, at in ranks for i in range(at))


def test_plan_against_best_fit():
    rng = random.Random(7)
    shapes = [Counter({6: 2, 5: 1, 4: 2, 3: 3, 1: 1}), Counter(rng.randint(1, 100) for _ in range(3000)), Counter(min(100, int(rng.expovariate(0.08)) + 1) for _ in range(3000)), Counter({100: 7}), Counter({3: 500}), Counter({51: 40, 49: 41})]
    for counts in shapes:
        cap = 10 if 6 in counts and len(counts) == 5 else 100
        rows = placed(plan_sequences(dict(counts), cap))
        assert Counter(r["length"] for r in rows) == counts
        assert sorted((r["length"], r["rank"]) for r in rows) == sorted((k, i) for k, n in counts.items() for i in range(n))
        best = brute_sequences(list(counts.elements()), cap)
        assert whole(rows, cap) <= best * 1.02 + 1


def test_classes_cover_all_lengths():
    for cap in (1, 2, 7, 512, 2048):
        assert sorted(k for lo, up in classes(cap) for k in range(lo + 1, up + 1)) == list(range(1, cap + 1))


def test_against_brute_force(spark, sf_dir):
    from tokenizers import Tokenizer

    rows = op10_best_fit_packing(spark, sf_dir).collect()
    t = Tokenizer.from_file(_public("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want, total = {}, 0
    for d, e in zip(docs, t.encode_batch([d["text"] or "" for d in docs], add_special_tokens=False)):
        ids = np.array([*e.ids, 0], "<u4")
        total += len(ids)
        at, k = 0, 0
        while at < len(ids):
            n = (len(ids) % 2048 or 2048) if k == 0 else 2048
            want[d["doc_id"], k] = (at, n, zlib.crc32(ids[at : at + n].tobytes()))
            at, k = at + n, k + 1
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    assert whole(rows) <= min(total / 2048 * 1.02 + 2, brute_sequences([r["length"] for r in rows], 2048) * 1.02 + 1)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, "", 5), (None, "a <|endoftext|> b", 5), (2, "x " * 9000, 5), (2, "x " * 9000, 5)], "doc_id long, text string, length int")
    rows = best_fit_pack(docs, 512).collect()
    whole(rows, 512)
    assert sum(r["length"] == 1 for r in rows) == 2
    assert best_fit_pack(docs.filter(F.lit(False))).count() == 0
