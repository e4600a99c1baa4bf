import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np

from quillstone.llm import runs

SCHEMA = "doc_id long, text string"


def plain_runs(t, least=24, repeats=3):
    """Every maximal repetition by its period, compared word by word; a period that a smaller one explains is left out."""
    n, found = len(t), []
    for p in range(1, n // repeats + 1):
        i = 0
        while i + p < n:
            if t[i] != t[i + p]:
                i += 1
                continue
            start = i
            while i + p < n and t[i] == t[i + p]:
                i += 1
            length = i + p - start
            if length >= max(least, repeats * p) and not any(p % q == 0 and all(t[k] == t[k + q] for k in range(start, start + length - q)) for q in range(1, p)):
                found.append((start, length, p))
    return sorted(found)


def test_runs_equal_brute_force():
    rng = random.Random(2)
    for k in range(2500):
        n, letters = rng.randint(0, 70), rng.randint(1, 4)
        t = [rng.randrange(letters) for _ in range(n)]
        if k % 2 and n > 3:
            a, p = rng.randrange(n), rng.randint(1, 9)
            t = t[:a] + [t[a + (i - a) % p] if a + (i - a) % p < n else 0 for i in range(a, n)]
        assert runs.runs_of(t, 1, 2) == plain_runs(t, 1, 2)
        assert runs.runs_of(t, 6, 3) == plain_runs(t, 6, 3)


def test_matched_words_are_not_compared_again():
    """Comparisons grow with the length on strings whose suffixes have long common extensions."""
    fib, thue = [0], [0]
    other = [1]
    while len(fib) < 40_000:
        fib, other = other + fib, fib
    while len(thue) < 40_000:
        thue += [1 - c for c in thue]
    ruler = [(k & -k).bit_length() for k in range(1, 40_000)]
    rng = random.Random(1)
    unit = [rng.randrange(3) for _ in range(90)]
    nested = ([0] * 30 + [1]) * 1000
    for t in (fib, thue, ruler, [-c for c in ruler], [0] * 40_000, unit * 400, nested, [rng.randrange(2) for _ in range(40_000)], [rng.randrange(1000) for _ in range(40_000)]):
        for s in (t, [-c for c in t]):
            assert runs.lyndon_edges(s)[2] <= 4 * len(s)


def test_lyndon_edges_are_next_smaller_suffixes():
    rng = random.Random(3)
    for _ in range(800):
        t = [rng.randrange(3) for _ in range(rng.randint(0, 40))]
        nxt, ext, _ = runs.lyndon_edges(t)
        for i in range(len(t)):
            want = next((j for j in range(i + 1, len(t)) if t[j:] < t[i:]), len(t))
            assert nxt[i] == want
            if want < len(t):
                assert ext[i] == next(k for k in range(len(t)) if want + k == len(t) or t[i + k] != t[want + k])


def test_symbols_and_words():
    texts = ["", "a b  a\tb\x00 c", "\x0b\x0c", "é é é \x1c\x1c \u00a0", "word" * 3 + " " + "word" * 3 + "s " + "w" * 40 + " " + "w" * 41 + " " + "w" * 40, " lead", "trail "]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0] + [len(t.encode()) for t in texts])
    starts, lengths, bounds = runs.words_of(raw, off)
    seq = runs.symbols(raw, starts, lengths)
    words = [re.findall(rb"[^\x20\x09-\x0d]+", t.encode()) for t in texts]
    assert [raw[a : a + n].tobytes() for a, n in zip(starts, lengths, strict=True)] == sum(words, [])
    assert np.diff(bounds).tolist() == [len(w) for w in words]
    flat = sum(words, [])
    assert all((seq[i] == seq[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))


def plain_row(doc_id, text, repeats=True):
    words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    n = len(words)
    if repeats and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    # the least period of a stretch is found by comparing the words q apart
    arr = np.unique(words, return_inverse=True)[1] if n else np.zeros(0, int)
    found, covered = [], set()
    for q in range(1, n // 3 + 1):
        same = np.concatenate(([0], (arr[:-q] == arr[q:]).astype(int), [0]))
        edge = np.diff(same)
        for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            if e - s + q >= max(24, 3 * q) and not any(f[0] <= s and f[0] + f[1] >= e + q and q % f[2] == 0 for f in found):
                found.append((s, e - s + q, q))
    drop = {i for s, n_, q in found for i in range(s + q, s + n_)}
    found.sort()
    best = min(found, key=lambda f: (-Fraction(f[1], f[2]), f[0], f[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{k},{q}\n" for s, k, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_op13_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    have = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in runs.op13_periodic_runs(spark, sf_dir).collect()}
    assert len(have) == len(docs)
    for r in docs:
        assert have[r["doc_id"]] == plain_row(*r), r["doc_id"]
    assert sum(h[1] > 0 for h in have.values()) > 50


def test_edge_cases(spark):
    assert runs.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0
    texts = [(None, "a " * 30), (1, None), (2, ""), (3, "x y z " * 9 + "\t\n" + "x y"), (4, "so " * 200_000), (5, "a b " * 11), (5, "a b " * 12), (6, "one two\u00a0three " * 30)]
    rows = [tuple(r) for r in spark.createDataFrame(texts, SCHEMA).collect()]
    df = runs.periodic_runs(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS runs", "'q' AS collapsed")).collect()
    have = sorted(((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in df), key=str)
    assert have == sorted([(None, [(0, 30, 1)], "a"), (1, [], ""), (2, [], ""), (3, [(0, 29, 3)], "x y z"), (4, [(0, 200_000, 1)], "so"), (5, [], "a b " * 10 + "a b"), (5, [(0, 24, 2)], "a b"), (6, [(0, 60, 2)], "one two\u00a0three")], key=str)
