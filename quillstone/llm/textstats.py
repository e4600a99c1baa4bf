"""Vectorised word, line and window statistics over a batch of UTF-8 texts, shared by rules and classifiers.

Words are maximal runs of bytes other than space and 0x09-0x0D. Word and line identities are 64-bit polynomial
hashes of their bytes, passed through a mixing function.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["p"]) < n:
        for k, base in (("p", _P), ("i", _P_INV)):
            steps = np.full(n + n // 4, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS["p"][:n], _POWERS["i"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running sums of byte * P^i, one longer than data."""
    p, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from start to end."""
    _, inv = _powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts
    off: np.ndarray  # offsets of the texts in them
    start: np.ndarray  # of each word
    end: np.ndarray
    doc: np.ndarray  # row of each word
    first: np.ndarray  # number of the first word of each row, one longer
    prefix: np.ndarray
    hash: np.ndarray


def words_of(data: np.ndarray, off: np.ndarray) -> Words:
    space = SPACE[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:] = np.concatenate((space, [True]))[: len(data)] if len(data) else True
    edge[off[:-1]] = True  # a text begins a word, whatever stands before it
    start = np.flatnonzero(~space & edge[: len(data)])
    last = np.ones(len(data), bool)
    last[:-1] = space[1:]
    last[off[1:][off[1:] > 0] - 1] = True
    end = np.flatnonzero(~space & last) + 1
    first = np.searchsorted(start, off)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    prefix = prefix_hash(data)
    return Words(data, off, start, end, doc, first, prefix, span_hash(prefix, start, end))


def windows(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every n-word window inside a text."""
    if len(w.start) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    m = len(w.start) - n + 1
    h = w.hash[:m]
    for k in range(1, n):
        h = mix(h * np.uint64(0x9FB21C651E98DF25) + w.hash[k : m + k])
    ok = np.flatnonzero(w.doc[:m] == w.doc[n - 1 :])
    return ok, h[ok]


def repeated(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more within their row."""
    tagged = mix(key + mix(doc.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)))
    _, back, n = np.unique(tagged, return_inverse=True, return_counts=True)
    return n[back] > 1


def repeat_words(w: Words, n: int = 3) -> np.ndarray:
    """Words per text that lie in an n-word window found twice or more in the text."""
    at, h = windows(w, n)
    hit = at[repeated(w.doc[at], h)] if len(at) else at
    inside = np.zeros(len(w.start), bool)
    for k in range(n):
        inside[hit + k] = True
    return count(inside, w.first)


def count(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[off[1:]] - total[off[:-1]]


def line_counts(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(lines with a word, those equal to an earlier line of the same text) per text; lines end at 0x0A."""
    cut = np.flatnonzero(w.data == 10)
    inner = np.setdiff1d(w.off[1:-1], [0, len(w.data)])
    start = np.unique(np.concatenate((w.off[:1], inner, cut + 1)))
    start = start[start < len(w.data)]
    stop = np.minimum(np.append(start[1:], len(w.data)), len(w.data))
    end = np.where((stop > start) & (w.data[np.maximum(stop - 1, 0)] == 10) if len(start) else False, stop - 1, stop).astype(np.int64)
    seen = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end = start[seen], end[seen]
    doc = np.searchsorted(w.off, start, side="right") - 1
    key = mix(span_hash(w.prefix, start, end) + mix(doc.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)))
    _, where = np.unique(key, return_index=True)
    fresh = np.zeros(len(key), bool)
    fresh[where] = True
    n = len(w.off) - 1
    return np.bincount(doc, minlength=n), np.bincount(doc[~fresh], minlength=n)
