"""Quality rules (operator 5): counted rules, then a hashed n-gram logistic regression.

Word unigrams and bigrams and 4-byte character n-grams are hashed into one weight table; a text's score is the
bias plus the mean weight of its n-grams of each family. The regression is trained on a bounded, documented
sample of labelled rows (SAMPLE), one fold of which calibrates its output to probabilities (Platt). A text is
rejected where a counted rule fails, or where its calibrated probability of being of good quality is under KEEP.

Defined results: null and empty texts have no words, so the counted rules reject them; repeated rows are judged
each by itself; without labelled rows of both kinds the model keeps every text that the rules keep; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import slices, utf8
from quillstone.llm.labelled import labelled_rows
from quillstone.llm.textstats import SPACE, SYMBOL, Words, count, line_counts, repeat_words, windows, words_of

SAMPLE = 3000
BITS = 17
KEEP = 0.5
MIN_WORDS = 50
_GAIN = 24.0
_CHAR = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]


def ngram_slots(w: Words) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(slots in the weight table, first, end per text) of word unigrams, word bigrams and 4-byte n-grams."""
    top = np.uint64(64 - BITS)
    n = len(w.data)
    b = w.data.astype(np.uint32)
    chars = np.zeros(n, np.uint32)
    if n >= 4:
        chars[: n - 3] = (b[:-3] * _CHAR[0] + b[1:-2] * _CHAR[1] + b[2:-1] * _CHAR[2] + b[3:] * _CHAR[3]) * np.uint32(0x165667B1)
    chars >>= np.uint32(32 - BITS)
    at, two = windows(w, 2)
    pairs = np.searchsorted(at, w.first)
    one = (w.hash * np.uint64(0xA24BAED4963EE407)) >> top
    return [
        (one.astype(np.int64), w.first[:-1], w.first[1:]),
        ((two >> top).astype(np.int64), pairs[:-1], pairs[1:]),
        (chars.astype(np.int64), w.off[:-1], np.maximum(w.off[:-1], w.off[1:] - 3)),
    ]


def mean_weights(w: Words, weights: np.ndarray) -> np.ndarray:
    out = np.zeros(len(w.off) - 1)
    for slots, first, end in ngram_slots(w):
        total = np.concatenate(([0.0], np.cumsum(weights[slots], dtype=np.float64)))
        out += (total[end] - total[first]) / np.maximum(end - first, 1)
    return out * _GAIN


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            w = words_of(*utf8(batch.column(1)))
            families, out = ngram_slots(w), []
            for i in range(batch.num_rows):
                slot, share = [], []
                for slots, first, end in families:
                    s, n = np.unique(slots[first[i] : end[i]], return_counts=True)
                    slot.append(s)
                    share.append(n / max(1, end[i] - first[i]))
                f = np.zeros(sum(map(len, slot)), [("s", "<u4"), ("v", "<f4")])
                f["s"], f["v"] = np.concatenate(slot), np.concatenate(share)
                out.append(f.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], names=["doc_id", "y", "f"])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def platt(z: np.ndarray, goal: np.ndarray, bias: float) -> tuple[float, float]:
    """(slope, intercept) of the probabilities: Newton steps, halved until the log loss falls, towards smoothed goals."""
    pos, neg = (goal == 1).sum(), (goal == 0).sum()
    soft = np.where(goal == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.array([1.0, bias])

    def loss(x: np.ndarray) -> float:
        s = x[0] * z + x[1]
        return float((np.logaddexp(0, s) - soft * s).sum())

    for _ in range(100):
        p = _sigmoid(x[0] * z + x[1])
        e, q = p - soft, p * (1 - p) + 1e-9
        g = np.array([(e * z).sum(), e.sum()])
        h = np.array([[(q * z * z).sum(), (q * z).sum()], [(q * z).sum(), q.sum()]]) + 1e-9 * np.eye(2)
        step, at = np.linalg.solve(h, g), loss(x)
        while loss(x - step) > at and np.abs(step).max() > 1e-9:
            step = step / 2
        x = x - step
        if np.abs(step).max() < 1e-7:
            break
    return float(x[0]), float(x[1])


def fit_ngram_model(rows: list[bytes], y: np.ndarray, rounds: int = 80, rate: float = 0.2, decay: float = 1e-3) -> tuple[np.ndarray, float, float]:
    """(weights, slope, intercept): logistic regression by Adam over all rows but each fifth, which calibrates."""
    weights = np.zeros(1 << BITS)
    if len(set(y.tolist())) < 2:
        return weights.astype(np.float32), 0.0, 30.0
    fold = np.arange(len(y)) % 5 == 4

    def blocks(which: np.ndarray, most: int = 256) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(slots, values, rows within the block, rows of all) of some rows, in blocks, so that a step's temporaries stay small."""
        out, own = [], np.flatnonzero(which)
        for at in (own[i : i + most] for i in range(0, len(own), most)):
            feats = [np.frombuffer(rows[i], [("s", "<u4"), ("v", "<f4")]) for i in at]
            f = np.concatenate(feats)
            out.append((f["s"].astype(np.int32), f["v"] * np.float32(_GAIN), np.repeat(np.arange(len(at), dtype=np.int32), [len(x) for x in feats]), at))
        return out

    train, check = blocks(~fold), blocks(fold) if fold.any() else None
    rows.clear()  # the blocks hold them now; the list is the caller's
    goal = y.astype(float)
    share = goal[~fold].mean()
    cost = np.where(goal == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
    cost /= cost[~fold].sum()
    n_train = int((~fold).sum())
    bias, m, v = 0.0, np.zeros(len(weights)), np.zeros(len(weights))
    for t in range(1, rounds + 1):
        grad, slope = decay * weights / n_train, 0.0
        for slot, value, row, at in train:
            z = np.bincount(row, value * weights[slot], minlength=len(at)) + bias
            g = (_sigmoid(z) - goal[at]) * cost[at]
            grad += np.bincount(slot, value * g[row], minlength=len(weights))
            slope += g.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        weights = weights - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        bias -= rate * slope
    check = check or train
    z = np.concatenate([np.bincount(row, value * weights[slot], minlength=len(at)) for slot, value, row, at in check])
    goal = y[np.concatenate([at for *_, at in check])]
    return weights.astype(np.float32), *platt(z, goal, bias)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float, float]:
    """`fit_ngram_model` of the sample, in order of id; its n-grams stay on the executors, and the driver takes the weights alone."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, y = [], []
        for batch in batches:
            rows += batch.column("f").to_pylist()
            y += batch.column("y").to_pylist()
        weights, a, b = fit_ngram_model(rows, np.array(y, np.int64))
        yield pa.RecordBatch.from_pydict({"weights": pa.array([weights.tobytes()], pa.binary()), "a": [a], "b": [b]})

    rows = labelled_rows(docs, labels, "quality", sample, _features, "rules")
    # one task, since the sample is bounded; an empty sample may have no task at all
    model = rows.coalesce(1).sortWithinPartitions("doc_id").mapInArrow(fit, "weights binary, a double, b double").first()
    if model is None:
        return fit_ngram_model([], np.zeros(0, np.int64))
    return np.frombuffer(bytes(model["weights"]), np.float32), model["a"], model["b"]


def quality_rules(docs: DataFrame, labels: DataFrame, keep: float = KEEP, sample: int = SAMPLE) -> DataFrame:
    """doc_id, the counts, base_failed, probability and kept of every row."""
    weights, a, b = train(docs, labels, sample)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                data, off = utf8(batch.column(1))
                w = words_of(data, off)
                n_words = np.diff(w.first)
                rep = repeat_words(w)
                failed = (n_words < MIN_WORDS) | (100 * rep > 50 * n_words)
                p = _sigmoid(a * mean_weights(w, weights) + b)
                cols = [n_words, count(~SPACE[data] & ((data & 0xC0) != 0x80), off), count(SYMBOL[data], off), line_counts(w)[1], rep, failed, ~failed & (p >= keep), p]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in cols)], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"])

    out = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(judge, out)


def keep_good(docs: DataFrame, labels: DataFrame, keep: float = KEEP, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs."""
    weights, a, b = train(docs, labels, sample)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                w = words_of(*utf8(batch.column(batch.schema.get_field_index("text"))))
                n_words = np.diff(w.first)
                kept = (n_words >= MIN_WORDS) & (100 * repeat_words(w) <= 50 * n_words)
                kept &= _sigmoid(a * mean_weights(w, weights) + b) >= keep
                yield batch.filter(pa.array(kept))

    return docs.mapInArrow(good, docs.schema)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
