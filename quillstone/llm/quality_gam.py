"""Quality classifier (operator 2): a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins. Cyclic boosting goes round the features and fits a shallow tree (depth 2,
on one feature's bins) to the current residuals, at a small rate; the trees of a feature add up to one lookup table.
The strongest pairs are then found on the residuals and boosted the same way (one cut on either axis) into
two-way tables. A text's score is the sigmoid of the bias plus one table entry per feature and per pair,
added up in vectorised form. Training runs on the driver over a bounded, documented sample (SAMPLE).

Defined results: null and empty texts have features of their own and get a score like any other; repeated rows are
scored each by itself; without labelled rows of both kinds every score is the smoothed share of label 1; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import slices, utf8
from quillstone.llm.labelled import held_out, labelled_features
from quillstone.llm.textstats import SPACE, SYMBOL, Words, count, line_counts, mix, repeat_words, words_of

SAMPLE = 20000
THRESHOLD = 0.7
BINS = 48
FEATURES = (
    "log words", "letters a word", "symbols", "digits", "capitals", "punctuation", "non-ASCII", "blanks",
    "distinct words", "repeated windows", "repeated lines", "words a line", "longest word", "exclamation", "spread of letters", "bars",
)
_DIGIT = np.isin(np.arange(256), list(b"0123456789"))
_UPPER = np.isin(np.arange(256), list(range(65, 91)))
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(128, 256)])
_POINT = np.isin(np.arange(256), list(b".,;:?()'\"-"))


def text_features(w: Words) -> np.ndarray:
    """A row of FEATURES for each text."""
    data, off, n = w.data, w.off, len(w.off) - 1
    size, words = np.diff(off), np.diff(w.first)
    a, b = np.maximum(size, 1), np.maximum(words, 1)
    lines, dup = line_counts(w)
    tagged = mix(w.hash + mix(w.doc.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)))
    _, where = np.unique(tagged, return_index=True)
    distinct = np.bincount(w.doc[where], minlength=n)
    length = w.end - w.start
    longest = np.zeros(n)
    np.maximum.at(longest, w.doc, length)
    squares = np.bincount(w.doc, length.astype(float) ** 2, minlength=n) / b
    mean = np.bincount(w.doc, length, minlength=n) / b
    cols = [
        np.log1p(words), mean, count(SYMBOL[data], off) / a, count(_DIGIT[data], off) / a,
        count(_UPPER[data], off) / np.maximum(1, count(_LETTER[data], off)), count(_POINT[data], off) / b, count(data >= 128, off) / a, count(SPACE[data], off) / a,
        distinct / b, repeat_words(w) / b, dup / np.maximum(1, lines), words / np.maximum(1, lines), np.log1p(longest), count(data == 33, off) / b,
        np.sqrt(np.maximum(0, squares - mean**2)), count(data == 124, off) / b,
    ]
    return np.stack(cols, 1).astype(np.float64)


@dataclass
class Gam:
    bias: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)]

    def logit(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.bias)
        for table, at in zip(self.tables, b, strict=True):
            z += table[at]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            z += table[b[i], b[j]]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 2.0)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """(gain, bins on the left) of the best cut of a run of bins."""
    if len(g) < 2:
        return 0.0, 0
    lg, lh = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    rg, rh = g.sum() - lg, h.sum() - lh
    gain = lg * _leaf(lg, lh) + rg * _leaf(rg, rh) - g.sum() * _leaf(g.sum(), h.sum())
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """A shallow tree over one feature's bins: its value in every bin."""
    gain, k = _best_cut(g, h)
    if depth == 0 or gain <= 1e-9:
        return np.full(len(g), _leaf(g.sum(), h.sum()))
    return np.concatenate((_tree(g[:k], h[:k], depth - 1), _tree(g[k:], h[k:], depth - 1)))


def _tree2(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, values): one cut on the first axis, then one on the second in either half."""
    _, k = _best_cut(g.sum(1), h.sum(1))
    out, gain = np.zeros(g.shape), -g.sum() * _leaf(g.sum(), h.sum())
    for part in (slice(0, k), slice(k, None)):
        gs, hs = g[part].sum(0), h[part].sum(0)
        _, m = _best_cut(gs, hs)
        for across in (slice(0, m), slice(m, None)):
            v = _leaf(gs[across].sum(), hs[across].sum())
            out[part, across] = v
            gain += gs[across].sum() * v
    return float(gain), out


def fit_gam(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 8, rate: float = 0.1) -> Gam:
    share = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(share / (1 - share)))
    if len(y) == 0 or len(set(y.tolist())) < 2:
        return Gam(bias, [np.zeros(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    gam = Gam(bias, cuts, [np.zeros(len(c) + 1) for c in cuts])
    b, z = gam.bins(x), np.full(len(y), bias)

    def residuals() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, at in enumerate(b):
            g, h = residuals()
            n = len(gam.tables[j])
            step = rate * _tree(np.bincount(at, g, n), np.bincount(at, h, n))
            gam.tables[j] += step
            z += step[at]
    g, h = residuals()
    found = []
    for i in range(len(b)):
        for j in range(i):
            shape = (len(cuts[i]) + 1, len(cuts[j]) + 1)
            cell = b[i] * shape[1] + b[j]
            found.append((_tree2(*(np.bincount(cell, q, shape[0] * shape[1]).reshape(shape) for q in (g, h)))[0], i, j))
    gam.pairs = [(i, j) for _, i, j in sorted(found, reverse=True)[:n_pairs]]
    gam.pair_tables = [np.zeros((len(cuts[i]) + 1, len(cuts[j]) + 1)) for i, j in gam.pairs]
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(gam.pairs):
            g, h = residuals()
            shape = gam.pair_tables[k].shape
            cell = b[i] * shape[1] + b[j]
            step = rate * _tree2(*(np.bincount(cell, q, shape[0] * shape[1]).reshape(shape) for q in (g, h)))[1]
            gam.pair_tables[k] += step
            z += step[b[i], b[j]]
    return gam


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            x = text_features(words_of(*utf8(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "y", "f"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Gam:
    rows, y = labelled_features(docs, labels, "quality", sample, _features, "gam")
    return fit_gam(np.array([np.frombuffer(r) for r in rows]).reshape(len(rows), len(FEATURES)), y)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    gam = train(docs, labels, sample)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                p = gam.score(text_features(words_of(*utf8(batch.column(1)))))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_predicted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, train_on: DataFrame | None = None) -> DataFrame:
    """The rows of docs with a score of the threshold or more, with the columns of docs.

    train_on: the documents to learn from, where docs are what an earlier filter has left and hold one label only.
    """
    gam = train(docs if train_on is None else train_on, labels, sample)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                x = text_features(words_of(*utf8(batch.column(batch.schema.get_field_index("text")))))
                yield batch.filter(pa.array(gam.score(x) >= threshold))

    return docs.mapInArrow(good, docs.schema)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
