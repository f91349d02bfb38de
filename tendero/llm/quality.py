"""Quality scores by histogram gradient-boosted trees over statistics of a text.

The statistics are a fixed set of shares and means, taken from whole texts inside
the tasks. Trees are grown level by level on binned features (gradients and
Hessians summed per bin), then flattened into arrays that numpy walks for a whole
batch at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

FEATURES = (
    "log_bytes", "log_words", "log_lines", "upper", "digit", "blank", "newline", "beyond_ascii",
    "stop_marks", "other_marks", "most_common_mark", "word_length", "long_words", "one_letter_words",
    "distinct_words", "most_common_word", "distinct_lines", "most_common_line", "line_length",
    "words_with_marks_at_end", "upper_words", "byte_entropy",
)


@dataclass(frozen=True)
class Settings:
    sample_rows: int = 20_000  # labelled rows learned from, those of least id hash
    bins: int = 64
    trees: int = 60
    depth: int = 4
    rate: float = 0.15
    penalty: float = 1.0  # on leaf values
    least: float = 5.0  # Hessian on either side of a split


def _ascii(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in characters]] = True
    return out


_UPPER = _ascii("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = _ascii("abcdefghijklmnopqrstuvwxyz")
_DIGIT = _ascii("0123456789")
_STOP = _ascii(".,;:?'\"-()")
_OTHER = _ascii("!#$%&*+/<=>@[\\]^_`{|}~")


def statistics(text: str) -> list[float]:
    """The features of one whole text; an empty one has zeros."""
    data = np.frombuffer(text.encode(), np.uint8)
    n = len(data)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(data, minlength=256)
    words, lines = text.split(), text.split("\n")
    rows = [x for x in lines if x]
    kinds, kinds_of_rows = Counter(words), Counter(rows)
    nw, nl = len(words) or 1, len(rows) or 1
    marks = counts * (_STOP | _OTHER)
    shares = counts[counts > 0] / n
    short = sum(1 for w in words if len(w) == 1)
    long = sum(1 for w in words if len(w) > 12)
    ends = sum(1 for w in words if not w[-1].isalnum())
    upper = sum(map(str.isupper, words))
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(rows)),
        counts[_UPPER].sum() / n, counts[_DIGIT].sum() / n, counts[32] / n, counts[10] / n, counts[128:].sum() / n,
        counts[_STOP].sum() / n, counts[_OTHER].sum() / n, marks.max() / n,
        len(text) / nw, long / nw, short / nw,
        len(kinds) / nw, max(kinds.values(), default=0) / nw,
        len(kinds_of_rows) / nl, max(kinds_of_rows.values(), default=0) / nl, n / nl,
        ends / nw, upper / nw, float(-(shares * np.log2(shares)).sum()),
    ]


@F.pandas_udf(ArrayType(DoubleType()))
def statistics_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([statistics(t or "") for t in batch])


@dataclass
class Model:
    """All trees, flattened: inner nodes have a feature and a threshold, node i has
    children 2i + 1 and 2i + 2, leaves follow at the last level."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of features."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(inner + 1))):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += leaf[at - inner]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, s: Settings = Settings()) -> Model:
    """Boosted trees for labels y (0 or 1); without rows of both labels a constant."""
    n, width = x.shape
    share = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    inner = 2**s.depth - 1
    empty = Model(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if n == 0 or y.min() == y.max():
        return empty
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, s.bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], axis=1)  # x > e[b] means a bin beyond b
    offset = np.arange(width) * s.bins
    flat = binned + offset
    features, thresholds, leaves = [], [], []
    raw = np.full(n, base)
    for _ in range(s.trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(n, np.int64)
        for level in range(s.depth):
            first, nodes = 2**level - 1, 2**level
            key = ((at - first)[:, None] * (width * s.bins) + flat).ravel()
            size = nodes * width * s.bins
            sums = [
                np.bincount(key, np.repeat(v, width), size).reshape(nodes, width, s.bins).cumsum(axis=2) for v in (g, h)
            ]
            gl, hl = sums
            gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl**2 / (hl + s.penalty) + (gt - gl) ** 2 / (ht - hl + s.penalty) - gt**2 / (ht + s.penalty)
            gain[(hl < s.least) | (ht - hl < s.least)] = 0
            for j, e in enumerate(edges):
                gain[:, j, len(e) :] = 0  # no edge to split at
            best = gain.reshape(nodes, -1).argmax(axis=1)
            bin_of = np.full(nodes, s.bins)
            for k in range(nodes):
                j, b = divmod(int(best[k]), s.bins)
                if gain[k, j, b] > 1e-9:
                    feature[first + k], threshold[first + k], bin_of[k] = j, edges[j][b], b
            node = at - first
            at = 2 * at + 1 + (binned[np.arange(n), feature[at]] > bin_of[node])
        gs, hs = np.bincount(at - inner, g, inner + 1), np.bincount(at - inner, h, inner + 1)
        leaf = -s.rate * gs / (hs + s.penalty)
        raw += leaf[at - inner]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Model(base, np.array(features), np.array(thresholds), np.array(leaves))


def fit(docs: DataFrame, labels: DataFrame, label: str, settings: Settings = Settings()) -> Model:
    """A model of ``labels.<label>`` from whole texts of ``docs``.

    It learns from at most ``sample_rows`` labelled rows, those of least id hash,
    a bounded sample that is broadcast to find the texts; only their features
    come to the driver. Rows with a null label or id are not learned from.
    """
    sample = (
        labels.select(F.col("doc_id").alias("label_id"), F.col(label).cast("int").alias("y"))
        .filter(F.col("y").isin(0, 1) & F.col("label_id").isNotNull())
        .orderBy(F.xxhash64("label_id"), "label_id", "y").limit(settings.sample_rows)
    )
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"))
        .select("doc_id", "y", statistics_udf("text").alias("x"))
        .toPandas().sort_values(["doc_id", "y"], kind="stable")
    )
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES))
    return grow(x, rows["y"].to_numpy(float), settings)


def scorer(docs: DataFrame, model: Model):
    """A column function: text to the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.array([statistics(t or "") for t in batch]).reshape(-1, len(FEATURES))
            yield pd.Series(shared.value.score(x))

    return F.pandas_udf(run, "double")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every document; a null text is an empty one."""
    return docs.select("doc_id", scorer(docs, model)("text").alias("score"))
