"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed from whole texts in Arrow batches. Trees are grown on the driver from the statistics
of a bounded sample of labelled rows, with features binned at quantiles; each tree is complete to a fixed
depth and stored in three arrays, so that a batch is scored by vectorised traversal.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, training_rows

#: Most labelled rows that a model is fitted on.
TRAIN_ROWS = 6000
THRESHOLD = 0.5
NAMES = [
    "log_chars", "log_words", "word_length", "letters", "digits", "upper", "spaces", "non_ascii", "symbols",
    "stops", "shouts", "pipes", "commas", "char_entropy", "distinct_words", "top_word", "same_as_last",
    "symbol_words", "upper_words", "short_words", "log_lines", "line_length", "top_line", "distinct_lines",
    "line_stops", "deflated", "distinct_pairs",
]
_CLASS = np.zeros((7, 256))
_CLASS[0, [*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[1, 48:58] = 1
_CLASS[2, 65:91] = 1
_CLASS[3, [9, 10, 13, 32]] = 1
_CLASS[4, 128:] = 1
_CLASS[5, [ord(c) for c in "#$%&*+<=>@\\^_`{}~/"]] = 1
_CLASS[6, [ord(c) for c in ".?"]] = 1


def statistics(text: str) -> list[float]:
    """The figures named in NAMES, of a whole text; an empty text has finite ones too."""
    raw = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    size = max(1, len(raw))
    share = _CLASS @ counts / size
    p = counts[counts > 0] / size
    words, lines = text.split(), [x for x in text.split("\n") if x]
    n, m = max(1, len(words)), max(1, len(lines))
    each, line_counts = Counter(words), Counter(lines)
    pairs = set(zip(words, words[1:], strict=False))
    last = sum(a == b for a, b in zip(words, words[1:], strict=False))
    odd = sum(c for w, c in each.items() if not w[-1].isalnum() and w[-1] not in ".,;:!?\"')" or not w[0].isalnum() and w[0] not in "\"'(¿¡")
    return [
        math.log1p(len(text)), math.log1p(len(words)), sum(map(len, words)) / n, *share[:6],
        share[6], counts[33] / size, counts[124] / size, counts[44] / size, float(-(p * np.log2(p)).sum()),
        len(each) / n, max(each.values(), default=0) / n, last / n, odd / n,
        sum(c for w, c in each.items() if len(w) > 1 and w.isupper()) / n, sum(c for w, c in each.items() if len(w) <= 2) / n,
        math.log1p(len(lines)), math.log1p(len(text) / m), max(line_counts.values(), default=0) / m, len(line_counts) / m,
        sum(x[-1] in ".?!:\"" for x in lines) / m, len(zlib.compress(raw, 1)) / size, len(pairs) / n,
    ]


class BoostedTrees:
    """Binary classifier. feature, cut: (trees, 2**depth - 1); value: (trees, 2**depth)."""

    def __init__(self, trees: int = 150, depth: int = 4, rate: float = 0.08, bins: int = 64, min_rows: int = 8, ridge: float = 3.0):
        self.trees, self.depth, self.rate, self.bins, self.min_rows, self.ridge = trees, depth, rate, bins, min_rows, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, f = x.shape
        inner, leaves = 2**self.depth - 1, 2**self.depth
        self.feature = np.zeros((self.trees, inner), np.int32)
        self.cut = np.full((self.trees, inner), np.inf)
        self.value = np.zeros((self.trees, leaves))
        rate = (y.sum() + 1) / (n + 2)
        self.base = math.log(rate / (1 - rate))
        if n < 2 * self.min_rows or y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
        flat = binned + np.arange(f) * self.bins
        raw = np.full(n, self.base)
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                at = (node[:, None] * (f * self.bins) + flat).ravel()
                hist = [np.bincount(at, np.repeat(v, f), width * f * self.bins).reshape(width, f, self.bins).cumsum(2) for v in (g, h, np.ones(n))]
                gl, hl, nl = (a[:, :, :-1] for a in hist)
                gt, ht, nt = (a[:, :1, -1:] for a in hist)
                gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                gain[(nl < self.min_rows) | (nt - nl < self.min_rows)] = -1
                best = gain.reshape(width, -1).argmax(1)
                right = np.zeros(n, bool)
                for k in range(width):
                    j, b = divmod(int(best[k]), self.bins - 1)
                    if gain[k, j, b] > 1e-6 and b < len(edges[j]):
                        self.feature[t, first + k], self.cut[t, first + k] = j, edges[j][b]
                        right |= (node == k) & (binned[:, j] > b)
                node = 2 * node + right
            top, bottom = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
            self.value[t] = -self.rate * top / (bottom + self.ridge)
            raw += self.value[t][node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: all trees of a block of rows are walked at once, level by level."""
        out = np.empty(len(x))
        tree = np.arange(self.trees)
        for s in range(0, len(x), 512):
            part = x[s : s + 512]
            node = np.zeros((len(part), self.trees), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (np.take_along_axis(part, self.feature[tree, at], 1) > self.cut[tree, at])
            out[s : s + 512] = 1 / (1 + np.exp(-(self.base + self.value[tree, node].sum(1))))
        return out


def _texts(batch: pa.RecordBatch, at: int) -> Iterator[str]:
    return (v.as_py() or "" for v in batch.column(at))


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> BoostedTrees:
    """Trees fitted on the statistics of at most `rows` labelled rows outside the held-out fold."""

    def task(batches):
        for b in batches:
            figures = [statistics(t) for t in _texts(b, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(figures, pa.list_(pa.float64()))], ["d_id", "label", "x"])

    found = training_rows(docs, labels, "quality", rows).mapInArrow(task, "d_id long, label int, x array<double>").collect()
    found.sort(key=lambda r: (r[0], r[1], r[2]))
    x = np.array([r[2] for r in found], float).reshape(len(found), len(NAMES))
    return BoostedTrees().fit(x, np.array([r[1] for r in found], float))


def score_quality(docs: DataFrame, model: BoostedTrees, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (probability of label 1), predicted.

    Null and empty texts are scored as empty ones. Without usable labels the model gives one score to all.
    Repeated rows each get a row, null ids are not held out. An empty table gives an empty result. Other
    columns are not read.
    """

    def task(batches):
        for b in batches:
            x = np.array([statistics(t) for t in _texts(b, 2)], float).reshape(b.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(model.predict(x))], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(task, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
