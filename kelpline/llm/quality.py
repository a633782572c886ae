"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are binned by training quantiles; a tree is grown level by level from histograms of
gradients.  All trees are complete and lie flattened in arrays (feature, bin, leaf value), so
that a batch of documents walks all trees at once with numpy indexing.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm.common import bounded_rows, bounded_sample, map_texts, stage

TRAIN_ROWS = 20_000  # labelled rows that the model is fitted on, about, at most
TREES, DEPTH, BINS, RATE, SHRINK, LEAST = 150, 4, 64, 0.1, 1.0, 5.0
THRESHOLD = 0.3

_KIND = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 stop, 6 sign, 7 not ASCII
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_KIND[[ord(c) for c in ".,;:'\"()-?"]] = 5
_KIND[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~!"]] = 6
_KIND[128:] = 7

NAMES = (
    "log_bytes", "log_words", "log_lines", "lower", "upper", "digits", "spaces", "stops", "signs", "not_ascii", "other",
    "word_mean", "word_spread", "distinct_words", "top_word", "top_three", "line_mean", "repeated_lines", "short_lines",
    "ended_lines", "bars", "bangs", "entropy", "compressed", "long_words", "repeated_pairs",
)


def statistics(text: bytes) -> list[float]:
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if n else np.zeros(256, np.int64)
    kinds = np.bincount(_KIND, weights=counts, minlength=8) / max(1, n)
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    size = np.fromiter(map(len, words), np.int64, len(words))
    w, m = max(1, len(words)), max(1, len(lines))
    common = [c for _, c in Counter(words).most_common(3)]
    share = counts[counts > 0] / max(1, n)
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), *kinds[1:8], kinds[0],
        size.mean() if len(words) else 0.0, size.std() if len(words) else 0.0, len(set(words)) / w, (common or [0])[0] / w, sum(common) / w,
        len(words) / m, 1 - len(set(lines)) / m, sum(len(x) < 20 for x in lines) / m, sum(x.rstrip()[-1:] in b".!?" for x in lines) / m,
        counts[ord("|")] / max(1, n), counts[ord("!")] / max(1, n), float(-(share * np.log2(share)).sum()), len(zlib.compress(text, 1)) / max(1, n),
        float((size > 20).mean()) if len(words) else 0.0, 1 - len(set(zip(words, words[1:], strict=False))) / max(1, len(words) - 1),
    ]


@dataclass(frozen=True)
class QualityModel:
    edges: list[np.ndarray]  # of each feature
    feature: np.ndarray  # (trees, 2^depth - 1)
    split: np.ndarray  # bins; a greater one goes right
    leaf: np.ndarray  # (trees, 2^depth)
    base: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.leaf):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        b, rows = self.binned(x), np.arange(len(x))[:, None]
        trees, inner = np.arange(len(self.leaf))[None, :], self.feature.shape[1]
        at = np.zeros((len(x), len(self.leaf)), np.int64)
        while len(x) and at[0, 0] < inner:
            at = 2 * at + 1 + (b[rows, self.feature[trees, at]] > self.split[trees, at])
        z = self.base + self.leaf[trees, at - inner].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> QualityModel:
    """Second-order boosting on the logistic loss; deterministic."""
    n, width = len(x), len(NAMES)
    share = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        none = np.empty((0, 1), np.int64)
        return QualityModel([np.empty(0)] * width, none, none, np.empty((0, 2)), base)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(width)]
    model = QualityModel(edges, np.empty((0, 1), np.int64), np.empty((0, 1), np.int64), np.empty((0, 2)), base)
    b = model.binned(x) + np.arange(width) * BINS
    inner = 2**depth - 1
    feature, split, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), BINS), np.zeros((trees, inner + 1))
    z = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            nodes, first = 2**level, 2**level - 1
            cell = ((at - first)[:, None] * (width * BINS) + b).ravel()
            hist = [np.bincount(cell, np.repeat(v, width), nodes * width * BINS).reshape(nodes, width, BINS).cumsum(axis=2) for v in (g, h)]
            (gl, hl), (gs, hs) = hist, (hist[0][:, :, -1:], hist[1][:, :, -1:])
            gain = gl**2 / (hl + SHRINK) + (gs - gl) ** 2 / (hs - hl + SHRINK) - gs**2 / (hs + SHRINK)
            gain[(hl < LEAST / 4) | (hs - hl < LEAST / 4)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            good = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-9
            feature[t, first : first + nodes] = np.where(good, best // BINS, 0)
            split[t, first : first + nodes] = np.where(good, best % BINS, BINS)
            f = feature[t, at]
            at = 2 * at + 1 + (b[np.arange(n), f] - f * BINS > split[t, at])
        own = at - inner
        leaf[t] = -RATE * np.bincount(own, g, inner + 1) / (np.bincount(own, h, inner + 1) + SHRINK)
        z = z + leaf[t, own]
    return QualityModel(edges, feature, split, leaf, base)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [statistics(t or b"") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.float64()))], ["label", "own"])


def train_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", rows: int = TRAIN_ROWS) -> QualityModel:
    """docs (id_col, text), labels (id_col, label 0/1: only rows to learn from) -> the model.

    Labels other than 0 and 1 and rows of a null id teach nothing; an id of two labels or two rows teaches each; null
    texts count as empty ones, very long ones are read whole, equal rows teach once, and without rows the model is a constant.
    About `rows` labels and twice as many rows teach at most.  Other columns of docs are not read and may have any name.
    """
    known = stage(labels.select(F.col(id_col).alias("l_id"), F.col("label").cast("int").alias("label")).where("label in (0, 1) and l_id is not null").distinct(), "labels")
    sample = bounded_sample(known, rows, "l_id")  # of bounded size, so it may be broadcast
    own = bounded_rows(docs.select(F.col(id_col).alias("id"), "text").join(F.broadcast(sample), F.col("id") == F.col("l_id")), rows)
    got = map_texts(own, ["label"], _statistics, "label int, own array<double>").toPandas()
    x = np.array(got["own"].tolist(), np.float64).reshape(len(got), len(NAMES))
    order = np.lexsort([*x.T, got["label"].to_numpy()])  # the order of arrival does not matter
    return fit(x[order], got["label"].to_numpy(np.float64)[order])


def _scores(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t or b"") for t in batch.column(1).to_pylist()], np.float64).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id") -> DataFrame:
    """docs (id_col, text) -> (doc_id, score): 0 to 1, higher is likelier good.

    Null scores as the empty text; whole texts are read; each row of a repeated id is scored;
    with no labels, or labels of one kind, all scores are the smoothed share of good labels.  An empty
    table gives an empty result; other columns are not read and may have any name.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), "text")
    return map_texts(own, ["doc_id"], _scores(model), "doc_id long, score double")
