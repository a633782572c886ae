"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with FTRL-proximal and an elastic-net penalty (McMahan et al., 2013), then its
temperature is calibrated on rows left out of the training.  N-grams of 1 to 3 characters of
the lower-cased text are hashed; a text's counts are damped, weighed by IDF and normalised.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm.common import bounded_rows, bounded_sample, map_texts, stage

TRAIN_ROWS = 6_000  # rows that the model is fitted on, about, at most
BINS = 1 << 14
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 1e-3, 1e-3, 3
UNKNOWN = "und"
BLOCK = 1 << 18  # characters whose n-grams are counted at once
_MULT = np.uint64(0x9E3779B97F4A7C15)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of 1 to 3 characters, and how often each occurs; counted in blocks of characters."""
    text, counts = text.lower(), np.zeros(BINS, np.int64)
    for start in range(0, len(text), BLOCK):
        c = np.frombuffer(text[start : start + BLOCK + 2].encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        n = min(BLOCK, len(text) - start)  # n-grams that start in the block
        two = (c[:-1] << np.uint64(21)) | c[1:] | np.uint64(1 << 62)
        three = (c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:] if len(c) > 2 else np.empty(0, np.uint64)
        for keys in (c[:n], two[:n], three[:n]):
            counts += np.bincount(((keys * _MULT) >> np.uint64(50)).astype(np.int64), minlength=BINS)
    at = np.flatnonzero(counts)
    return at, counts[at].astype(np.float64)


@dataclass(frozen=True)
class LanguageModel:
    classes: list[str]
    idf: np.ndarray  # (BINS,)
    weights: np.ndarray  # (BINS, classes)
    bias: np.ndarray
    temperature: float

    def logits(self, text: str) -> np.ndarray:
        at, tf = grams(text)
        return vector(at, tf, self.idf) @ self.weights[at] + self.bias


def vector(at: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(tf)) * idf[at] if len(at) else tf
    norm = np.sqrt(x @ x)
    return x / norm if norm > 0 else x


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: list[str]) -> LanguageModel:
    """rows: (bins, counts) of each text.  Every fifth row calibrates the temperature only."""
    n, k = len(rows), max(1, len(classes))
    rows = [(at.astype(np.int32), tf) for at, tf in rows]
    seen = np.zeros(BINS)
    for at, _ in rows:
        seen[at] += 1
    idf = np.log((1 + n) / (1 + seen)) + 1
    xs = [vector(at, tf, idf).astype(np.float32) for at, tf in rows]
    z, q = np.zeros((BINS + 1, k)), np.zeros((BINS + 1, k))

    def weights(at):
        zz, qq = z[at], q[at]
        w = -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(qq)) / ALPHA + L2)
        return np.where(np.abs(zz) <= L1, 0.0, w)

    train = [i for i in range(n) if i % 5 or n < 50]
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(train):
            at = np.append(rows[i][0], BINS)  # the last is the bias
            x = np.append(xs[i], 1.0)
            w = weights(at)
            p = _softmax(x @ w)
            p[y[i]] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(q[at] + g * g) - np.sqrt(q[at])) / ALPHA * w
            q[at] += g * g
    w = weights(np.arange(BINS + 1))
    rest = [i for i in range(n) if i % 5 == 0] or list(range(n))
    logits = np.array([xs[i] @ w[rows[i][0]] + w[-1] for i in rest]).reshape(len(rest), k)

    def loss(t):
        p = _softmax(logits / t)
        return -np.log(p[np.arange(len(rest)), y[rest]] + 1e-12).mean() if rest else 0.0

    temperature = min(np.geomspace(0.05, 20, 60), key=loss)
    return LanguageModel(classes, idf, w[:-1], w[-1], float(temperature))


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bins as 16-bit and counts as 32-bit numbers, a text's in one string each."""
    for batch in batches:
        both = [grams((t or b"").decode("utf-8", "replace")) for t in batch.column(1).to_pylist()]
        bins = pa.array([a.astype(np.uint16).tobytes() for a, _ in both], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), bins, pa.array([c.astype(np.float32).tobytes() for _, c in both], pa.binary())], ["lang", "bins", "counts"])


def train_model(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", rows: int = TRAIN_ROWS) -> LanguageModel:
    """docs: only the rows to learn from.  Each text's n-gram bins go to the fit, at most BINS of them.

    Rows of a null language or id teach nothing, rows that repeat an id teach each, equal rows once; null and empty texts have no
    n-grams; very long texts are read whole; an empty table gives a model that knows no language.  About `rows` ids and twice as
    many rows teach at most.  Other columns are not read and may have any name.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), "text").where("lang is not null")
    ids = stage(docs.where("id is not null").select(F.col("id").alias("s_id")).distinct(), "language-ids")
    sample = bounded_sample(ids, rows, "s_id")  # of bounded size, so it may be broadcast
    own = bounded_rows(docs.join(F.broadcast(sample), F.col("id") == F.col("s_id")), rows)
    got = map_texts(own, ["lang"], _gram_rows, "lang string, bins binary, counts binary").toPandas()
    got = got.sort_values(["lang", "bins", "counts"], kind="stable").reset_index(drop=True)  # the order of arrival does not matter
    classes = sorted(set(got["lang"]))
    y = np.array([classes.index(x) for x in got["lang"]], np.int64)
    return fit([(np.frombuffer(a, np.uint16), np.frombuffer(c, np.float32)) for a, c in zip(got["bins"], got["counts"], strict=True)], y, classes)


def _predict(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = [], []
            for text in batch.column(1).to_pylist():
                text = (text or b"").decode("utf-8", "replace")
                if not model.classes or not any(map(str.isalpha, text)):
                    lang.append(UNKNOWN)
                    score.append(0.0)
                    continue
                p = _softmax(model.logits(text) / model.temperature)
                best = int(p.argmax())
                lang.append(model.classes[best])
                score.append(float(p[best]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def predict_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id") -> DataFrame:
    """docs (id_col, text) -> doc_id, lang_pred, score.

    Null, empty and letterless texts are `und` with score 0; whole texts are read, however long;
    rows that repeat each get their prediction; no training rows make every text `und`.  An empty table
    gives an empty result; other columns are not read and may have any name.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), "text")
    return map_texts(own, ["doc_id"], _predict(model), "doc_id long, lang_pred string, score double")
