"""Toxicity: a counterfactual-regularised classifier.

Logistic regression on which words, and which word beginnings, a text holds.  Besides the loss on
the labels, training penalises the change of the score when the identity terms of a labelled
text are swapped for others of their language or left out (Garg et al., "Counterfactual Fairness in Text
Classification", 2019), so that a neutral mention of a group does not count as toxic.

The vocabulary is chosen from document counts that Spark sums over the training rows; the
model is fitted on the vocabulary's columns of a bounded number of rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm.common import bounded_rows, bounded_sample, map_texts, prepare, stage

TRAIN_ROWS = 20_000  # labelled rows that the model is fitted on, about, at most
VOCABULARY = 1000
LEAST_DOCS = 3  # a feature is known from so many training documents at least
BEGINNING = 5  # characters of a word's beginning that make a feature of their own
L2, FAIRNESS, POSITIVE, STEPS, RATE = 2e-4, 5.0, 3.0, 300, 0.05
THRESHOLD = 0.5

#: Mentions of groups, which say nothing of a text's tone, by language.
IDENTITY_TERMS = {
    "en": (
        "women", "woman", "men", "man", "girls", "boys", "gay", "lesbian", "straight", "transgender", "muslim", "muslims",
        "christian", "christians", "jewish", "jews", "hindu", "buddhist", "atheist", "black", "white", "asian", "latino",
        "african", "european", "american", "immigrant", "immigrants", "refugee", "refugees", "disabled", "deaf", "blind",
        "elderly", "young", "old",
    ),
    "fr": (
        "femmes", "femme", "hommes", "homme", "filles", "garçons", "lesbienne", "musulman", "musulmans", "chrétien", "chrétiens", "juif",
        "juifs", "hindou", "bouddhiste", "athée", "noirs", "blancs", "asiatique", "africain", "européen", "américain", "immigré", "immigrés",
        "réfugié", "réfugiés", "handicapé", "sourd", "aveugle",
    ),
    "de": (
        "frauen", "frau", "männer", "mann", "mädchen", "jungen", "schwul", "lesbisch", "muslime", "moslem", "christen", "juden", "jüdisch",
        "buddhisten", "atheisten", "schwarze", "weiße", "asiaten", "afrikaner", "europäer", "amerikaner", "einwanderer", "flüchtling",
        "flüchtlinge", "behinderte", "gehörlose", "blinde",
    ),
    "es": (
        "mujeres", "mujer", "hombres", "hombre", "chicas", "chicos", "lesbiana", "musulmán", "musulmanes", "cristiano", "cristianos", "judío",
        "judíos", "hindú", "budista", "ateo", "negros", "blancos", "asiático", "africano", "europeo", "americano", "inmigrante", "inmigrantes",
        "refugiado", "refugiados", "discapacitado", "sordo", "ciego",
    ),
}
#: Counterfactual texts of a labelled one: each mention replaced by another term of its language, and all left out.
SWAPS = 3

_GROUPS = [[t.encode() for t in own] for own in IDENTITY_TERMS.values()]
TERMS = sorted({t for own in _GROUPS for t in own})
_GROUP_OF = {t: own for own in reversed(_GROUPS) for t in own}
_TERMS = frozenset(TERMS)
_WORD = re.compile(rb"[a-z\x80-\xff]+")


def features(text: bytes) -> set[bytes]:
    """Distinct lower-case words, and beginnings of longer words with a star, but of no identity terms."""
    words = set(_WORD.findall(text.lower()))
    return words | {b"%b*" % w[:BEGINNING] for w in words - _TERMS if len(w) > BEGINNING}


def counterfactuals(text: bytes, swaps: int = SWAPS) -> list[bytes]:
    """The text with its identity terms swapped for others of their language, and without them; none if it has none.

    Which term comes for which is drawn from the text, so that reruns agree.
    """
    low = text.lower()
    if _TERMS.isdisjoint(_WORD.findall(low)):
        return []
    seed, out = zlib.crc32(low), []
    for k in range(swaps):

        def other(found: re.Match, k: int = k) -> bytes:
            own = _GROUP_OF.get(found[0])
            return found[0] if own is None else own[(own.index(found[0]) + 1 + (seed + 7919 * k) % (len(own) - 1)) % len(own)]

        out.append(_WORD.sub(other, low))
    return [*out, _WORD.sub(lambda found: b"" if found[0] in _TERMS else found[0], low)]


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[bytes, float]
    bias: float

    def score(self, text: bytes) -> float:
        """The known features of a text, each once, through the logistic function."""
        z = self.bias + sum(map(self.weights.get, self.weights.keys() & features(text)))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _known_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [list(features(t or b"")) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], ["label", "own"])


def _rows_of(index: dict[bytes, int]):
    """Of each text the features of the vocabulary, and those of its counterfactuals."""
    known = index.keys()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            own = [sorted(index[x] for x in known & features(t)) for t in texts]
            swapped = [[sorted(index[x] for x in known & features(c)) for c in counterfactuals(t)] for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(own, pa.list_(pa.int32())), pa.array(swapped, pa.list_(pa.list_(pa.int32())))], ["label", "own", "swapped"]
            )

    return run


def vocabulary(train: DataFrame, size: int = VOCABULARY) -> list[bytes]:
    """Features whose presence says most of the label (mutual information), and the identity terms."""
    counts = train.groupBy("label").agg(F.count("*").alias("n")).collect()
    n1 = sum(r.n for r in counts if r.label == 1)
    n0 = sum(r.n for r in counts if r.label == 0)
    if not n0 or not n1:
        return list(TERMS)
    each = map_texts(train, [F.col("label").cast("int").alias("label")], _known_features, "label int, own array<binary>")
    docs = each.select("label", F.explode("own").alias("feature")).groupBy("feature").agg(
        F.sum("label").cast("double").alias("c1"), F.sum(1 - F.col("label")).cast("double").alias("c0")
    ).where(F.col("c1") + F.col("c0") >= LEAST_DOCS)
    n = float(n0 + n1)

    def part(c, ny, nf):
        return F.when(c > 0, c / n * F.log(c * n / (ny * nf))).otherwise(0.0)

    nf = F.col("c1") + F.col("c0")
    gain = (
        part(F.col("c1"), n1, nf) + part(F.col("c0"), n0, nf) + part(n1 - F.col("c1"), n1, n - nf) + part(n0 - F.col("c0"), n0, n - nf)
    )
    best = docs.select("feature", gain.alias("gain")).orderBy(F.desc("gain"), "feature").limit(size)
    return list(dict.fromkeys([bytes(r.feature) for r in best.collect()] + TERMS))


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The logit above which calling a row toxic gives the best F1; of equally good ones the middle of the widest gap."""
    by = np.argsort(z, kind="stable")
    z, found = z[by], np.cumsum(y[by][::-1])[::-1]
    cut = np.flatnonzero(z[1:] > z[:-1]) + 1
    if not len(cut):
        return 0.0
    f1 = 2 * found[cut] / (len(z) - cut + y.sum())
    gap = np.where(f1 >= f1.max() - 1e-12, z[cut] - z[cut - 1], -1.0)
    k = cut[gap.argmax()]
    return float(z[k] + z[k - 1]) / 2


class Sparse:
    """Rows of a few ones: their columns one after another."""

    def __init__(self, rows: list[list[int]], width: int) -> None:
        self.at = np.concatenate([np.empty(0, np.int64), *[np.asarray(r, np.int64) for r in rows]])
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.n, self.width = len(rows), width

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at], self.n)

    def back(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, v[self.row], self.width)


def loss(w: np.ndarray, b: float, x: Sparse, y: np.ndarray, swapped: Sparse, of: np.ndarray, fairness: float, positive: float) -> tuple[float, np.ndarray, float]:
    """The loss and its gradient by w and b.

    Mean log loss, toxic rows weighing `positive`, + L2 + fairness * mean squared difference of the logits of each
    counterfactual text and of the labelled text that it is made `of`.
    """
    z = b + x.times(w)
    p, weight = 1 / (1 + np.exp(-np.clip(z, -40, 40))), np.where(y == 1, positive, 1.0)
    gap = (p - y) * weight / x.n
    value = float((weight * np.where(y == 1, -np.log(np.maximum(p, 1e-300)), -np.log(np.maximum(1 - p, 1e-300)))).mean() + L2 * w @ w)
    g = x.back(gap) + 2 * L2 * w
    if swapped.n:
        change = swapped.times(w) - (z - b)[of]
        value += fairness * float((change * change).mean())
        pull = 2 * fairness * change / swapped.n
        g += swapped.back(pull) - x.back(np.bincount(of, pull, x.n))
    return value, g, float(gap.sum())


def fit(
    rows: list[list[int]], labels: np.ndarray, names: list[bytes], swapped: list[list[list[int]]] | None = None, fairness: float = FAIRNESS, positive: float = POSITIVE
) -> ToxicityModel:
    """Adam on `loss`; swapped: for each row the features of its counterfactuals.

    Last, the bias is moved so that a score of 0.5 separates the training rows best; that changes no swap.
    """
    if not len(labels) or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.0
        return ToxicityModel({}, math.log((share + 1e-3) / (1 - share + 1e-3)))
    size, y = len(names), labels.astype(np.float64)
    swapped = swapped or [[] for _ in rows]
    x, of = Sparse(rows, size), np.repeat(np.arange(len(rows)), [len(s) for s in swapped])
    others = Sparse([c for own in swapped for c in own], size)
    w, b = np.zeros(size), math.log(y.mean() / (1 - y.mean()))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, STEPS + 1):
        _, g, gb = loss(w, b, x, y, others, of, fairness, positive)
        g = np.append(g, gb)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - float(move[-1])
    b -= best_cut(b + x.times(w), y)
    return ToxicityModel({f: float(c) for f, c in zip(names, w, strict=True) if abs(c) > 1e-3}, float(b))


def train_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", rows: int = TRAIN_ROWS, fairness: float = FAIRNESS) -> ToxicityModel:
    """docs (id_col, text), labels (id_col, label 0/1: only rows to learn from) -> the model.

    Labels other than 0 and 1 and rows of a null id teach nothing; an id of two labels or two rows teaches each; null
    texts count as empty ones, very long ones are read whole, equal rows teach once.  Without labels of both kinds the score is
    their smoothed share.  About `rows` labels and twice as many rows teach at most.  Other columns of docs are not read and may have
    any name.
    """
    known = stage(labels.select(F.col(id_col).alias("l_id"), F.col("label").cast("int").alias("label")).where("label in (0, 1) and l_id is not null").distinct(), "labels")
    sample = bounded_sample(known, rows, "l_id")  # of bounded size, so it may be broadcast
    own = docs.select(F.col(id_col).alias("id"), "text")
    train = stage(bounded_rows(own.join(F.broadcast(sample), F.col("id") == F.col("l_id")), rows).select("label", "text"), "toxicity-train")
    names = vocabulary(train)
    index = {f: k for k, f in enumerate(names)}
    got = map_texts(train, ["label"], _rows_of(index), "label int, own array<int>, swapped array<array<int>>").toPandas()
    return fit([list(r) for r in got["own"]], got["label"].to_numpy(np.int64), names, [[list(c) for c in r] for r in got["swapped"]], fairness)


def _scores(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [model.score(t or b"") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id") -> DataFrame:
    """docs (id_col, text) -> (doc_id, score): 0 to 1, higher is likelier toxic.

    Null scores as the empty text; whole texts are read, however long; each row of a repeated id is scored.
    An empty table gives an empty result; other columns are not read and may have any name.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), "text")
    return map_texts(own, ["doc_id"], _scores(model), "doc_id long, score double")


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score is under the threshold, as they were, with all their columns; a null text scores as
    the empty one, each row of a repeated id is judged by itself, whole texts are read, however long."""
    prepare(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: model.score((t or "").encode("utf-8", "replace")))

    return docs.where(score(F.coalesce(F.col("text"), F.lit(""))) < threshold)
