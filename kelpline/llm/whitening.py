"""Whitening of vectors by matrix-free block subspace iteration.

(Saad, "Numerical Methods for Large Eigenvalue Problems", 2011, chapter 5.)  The covariance V of all
vectors is never formed.  A pass over the rows computes Y = V Q = X'(X Q) / n for a block Q of orthonormal
columns; Rayleigh and Ritz give the best eigenvectors within the block from Q'Y, Y's QR decomposition the next block, and the
residuals |V u - e u|, which Y holds too, say when all wanted components are certain.  Where eigenvalues lie so close together that a pass gains
little, the block is widened with fresh directions, at most to as many as a vector has numbers, where a pass ends it.

Numbers are quantised to integers first, so that sums are exact and equal vectors are equal on every machine; a row is
centred as the exact integer n x - S, divided by n, before anything is multiplied.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.llm.common import drop_staged, prepare, stage

COMPONENTS, SCALE, SHIFT = 16, 64, 1_000_000
EXTRA = 16  # columns of the block beside those that are wanted
TOLERANCE = 1e-13  # of a residual, relative to the largest eigenvalue
GAIN = 0.05  # a pass that leaves more of the worst residual than this widens the block
PASSES = 60
#: An eigenvalue under this part of the largest one is rounding: there is no such direction in the data.
FLAT = 1e-12
#: Scaled numbers are held within this, so that differences from a sum of 2**22 rows still are whole 64-bit numbers.
MOST = 2**40


def quantised(vector: str) -> Column:
    """floor(SCALE c), without SHIFT, which cancels wherever rows are centred."""
    return F.transform(F.col(vector).cast("array<double>"), lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(-float(MOST))), F.lit(float(MOST)))))


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n, rounded once; exact integers as far as 64 bits hold them."""
    wide = float(n) * float(np.abs(x).max(initial=0)) + float(np.abs(sums).max(initial=0)) >= 2**62
    whole = x.astype(object) * n - sums.astype(object) if wide else x * n - sums.astype(np.int64)
    return whole.astype(np.float64) / n


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each direction and task: its number of vectors and their sum."""
    n, total = 0, None
    for batch in batches:
        if batch.num_rows:
            own = _matrix(batch.column(0)).sum(axis=0).astype(object)  # of few rows; added up without a bound
            n, total = n + batch.num_rows, own if total is None else total + own
    if total is not None:
        cols = [pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array([str(t) for t in total], pa.string())]
        yield pa.RecordBatch.from_arrays(cols, ["i", "n", "s"])


def moments(fit: DataFrame) -> tuple[int, np.ndarray]:
    """n and the exact sum in each direction."""
    got = fit.select("x").mapInArrow(_sums, "i int, n long, s string").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    return int(got[0].n), np.array([int(r.s) for r in got], object)


def _products(n: int, sums: np.ndarray, q: np.ndarray, small: bool):
    """Partial sums of c c'q, or of q'c c'q where only that is wanted, by entry, a task at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, trace = None, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            c = _centred(_matrix(batch.column(0)), n, sums)
            p = c @ q
            own = (p.T if small else c.T) @ p
            total = own if total is None else total + own
            trace += float((c * c).sum())
        if total is not None:
            i, j = np.indices(total.shape)
            cols = [np.r_[i.ravel(), -1].astype(np.int32), np.r_[j.ravel(), -1].astype(np.int32), np.r_[total.ravel(), trace]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["i", "j", "v"])

    return run


def multiply(fit: DataFrame, n: int, sums: np.ndarray, q: np.ndarray, small: bool = False) -> tuple[np.ndarray, float]:
    """V q (or q'V q) and the trace of V: one pass.  Tasks give partial sums, which Spark adds up by entry, so that
    the driver gets one matrix of dims x width, whatever the number of tasks."""
    got = fit.select("x").mapInArrow(_products(n, sums, q, small), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out, own = np.zeros((q.shape[1] if small else q.shape[0], q.shape[1])), got[got["i"] >= 0]
    out[own["i"], own["j"]] = own["v"]
    return out / n, float(got.loc[got["i"] < 0, "v"].iloc[0]) / n


def leading_components(fit: DataFrame, n: int, sums: np.ndarray, k: int = COMPONENTS, extra: int = EXTRA, tolerance: float = TOLERANCE, seed: int = 11):
    """(eigenvalues, unit eigenvectors as columns, trace, passes) of the k largest eigenvalues of the covariance of fit (x)."""
    rng, d = np.random.default_rng(seed), len(sums)
    k = min(k, d)
    q, before, worst = np.linalg.qr(rng.standard_normal((d, min(d, k + extra))))[0], np.inf, np.inf
    for passes in range(1, PASSES + 1):
        y, trace = multiply(fit, n, sums, q)
        inner = q.T @ y
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        u, vu = q @ turn, y @ turn
        worst = np.linalg.norm(vu[:, :k] - u[:, :k] * values[:k], axis=0).max()
        # All directions in the block: residuals are rounding, and nothing is left to find.
        if worst <= tolerance * max(values[0], 0.0) or q.shape[1] == d:
            return values[:k], u[:, :k] / np.linalg.norm(u[:, :k], axis=0), trace, passes
        block = vu
        if worst > GAIN * before:
            block = np.concatenate([vu, values[0] * np.linalg.qr(rng.standard_normal((d, min(d - q.shape[1], q.shape[1]))))[0]], axis=1)
        before, (q, _) = worst, np.linalg.qr(block)
    raise RuntimeError(f"the residual is {worst:.3g} after {PASSES} passes")


def _project(n: int, sums: np.ndarray, w: np.ndarray):
    bound = float(np.iinfo(np.int64).max)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = w.shape[1]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            rough = ((x.astype(np.float64) * n - sums.astype(np.float64)) ** 2).sum(axis=1)
            if rough.max(initial=0) < bound / 4:
                deviation = ((x * n - sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
            else:
                exact = [sum((int(a) * n - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
                deviation = [v if v < 2**63 else None for v in exact]
            z = _centred(x, n, sums) @ w
            each = np.repeat(np.arange(batch.num_rows), k)
            cols = [batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows))]
            cols += [pa.array(deviation, pa.int64()).take(pa.array(each)), pa.array(z.ravel())]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "component", "deviation", "whitened"])

    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", extra: int = EXTRA) -> DataFrame:
    """vectors -> vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component.

    Rows whose vector is null or holds a null or non-finite number are dropped.  A number c becomes
    floor(64 c) + 1000000; n, S and the covariance are over each distinct vector once.  Components are numbered from 1 by falling
    eigenvalue; only directions in which the vectors spread have one, so that equal or single vectors have no rows.
    identity_error: of the covariance of whitened, from a pass over the data.

    Vectors of several lengths are whitened apart, each length by itself; an empty vector has no components.  Null and repeated ids
    are rows like others; equal vectors have equal rows.  A deviation beyond 64 bits is null, and numbers are held within 2**40 after
    scaling.  An empty table gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    prepare(spark)
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    base = base.where(F.coalesce(finite, F.lit(False)) & (F.size("v") > 0)).select("vec_id", quantised("v").alias("x"))
    rows = stage(base, "quantised")
    fit_all = stage(rows.select("x").distinct(), "fit-list")
    out, schema = None, "vec_id long, component int, deviation long, whitened double"
    for (dims,) in sorted(tuple(r) for r in fit_all.select(F.size("x")).distinct().collect()):
        fit = fit_all.where(F.size("x") == dims)
        n, sums = moments(fit)
        values, u, trace, _ = leading_components(fit, n, sums, components, extra)
        held = values > max(0.0, FLAT * values[0])
        if not held.any():
            continue
        values, w = values[held], (u / np.sqrt(np.where(held, values, 1.0)))[:, held]
        own, _ = multiply(fit, n, sums, w, small=True)
        error = float(np.abs(own - np.eye(len(values))).max())
        share = F.get(F.array(*[F.lit(float(v / trace)) for v in values]), F.col("component") - 1)
        part = rows.where(F.size("x") == dims).mapInArrow(_project(n, sums, w), schema)
        part = part.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
        out = part if out is None else out.union(part)
    drop_staged(fit_all)
    if out is None:
        out = spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out
