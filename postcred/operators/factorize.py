"""Non-negative factorisation of the feature matrix (F15): X (n x d) ~= H (n x r) . W (r x d).

W is tiny (r x d, both 5 here) and is the only loop state on the driver.  For a given W, every
row's coordinates h are the result of a fixed number of multiplicative updates from a constant
start, computed inside the row (in the fit over Arrow batches, else with ``aggregate``) - so H is always a pure function of
(X, W): no per-row state to carry between iterations, no growing lineage, nothing to checkpoint.
One aggregation per outer iteration yields Hᵀ·X, Hᵀ·H and the squared error for the W update.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postcred.schemas import FEATURES

EPS = 1e-12


@dataclass
class NmfModel:
    basis: list[list[float]]      # W, r x d
    h0: float                     # constant start value of every coordinate
    inner_steps: int
    cols: tuple
    iterations: int
    errors: list[float]
    converged: bool = False


def with_coords(df: DataFrame, cols: Sequence[str], W: np.ndarray, h0: float, steps: int,
                out: str = "_h") -> DataFrame:
    """Add ``out`` = array<double> h per row: ``steps`` updates h <- h * (x Wᵀ) / (h W Wᵀ).

    x·Wᵀ is materialised as a column first so the update lambda only reads a column value.
    """
    r = W.shape[0]
    G = W @ W.T
    xw = F.array(*[sum((F.col(c) * F.lit(float(W[j, i])) for i, c in enumerate(cols)), F.lit(0.0))
                   for j in range(r)])
    init = F.array(*[F.lit(float(h0)) for _ in range(r)])

    def step(h, _s):
        return F.array(*[
            F.get(h, j) * F.get(F.col("_xw"), j)
            / (sum((F.get(h, k) * F.lit(float(G[k, j])) for k in range(r)), F.lit(0.0)) + F.lit(EPS))
            for j in range(r)])

    d = df.withColumn("_xw", xw)
    return d.withColumn(out, F.aggregate(F.sequence(F.lit(1), F.lit(steps)), init, step)).drop("_xw")


def nmf_fit(df: DataFrame, cols: Sequence[str] = FEATURES, rank: int = 5, max_iter: int = 200,
            tol: float = 1e-4, seed: int = 0, inner_steps: int = 30) -> NmfModel:
    """F15 fit on non-negative columns (take ``abs`` first).  Stops when the relative drop of the
    reconstruction error falls below ``tol`` or after ``max_iter`` outer iterations."""
    cols = tuple(cols)
    data = df.select(*cols)
    d = len(cols)
    mean = data.agg(sum((F.avg(c) for c in cols), F.lit(0.0)).alias("m")).first()["m"] / d
    scale = math.sqrt(max(mean, EPS) / rank)
    W = np.abs(np.random.RandomState(seed).standard_normal((rank, d))) * scale
    errors: list[float] = []
    it, done = 0, False
    for it in range(1, max_iter + 1):
        W, err = nmf_step(data, cols, W, scale, inner_steps)
        errors.append(err)
        if len(errors) > 1 and errors[-2] > 0 and (errors[-2] - errors[-1]) / errors[-2] < tol:
            done = True
            break
    return NmfModel([list(map(float, r)) for r in W], scale, inner_steps, cols, it, errors, done)


#: Rows whose coordinates are worked on at once.
WORK_ROWS = 8_192


def _row_coords(x: np.ndarray, W: np.ndarray, h0: float, steps: int) -> np.ndarray:
    """``with_coords`` of the rows of an array, the terms of every sum in the same order."""
    G = W @ W.T
    xw = _product(x, W.T)
    h = np.full((len(x), len(W)), float(h0))
    for _ in range(steps):
        h = h * xw / (_product(h, G) + EPS)
    return h


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` for a small ``b``, without the linear algebra library's threads."""
    out = np.zeros((len(a), b.shape[1]))
    for k in range(b.shape[0]):
        out += a[:, k, None] * b[k]
    return out


def nmf_step(data: DataFrame, cols: Sequence[str], W: np.ndarray, h0: float, inner_steps: int) -> tuple[np.ndarray, float]:
    """One outer iteration: (next basis, reconstruction error of the given one).

    The coordinates are computed over Arrow batches, and every task sends one row of sums.  Rows with a null add nothing.
    """
    rank, d = W.shape

    def run(batches):
        hx, hh, err = np.zeros((rank, d)), np.zeros((rank, rank)), 0.0
        for b in batches:
            whole = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1)
            whole = whole[np.all([c.is_valid().to_numpy(zero_copy_only=False) for c in b.columns], axis=0)]
            for lo in range(0, len(whole), WORK_ROWS):
                x = whole[lo:lo + WORK_ROWS]
                h = _row_coords(x, W, h0, inner_steps)
                for j in range(rank):
                    hx[j] += (h[:, j, None] * x).sum(axis=0)
                    hh[j] += (h[:, j, None] * h).sum(axis=0)
                err += float(((x - _product(h, W)) ** 2).sum())
        v = np.concatenate([hx.ravel(), hh.ravel(), [err]])
        yield pa.RecordBatch.from_arrays([pa.array([v.tolist()], pa.list_(pa.float64()))], ["v"])
    parts = data.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)]).mapInArrow(run, "v array<double>")
    n = rank * (d + rank) + 1
    row = parts.agg(*[F.sum(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(n)]).first()
    v = np.array([row[f"v{i}"] or 0.0 for i in range(n)])
    HX, HH = v[:rank * d].reshape(rank, d), v[rank * d:-1].reshape(rank, rank)
    return W * HX / (HH @ W + EPS), math.sqrt(max(v[-1], 0.0))


def nmf_apply(df: DataFrame, model: NmfModel, out_cols: Sequence[str] | None = None) -> DataFrame:
    """Coordinates of rows for a fitted basis (new data is projected, not re-fitted: quirk Q11)."""
    out_cols = list(out_cols or model.cols)
    W = np.array(model.basis)
    keep = [c for c in df.columns if c not in model.cols]
    d = with_coords(df, model.cols, W, model.h0, model.inner_steps)
    return d.select(*keep, *[F.get("_h", j).alias(out_cols[j]) for j in range(W.shape[0])])
