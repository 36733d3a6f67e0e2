"""Embedding whitening by Chebyshev-filtered subspace iteration.

Entries are scaled to whole numbers, and the fit list holds each distinct vector once, packed into binary blocks
so that a pass reads flat memory.  The covariance itself is never formed: a pass over the blocks gives
X'XQ of the centred rows for a narrow block Q, summed up a tree of bounded fan-in.  A cycle damps the unwanted spectrum
by a Chebyshev polynomial of the covariance (one pass per degree, the interval ends at the smallest Ritz value), then
takes QR and Rayleigh-Ritz.  It ends when the residuals certify the wanted pairs to double precision, or
when they have reached the rounding floor and no longer fall.

Centring is exact: the mean is a whole number plus a fraction below one, both from exact sums.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped, and so are rows whose vector
is empty or not of the most frequent length (the larger one on a tie).  Repeated rows, also with equal or null ids, give
repeated result rows but enter the fit once.  Scaled entries saturate at 2^60.  Components whose eigenvalue is not above
1e-10 of the largest cannot be scaled to unit variance and are left out, so equal vectors or an empty table give no rows.
A deviation beyond 38 digits is null (beyond 63 bits in the query).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postcred.llm.common import stored
from postcred.llm.dense import orthonormal, product, symmetric_eigen

SCALE, OFFSET, BOUND = 64, 1_000_000, 1 << 60
COMPONENTS, GUARD = 16, 16
BLOCK_BYTES, FAN_IN = 1 << 20, 32
LEAST_SHARE = 1e-10


@dataclass
class Whitening:
    """A fitted transform: exact count and sums of the fit list, unit eigenvectors (columns) and what certifies them."""
    n: int
    sums: list[int]
    basis: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    residual: float
    identity_error: float
    passes: int


def scaled(vec: Column, scale: int = SCALE, offset: int = OFFSET) -> Column:
    whole = F.transform(vec, lambda c: F.least(F.greatest(F.floor(c.cast("double") * F.lit(float(scale))), F.lit(-BOUND)), F.lit(BOUND)) + F.lit(offset))
    return whole


def usable(df: DataFrame, id_col: str, vec_col: str, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(id, x) of the rows that have a finite vector."""
    vec = F.col(vec_col)
    odd = F.exists(vec, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == F.lit(float("inf"))))
    return df.where(vec.isNotNull() & (F.size(vec) > 0) & ~F.coalesce(odd, F.lit(False))).select(
        F.col(id_col).alias("id"), scaled(vec, scale, offset).alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0), np.int64)


def fit_blocks(rows: DataFrame) -> DataFrame:
    """The distinct vectors as blocks (data binary): little-endian 64-bit rows, about 1 MB each."""
    def run(batches):
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(np.ascontiguousarray(matrix(b.column(0)), "<i8"))
            size += held[-1].nbytes
            if size >= BLOCK_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).tobytes()], pa.binary())], ["data"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).tobytes()], pa.binary())], ["data"])
    return stored(rows.select("x").distinct().mapInArrow(run, "data binary"), "whiten-fit")


def _sums(blocks: DataFrame, d: int) -> tuple[int, list[int]]:
    """Exact count and per-dimension sums, carried as high and low halves."""
    def run(batches):
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for b in batches:
            for data in b.column(0):
                x = np.frombuffer(data.as_py(), "<i8").reshape(-1, d)
                n += len(x)
                high += (x >> 32).sum(axis=0)
                low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(np.full(d, n)), pa.array(high), pa.array(low)], ["i", "n", "high", "low"])
    got = (blocks.mapInArrow(run, "i long, n long, high long, low long").groupBy("i")
           .agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")]).orderBy("i").collect())  # one row per dimension
    return int(got[0]["n"]), [int(r["high"]) * (1 << 32) + int(r["low"]) for r in got]


class _Pass:
    """Sums of a function of the centred rows over all blocks."""

    def __init__(self, blocks: DataFrame, n: int, sums: list[int]):
        self.blocks, self.n, self.d, self.count = blocks, n, len(sums), 0
        self.base = np.array([s // n for s in sums], np.int64)
        self.part = np.array([(s % n) / n for s in sums])
        self.tasks = blocks.rdd.getNumPartitions()

    def total(self, of, shape: tuple[int, ...]) -> np.ndarray:
        base, part, d = self.base, self.part, self.d

        def run(batches):
            acc = np.zeros(shape)
            for b in batches:
                for data in b.column(0):
                    acc += of((np.frombuffer(data.as_py(), "<i8").reshape(-1, d) - base) - part)
            from pyspark import TaskContext
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([acc.tobytes()], pa.binary())], ["p", "acc"])

        def merged(table: pa.Table) -> pa.Table:
            table = table.sort_by("p")
            acc = np.zeros(shape)
            for a in table.column("acc"):
                acc += np.frombuffer(a.as_py()).reshape(shape)
            return pa.table({"p": pa.array([table.column("p")[0].as_py() // FAN_IN], pa.int64()), "acc": pa.array([acc.tobytes()], pa.binary())})

        parts, left = self.blocks.mapInArrow(run, "p long, acc binary"), self.tasks
        while left > FAN_IN:  # each group sums FAN_IN partial results
            parts = parts.groupBy(F.floor(F.col("p") / FAN_IN)).applyInArrow(merged, "p long, acc binary")
            left = -(-left // FAN_IN)
        self.count += 1
        rows = parts.collect()  # at most FAN_IN matrices of dimensions x block width
        out = np.zeros(shape)
        for r in sorted(rows, key=lambda r: r["p"]):
            out += np.frombuffer(r["acc"]).reshape(shape)
        return out

    def covariance_times(self, q: np.ndarray) -> np.ndarray:
        return self.total(lambda z: z.T @ (z @ q), q.shape) / self.n


def principal_pairs(passes: _Pass, wanted: int, guard: int = GUARD, tolerance: float = 2e-15, max_cycles: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Largest eigenvalues of the covariance, their unit eigenvectors, and the largest residual against the first eigenvalue."""
    d = passes.d
    width = min(d, wanted + guard)
    wanted = min(wanted, width)
    q = orthonormal(np.random.default_rng(d).standard_normal((d, width)))
    best, stalled = np.inf, 0
    for _ in range(max_cycles):
        vq = passes.covariance_times(q)
        values, turn = symmetric_eigen(product(q.T, vq))
        q, vq = product(q, turn), product(vq, turn)
        size = max(values[0], 0.0)
        if size == 0:
            return values[:wanted], q[:, :wanted], 0.0
        worst = float(np.sqrt(((vq - q * values) ** 2).sum(axis=0))[:wanted].max()) / size
        stalled = stalled + 1 if worst > best / 2 else 0
        best = min(best, worst)
        if worst <= tolerance * math.sqrt(d) or (stalled >= 2 and best < 1e-11):
            break
        # The interval to damp is [0, high]; the growth of the last wanted pair outside it says how many degrees are due.
        high = max(values[-1], 1e-12 * size)
        half = high / 2
        x = max(values[wanted - 1] / half - 1, 1 + 1e-6)
        growth = math.log(x + math.sqrt(x * x - 1))
        top = math.log(max(size / half - 1, 1) + math.sqrt(max(size / half - 1, 1) ** 2 - 1) + 1e-9)
        degree = max(2, min(math.ceil(math.log(max(worst, 1e-16) / 1e-16) / growth), 24, int(23 / max(top - growth, 1e-9)) + 1))
        sigma = first = half / (size - half) if size > half else 1.0
        y0, y1 = q, (vq - half * q) * (sigma / half)
        for _ in range(degree - 1):
            after = 1 / (2 / first - sigma)
            y0, y1 = y1, (passes.covariance_times(y1) - half * y1) * (2 * after / half) - y0 * (sigma * after)
            sigma = after
        q = orthonormal(y1)
    return values[:wanted], q[:, :wanted], worst


def fit_whitening(rows: DataFrame, components: int = COMPONENTS, guard: int = GUARD) -> Whitening | None:
    """Fit on a table (id, x) of equal lengths; None if it is empty."""
    sample = rows.select(F.size("x").alias("d")).first()
    if sample is None:
        return None
    blocks = fit_blocks(rows)
    n, sums = _sums(blocks, sample["d"])
    passes = _Pass(blocks, n, sums)
    values, basis, residual = principal_pairs(passes, components, guard)
    trace = float(passes.total(lambda z: (z * z).sum(), ()) / n)
    some = values > LEAST_SHARE * values[0] if values[0] > 0 else np.zeros(len(values), bool)
    values, basis = values[some], basis[:, some]
    error = 0.0
    if len(values):
        scaled_basis, k = basis / np.sqrt(values), len(values)

        def moments(z):
            w = z @ scaled_basis
            return np.vstack([w.T @ w, w.sum(axis=0)])
        got = passes.total(moments, (k + 1, k)) / n
        error = float(np.abs(got[:k] - got[k][:, None] * got[k][None, :] - np.eye(k)).max())
    return Whitening(n, sums, basis, values, trace, residual, error, passes.count)


def deviations(x: np.ndarray, n: int, base: np.ndarray, rest: list[int]) -> list:
    """Sum over dimensions of (n * x - S)^2 for each row, exact."""
    away = x - base
    most = int(np.abs(away).max(initial=0)) * n + n
    if most < (1 << 62) and most * most * max(1, x.shape[1]) < (1 << 63):
        t = away * n - np.array(rest, np.int64)
        return [Decimal(int(v)) for v in (t * t).sum(axis=1)]
    out = []
    for row in away.tolist():
        v = sum((n * a - r) ** 2 for a, r in zip(row, rest))
        out.append(Decimal(v) if v < 10 ** 38 else None)
    return out


def apply_whitening(rows: DataFrame, model: Whitening, id_type: str) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error, residual) for each row of (id, x) and component."""
    n, k = model.n, len(model.eigenvalues)
    base = np.array([s // n for s in model.sums], np.int64)
    rest = [s % n for s in model.sums]
    part, basis, scale = np.array([r / n for r in rest]), model.basis, np.sqrt(model.eigenvalues)
    explained, error, residual = model.eigenvalues / model.trace, model.identity_error, model.residual

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part_of = b.slice(lo, 4096)
                x = matrix(part_of.column(1))
                m = len(x)
                white = (((x - base) - part) @ basis) / scale
                at = pa.array(np.repeat(np.arange(m), k))
                dev = pa.array(deviations(x, n, base, rest), pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays(
                    [part_of.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), dev.take(at),
                     pa.array(white.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)), pa.array(np.full(m * k, residual))],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error", "residual"])
    return rows.mapInArrow(run, f"id {id_type}, component int, n long, deviation decimal(38,0), whitened double, explained double, "
                                "identity_error double, residual double")


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS, guard: int = GUARD,
           scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """One row per usable input row and component, with the exact deviation, the whitened coordinate and the fit's figures."""
    kind = df.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    rows = usable(df, id_col, vec_col, scale, offset)
    size = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.where(F.size("x") == (size["d"] if size else 0))
    model = fit_whitening(rows, components, guard)
    if model is None or not len(model.eigenvalues):
        empty = f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double, residual double"
        return df.sparkSession.createDataFrame([], empty).withColumnRenamed("id", id_col)
    return apply_whitening(rows, model, kind).withColumnRenamed("id", id_col)


def op12_embedding_whitening(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return whiten(vectors).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))
