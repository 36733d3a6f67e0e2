"""Clustering (C1-C8): k-means, fuzzy c-means, memberships and label choice.

Centres are a tiny k x d state (k clusters, d = 5 features).  Everything per row - distances,
memberships, arg-max labels - is a projection with the centres as literals, so assigning labels
needs no join and no shuffle.  Fits are iterative: each iteration is one distributed aggregation
(partial sums per task, tree-combined), the driver only holds the k x d centres.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postcred.schemas import FEATURES, KEY

EPS = 2.220446049250313e-16  # float64 machine epsilon: distance floor, as in the reference's library


def canonical_centers(centers: Sequence[Sequence[float]]) -> list[list[float]]:
    """Sort centres lexicographically so labels do not depend on the random start (quirk Q12)."""
    return sorted([list(map(float, c)) for c in centers])


def _dist2(cols: Sequence[str], c: Sequence[float]) -> Column:
    return sum(((F.col(x) - F.lit(float(v))) ** 2 for x, v in zip(cols, c)), F.lit(0.0))


def kmeans_assign(df: DataFrame, centers: Sequence[Sequence[float]], cols: Sequence[str] = FEATURES,
                  out: str = "kmeans_label") -> DataFrame:
    """Label of the nearest centre (first one on ties), centres as literals."""
    d2 = F.array(*[_dist2(cols, c) for c in centers])
    return df.withColumn("_d2", d2).withColumn(
        out, (F.array_position("_d2", F.array_min("_d2")) - 1).cast("int")).drop("_d2")


def _inverse_distances(cols: Sequence[str], centers: Sequence[Sequence[float]], m: float) -> Column:
    p = -2.0 / (m - 1.0)
    return F.array(*[F.pow(F.greatest(F.sqrt(_dist2(cols, c)), F.lit(EPS)), F.lit(p)) for c in centers])


def _num(v: float) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"


def _inv_sql(cols: Sequence[str], centers: Sequence[Sequence[float]], m: float) -> str:
    """SQL text of the array of inverse distance powers ``max(d_j, eps)^(-2/(m-1))``.

    The loops below rebuild this expression every iteration; as one SQL string it costs a
    single call into the JVM instead of hundreds of Column constructions.
    """
    p = -2.0 / (m - 1.0)
    parts = []
    for c in centers:
        d2 = " + ".join(f"pow(`{x}` - {_num(v)}, 2)" for x, v in zip(cols, c))
        parts.append(f"pow(greatest(sqrt({d2}), {_num(EPS)}), {_num(p)})")
    return "array(" + ", ".join(parts) + ")"


def _normalised_sql(arr: str, k: int) -> str:
    total = " + ".join(f"get({arr}, {j})" for j in range(k))
    return "array(" + ", ".join(f"get({arr}, {j}) / ({total})" for j in range(k)) + ")"


def with_memberships(df: DataFrame, centers: Sequence[Sequence[float]], cols: Sequence[str] = FEATURES,
                     m: float = 2.0, out: str = "memberships") -> DataFrame:
    """C4: add ``array<double>`` fuzzy memberships ``u_j = d_j^(-2/(m-1)) / Σ_k d_k^(-2/(m-1))``.

    Distances are floored at machine epsilon so a row sitting on a centre stays finite.  The
    inverse distances are materialised as an array column first (one projection), so each
    membership reads them instead of repeating all k distance expressions.
    """
    k = len(centers)
    rest = [f"`{c}`" for c in df.columns]
    d = df.selectExpr(*rest, f"{_inv_sql(cols, centers, m)} AS `{out}_inv`")
    return d.selectExpr(*rest, f"{_normalised_sql(f'`{out}_inv`', k)} AS `{out}`")


def fuzzy_memberships(df: DataFrame, centers: Sequence[Sequence[float]], cols: Sequence[str] = FEATURES,
                      m: float = 2.0, out: str = "memberships") -> DataFrame:
    """C4 as a DataFrame operator."""
    return with_memberships(df, centers, cols, m, out)


def membership_max(df: DataFrame, memberships: str = "memberships", max_out: str = "max_membership",
                   label_out: str = "fuzzy_label") -> DataFrame:
    """The largest membership and its index (first one on ties, as arg-max)."""
    mx = F.array_max(memberships)
    return df.withColumn(max_out, mx).withColumn(
        label_out, (F.array_position(memberships, mx) - 1).cast("int"))


@dataclass
class FuzzyResult:
    centers: list[list[float]]
    iterations: int
    error: float
    fpc: float
    converged: bool = False


def _with_init_memberships(df: DataFrame, key: Sequence[str], k: int, seed: int, out: str) -> DataFrame:
    """Pseudo-random start memberships from a hash of the row key (repeatable, no driver data)."""
    keys = ", ".join(f"`{c}`" for c in key)
    raw = "array(" + ", ".join(
        f"CAST(xxhash64({keys}, {int(seed)}, {j}) & {(1 << 53) - 1} AS DOUBLE) / {float(1 << 53)!r}D + 1e-12D"
        for j in range(k)) + ")"
    rest = [f"`{c}`" for c in df.columns]
    d = df.selectExpr(*rest, f"{raw} AS `{out}_raw`")
    return d.selectExpr(*rest, f"{_normalised_sql(f'`{out}_raw`', k)} AS `{out}`")


def _center_sums(u: str, cols: Sequence[str], k: int, m: float) -> list[Column]:
    aggs = []
    for j in range(k):
        w = f"pow(get(`{u}`, {j}), {_num(m)})"
        aggs.append(F.expr(f"sum({w})").alias(f"_den{j}"))
        aggs += [F.expr(f"sum({w} * `{c}`)").alias(f"_num{j}_{i}") for i, c in enumerate(cols)]
    return aggs


def _centers_from(row, cols: Sequence[str], k: int) -> list[list[float]]:
    return [[row[f"_num{j}_{i}"] / row[f"_den{j}"] for i in range(len(cols))] for j in range(k)]


def cmeans_step(df: DataFrame, centers: Sequence[Sequence[float]], cols: Sequence[str] = FEATURES, m: float = 2.0) -> list[list[float]]:
    """One c-means iteration: the centres that the memberships for ``centers`` give (in the order of ``centers``)."""
    k = len(centers)
    row = with_memberships(df.select(*cols), centers, cols, m, "_u").agg(*_center_sums("_u", cols, k, m)).collect()[0]
    return _centers_from(row, cols, k)


#: Row count at which the reference's absolute stop rule and the rule per row agree.
ERROR_ROWS = 1000
#: Rows of the sample that a warm start runs on (about; the fit itself always ends on all rows).
WARM_ROWS = 20_000


def fuzzy_cmeans_fit(df: DataFrame, k: int, cols: Sequence[str] = FEATURES, key: Sequence[str] = KEY,
                     m: float = 2.0, error: float = 0.005, max_iter: int = 1500, seed: int = 0,
                     init_centers: Sequence[Sequence[float]] | None = None, per_row: bool = True,
                     warm_rows: int | None = WARM_ROWS) -> FuzzyResult:
    """Fuzzy c-means over all rows until the memberships settle or ``max_iter`` iterations.

    The stop rule looks at the mean square change of a membership row, so the number of iterations does not grow with the rows:
    ``||U_t - U_{t-1}||_F < error * sqrt(n / 1000)``, which for 1000 rows is the reference's absolute rule (``per_row=False`` keeps that
    one for any n).  On more than twice ``warm_rows`` rows the first centres come from a fit on a hash sample of about that many; the
    iterations on all rows start there and run until the rule holds for all rows.  ``iterations`` counts those on all rows.

    Memberships are a function of the centres, so the loop state is k x d doubles.  Iteration t
    is ONE aggregation that yields both the change of memberships between the previous and the
    current centres and the weighted sums for the next centres.  Cache / checkpoint ``df`` first.
    """
    data = df.select(*key, *cols)
    n = data.agg(F.count(F.lit(1))).first()[0]
    if init_centers is None and warm_rows is not None and n > 2 * warm_rows:
        share = int((1 << 32) * warm_rows / n)
        some = data.where(F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 32)) < share).persist()
        init_centers = _cmeans(some, k, cols, key, m, error, max_iter, seed, None, per_row).centers
        some.unpersist()
    return _cmeans(data, k, cols, key, m, error, max_iter, seed, init_centers, per_row, n)


def _cmeans(data: DataFrame, k: int, cols, key, m, error, max_iter, seed, init_centers, per_row, n: int | None = None) -> FuzzyResult:
    n = data.agg(F.count(F.lit(1))).first()[0] if n is None else n
    limit = error * math.sqrt(max(n, 1) / ERROR_ROWS) if per_row else error
    prev_centers = None
    first = init_centers is None
    if first:
        row = _with_init_memberships(data, key, k, seed, "_u").agg(*_center_sums("_u", cols, k, m)).collect()[0]
        centers = _centers_from(row, cols, k)
    else:
        centers = [list(map(float, c)) for c in init_centers]
    err, it = float("inf"), 0
    for it in range(1, max_iter + 1):
        cur = with_memberships(data, centers, cols, m, "_u")
        aggs = _center_sums("_u", cols, k, m)
        if first or prev_centers is not None:
            cur = (_with_init_memberships(cur, key, k, seed, "_p") if first
                   else with_memberships(cur, prev_centers, cols, m, "_p"))
            diff = " + ".join(f"pow(get(_u, {j}) - get(_p, {j}), 2)" for j in range(k))
            aggs.append(F.expr(f"sum({diff})").alias("_err2"))
        row = cur.agg(*aggs).collect()[0]
        if first or prev_centers is not None:
            err = math.sqrt(row["_err2"])
            if err < limit:
                break
        first = False
        prev_centers = centers
        centers = _centers_from(row, cols, k)
    fpc_row = with_memberships(data, centers, cols, m, "_u").agg(
        (F.sum(F.aggregate("_u", F.lit(0.0), lambda a, x: a + x * x)) / F.count(F.lit(1))).alias("fpc")).first()
    return FuzzyResult(canonical_centers(centers), it, err, float(fpc_row["fpc"] or 0.0), err < limit)


def assemble(df: DataFrame, cols: Sequence[str] = FEATURES, out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(df)


def kmeans_fit(df: DataFrame, k: int, cols: Sequence[str] = FEATURES, seed: int = 1,
               max_iter: int = 300, tol: float = 1e-4) -> tuple[KMeansModel, list[list[float]]]:
    """Spark ML k-means (k-means|| init); returns the model and its canonical centres."""
    model = KMeans(k=k, seed=seed, maxIter=max_iter, tol=tol, featuresCol="features").fit(assemble(df, cols))
    return model, canonical_centers([c.tolist() for c in model.clusterCenters()])


def training_labels(df: DataFrame, algorithm: str, out: str = "label") -> DataFrame:
    """The label column to learn: fuzzy arg-max for c-means names, else the k-means label."""
    a = algorithm.lower()
    fuzzy = "cmeans" in a or "c-means" in a or "fuzzy" in a
    return df.withColumn(out, F.col("fuzzy_label" if fuzzy else "kmeans_label"))


def contingency(df: DataFrame, a: str = "kmeans_label", b: str = "fuzzy_label") -> DataFrame:
    """C6 summary: how often each pair of labels from the two clusterings co-occurs."""
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def best_assignment(gain: Sequence[Sequence[float]]) -> list[int]:
    """Column given to each row so that the sum of ``gain`` is largest (shortest augmenting paths with potentials, k^3).

    With fewer columns than rows the table is padded; a row without a column gets -1.
    """
    rows, cols = len(gain), max((len(r) for r in gain), default=0)
    n = max(rows, cols)
    cost = [[-float(gain[i][j]) if i < rows and j < cols else 0.0 for j in range(n)] for i in range(n)]
    up, left, owner = [0.0] * (n + 1), [0.0] * (n + 1), [n] * (n + 1)  # column n stands for "no column yet"
    for i in range(n):
        owner[n] = i
        at, best, before, used = n, [math.inf] * n, [n] * n, [False] * (n + 1)
        while True:
            used[at] = True
            row = owner[at]
            step, to = math.inf, -1
            for j in range(n):
                if used[j]:
                    continue
                slack = cost[row][j] - up[row] - left[j]
                if slack < best[j]:
                    best[j], before[j] = slack, at
                if best[j] < step:
                    step, to = best[j], j
            for j in range(n + 1):
                if used[j]:
                    up[owner[j]] += step
                    left[j] -= step
                elif j < n:
                    best[j] -= step
            at = to
            if owner[at] == n:
                break
        while at != n:
            owner[at] = owner[before[at]]
            at = before[at]
    out = [-1] * rows
    for j in range(cols):
        if owner[j] < rows:
            out[owner[j]] = j
    return out


def adjusted_rand(table: dict[tuple, int]) -> float:
    """Adjusted Rand index of a contingency {(a, b): n}; 1 if both clusterings put all rows in one class or each in its own."""
    pairs = lambda n: n * (n - 1) // 2
    rows, cols = {}, {}
    for (a, b), n in table.items():
        rows[a], cols[b] = rows.get(a, 0) + n, cols.get(b, 0) + n
    both, one, two, total = (sum(pairs(n) for n in x) for x in (table.values(), rows.values(), cols.values(), [sum(rows.values())]))
    expected = one * two / total if total else 0.0
    most = (one + two) / 2
    return 1.0 if most == expected else (both - expected) / (most - expected)


@dataclass
class Matching:
    """``pairs``: label of the first clustering -> matched label of the second (None: unmatched)."""
    pairs: dict
    agreeing: int
    total: int
    rand_index: float


def match_clusterings(df: DataFrame, a: str = "kmeans_label", b: str = "fuzzy_label") -> Matching:
    """The one-to-one matching of two label columns that agrees on most rows, and their adjusted Rand index.

    Only the contingency (labels x labels) reaches the driver; rows with a null label are left out.
    """
    table = {(r[a], r[b]): r["n"] for r in contingency(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b).collect()}
    left, right = sorted({x for x, _ in table}), sorted({y for _, y in table})
    chosen = best_assignment([[table.get((x, y), 0) for y in right] for x in left])
    pairs = {x: right[j] if j >= 0 else None for x, j in zip(left, chosen)}
    return Matching(pairs, sum(table.get((x, y), 0) for x, y in pairs.items()), sum(table.values()), adjusted_rand(table))


def with_matched_label(df: DataFrame, matching: Matching, a: str = "kmeans_label", out: str = "matched_label") -> DataFrame:
    """Add the second clustering's label that matches the row's label of the first."""
    col = F.lit(None).cast("int")
    for x, y in matching.pairs.items():
        if y is not None:
            col = F.when(F.col(a) == x, F.lit(int(y))).otherwise(col)
    return df.withColumn(out, col)


def save_kmeans(model: KMeansModel, path: str) -> None:
    """Persist a fitted k-means model (Spark ML directory format)."""
    model.write().overwrite().save(path)


def load_kmeans(path: str) -> tuple[KMeansModel, list[list[float]]]:
    """Load a k-means model and its canonical centres."""
    model = KMeansModel.load(path)
    return model, canonical_centers([c.tolist() for c in model.clusterCenters()])
