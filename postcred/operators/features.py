"""Feature-table operators (F9-F14): assembly, normalisation and scaling.

Fitted statistics (means, standard deviations, sums, minima / maxima) are one-row aggregates:
they are computed by a single distributed ``agg`` and applied as literals, so applying them is a
projection with no join and no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postcred.functions.features import row_max_normalize as _row_max_cols
from postcred.schemas import FEATURES, KEY


def five_features(frames: Sequence[DataFrame], key: Sequence[str] = KEY,
                  cols: Sequence[str] = FEATURES) -> DataFrame:
    """equi-join per-post feature tables on the post key and keep the five features.

    (The reference zips lists by position; a key join cannot misalign rows.)  All inputs are
    derived from the deduplicated posts, so they share its key partitioning.
    """
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, list(key))
    return out.select(*key, *[F.col(c).cast("double").alias(c) for c in cols])


def row_max_normalize(df: DataFrame, cols: Sequence[str] = FEATURES) -> DataFrame:
    """divide each feature by the row's max; a zero max gives zeros."""
    keep = [c for c in df.columns if c not in cols]
    return df.select(*keep, *_row_max_cols(cols))


def abs_features(df: DataFrame, cols: Sequence[str] = FEATURES) -> DataFrame:
    """absolute values of the feature columns."""
    return df.select(*[F.abs(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


@dataclass(frozen=True)
class StandardStats:
    """Fitted z-score parameters: per column mean and population std (0 std -> scale 1)."""
    cols: tuple
    means: tuple
    scales: tuple

    def as_rows(self):
        return [(c, m, s) for c, m, s in zip(self.cols, self.means, self.scales)]


def standardize_fit(df: DataFrame, cols: Sequence[str] = FEATURES) -> StandardStats:
    """F12 fit: one aggregation for all means and population standard deviations."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    row = df.agg(*aggs).first()
    means = tuple(float(row[f"m_{c}"] or 0.0) for c in cols)
    scales = tuple((float(row[f"s_{c}"]) if row[f"s_{c}"] else 1.0) or 1.0 for c in cols)
    return StandardStats(tuple(cols), means, scales)


def standardize_apply(df: DataFrame, stats: StandardStats) -> DataFrame:
    """F12 apply: ``(x - mean) / std`` with the fitted literals."""
    m = dict(zip(stats.cols, stats.means))
    s = dict(zip(stats.cols, stats.scales))
    return df.select(*[((F.col(c) - F.lit(m[c])) / F.lit(s[c])).alias(c) if c in m else F.col(c)
                       for c in df.columns])


def standardize(df: DataFrame, cols: Sequence[str] = FEATURES) -> DataFrame:
    """F12 fit + apply: one aggregation for the statistics, then a projection with literals."""
    return standardize_apply(df, standardize_fit(df, cols))


def column_sum_normalize(df: DataFrame, cols: Sequence[str] = FEATURES) -> DataFrame:
    """each value divided by its column sum (a zero sum gives NULL, as 0/0 would be NaN)."""
    row = df.agg(*[F.sum(c).alias(c) for c in cols]).collect()[0]        # one row of sums
    tot = {c: row[c] for c in cols}
    return df.select(*[F.try_divide(F.col(c), F.lit(tot[c]).cast("double")).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def minmax_int_scale(df: DataFrame, col: str, lo: float = 0.0, hi: float = 1.0, out: str | None = None) -> DataFrame:
    """rescale a column to [lo, hi] and truncate toward zero; a constant column gives 0."""
    out = out or col
    row = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).collect()[0]   # one row
    old_lo, old_hi = row["lo"], row["hi"]
    keep = [c for c in df.columns if c != out]
    if old_lo is None or old_hi - old_lo == 0:
        return df.select(*keep, F.lit(0).cast("long").alias(out))
    factor = float(hi - lo) / float(old_hi - old_lo)
    scaled = (F.col(col) - F.lit(float(old_lo))) * F.lit(factor) + F.lit(float(lo))
    return df.select(*keep, scaled.cast("long").alias(out))
