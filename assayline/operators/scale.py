"""Scaling fitted on train rows: A25, A26, M8, M9.

Spark ML's MinMaxScaler maps a constant column to 0.5 and StandardScaler
uses the sample std; the reference (scikit-learn) maps a zero range to a
divisor of 1 and uses the population std. Both are written as expressions.
The fit is one aggregate over train rows (two values per feature, read
once), then a projection — no join, no shuffle.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def _wide_fit(df: DataFrame, features: Sequence[str], aggs: dict, split_col, fit_on):
    """One aggregate row with every (feature, statistic), turned into one row
    per feature: a single pass, no row copies."""
    src = df.where(F.col(split_col) == fit_on) if split_col else df
    wide = src.agg(*[fn(F.col(c).cast("double")).alias(f"{i}__{a}")
                     for i, c in enumerate(features) for a, fn in aggs.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"),
                              *[F.col(f"{i}__{a}").alias(a) for a in aggs])
                     for i, c in enumerate(features)])
    return wide.select(F.inline(rows))


def minmax_fit(df: DataFrame, features: Sequence[str], split_col: str | None = "split",
               fit_on: str = "train") -> DataFrame:
    """(feature, min, max) over the fit rows, one aggregate."""
    return _wide_fit(df, features, {"min": F.min, "max": F.max}, split_col, fit_on)


def standard_fit(df: DataFrame, features: Sequence[str], split_col: str | None = "split",
                 fit_on: str = "train") -> DataFrame:
    """(feature, mean, population std) over the fit rows, one aggregate."""
    return _wide_fit(df, features, {"mean": F.avg, "std": F.stddev_pop}, split_col, fit_on)


def _params(fit: DataFrame, a: str, b: str) -> dict:
    # One row per feature: bounded by the schema width.
    return {r["feature"]: (r[a], r[b]) for r in fit.collect()}


def minmax_scale(df: DataFrame, features: Sequence[str], split_col: str | None = "split",
                 fit_on: str = "train") -> DataFrame:
    """M8: (x - min) / (max - min); a zero range divides by 1; no clipping
    for rows outside the train range."""
    p = _params(minmax_fit(df, features, split_col, fit_on), "min", "max")
    out = []
    for c in df.columns:
        if c in p:
            lo, hi = p[c]
            lo_l, rng = F.lit(lo).cast("double"), F.lit(None if lo is None else hi - lo)
            div = F.when(rng == 0, F.lit(1.0)).otherwise(rng.cast("double"))
            out.append(((F.col(c).cast("double") - lo_l) / div).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def standard_scale_passthrough(df: DataFrame, scaled: Sequence[str], passthrough: Sequence[str],
                               keep: Sequence[str] = (), split_col: str | None = "split",
                               fit_on: str = "train") -> DataFrame:
    """M9: standardise ``scaled`` (population std, zero std divides by 1),
    pass ``passthrough`` unchanged; scaled columns first, as the reference's
    column transformer orders them. ``keep`` columns (label, split) follow."""
    p = _params(standard_fit(df, scaled, split_col, fit_on), "mean", "std")
    cols = []
    for c in scaled:
        m, s = p.get(c, (None, None))
        div = F.lit(1.0) if (s is None or s == 0) else F.lit(s).cast("double")
        cols.append(((F.col(c).cast("double") - F.lit(m).cast("double")) / div).alias(c))
    return df.select(*cols, *passthrough, *keep)
