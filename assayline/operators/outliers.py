"""Outlier rules and logs: A11, A12, P12-P15, F1, F3.

Bounds are one-row aggregates. They are read once (one row, bounded) and
applied as literals, so later stages that compute their own bounds never
re-run earlier bound jobs, and the final plan holds no joins for them.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.functions.scalar import clip, safe_ln
from assayline.operators.ranks import (column_quantiles, exact_quantiles, interpolate,
                                       quantile_brackets, stack_columns)

# Fixed defaults of the reference.
MEASURES = ("NPX", "PeptideAbundance")
IQR_FACTOR = 1.5
STD_FACTOR = 3


def _fence_cols(factor: float, *keep: str):
    iqr = F.col("q3") - F.col("q1")
    return [*keep, "q1", "q3", iqr.alias("iqr"),
            (F.col("q1") - F.lit(float(factor)) * iqr).alias("lower"),
            (F.col("q3") + F.lit(float(factor)) * iqr).alias("upper")]


def iqr_fences(df: DataFrame, column: str, factor: float = IQR_FACTOR) -> DataFrame:
    """One row (q1, q3, iqr, lower, upper), exact interpolated quartiles."""
    q = exact_quantiles(df, column, [0.25, 0.75], names=["q1", "q3"])
    return q.select(*_fence_cols(factor))


def iqr_fences_by_column(df: DataFrame, columns: Sequence[str], factor: float = IQR_FACTOR) -> DataFrame:
    """A11 for several columns in one job: (column, q1, q3, iqr, lower, upper)."""
    q = column_quantiles(df, columns, [0.25, 0.75], names=["q1", "q3"])
    return q.select(*_fence_cols(factor, "column"))


def sigma_bounds(df: DataFrame, column: str, factor: float = STD_FACTOR) -> DataFrame:
    """One row (mean, std, lower, upper); std with ddof 1."""
    m, s = F.avg(column), F.stddev_samp(column)
    return df.agg(m.alias("mean"), s.alias("std"),
                  (m - F.lit(float(factor)) * s).alias("lower"),
                  (m + F.lit(float(factor)) * s).alias("upper"))


def _bounds(bounds: DataFrame):
    row = bounds.select("lower", "upper").first()
    lo, hi = (row["lower"], row["upper"]) if row is not None else (None, None)
    return (F.lit(lo).cast("double"), F.lit(hi).cast("double"))


def clip_iqr(df: DataFrame, columns: Sequence[str] = MEASURES,
             factor: float = IQR_FACTOR) -> DataFrame:
    """Values below the low fence become the fence, likewise above.

    The reference clips column after column; clipping one column never moves
    another column's quartiles, so all fences come from one job."""
    fences = {r["column"]: (r["lower"], r["upper"])
              for r in iqr_fences_by_column(df, columns, factor).collect()}
    new = {}
    for c in columns:
        lo, hi = fences.get(c, (None, None))
        new[c] = clip(c, F.lit(lo).cast("double"), F.lit(hi).cast("double"))
    return df.withColumns(new)


def iqr_fence_chain(df: DataFrame, columns: Sequence[str] = MEASURES, passes: int = 2,
                    factor: float = IQR_FACTOR) -> list[dict]:
    """Fences of ``passes`` successive IQR clips, from ONE pass over the data.

    Pass k+1's quartiles are those of the clipped column; clipping is monotone
    and keeps the row count, so they follow from pass 1's bracketing order
    statistics with the clip applied to the two brackets (bit-identical to
    re-reading the clipped data). Returns one {column: (lower, upper)} per pass."""
    stacked = stack_columns(df, columns)
    rows = quantile_brackets(stacked, "value", [0.25, 0.75], ["column"]).collect()
    br = {(r["column"], r["i"]): (r["lo"], r["hi"], r["frac"]) for r in rows}  # 2 per column
    chain, clips = [], {c: (None, None) for c in columns}
    k = float(factor)
    for _ in range(passes):
        fences = {}
        for c in columns:
            if (c, 0) not in br:
                fences[c] = (None, None)
                continue
            a, b = clips[c]

            def g(x, a=a, b=b):
                return x if a is None else min(max(x, a), b)
            q1 = interpolate(g(br[(c, 0)][0]), g(br[(c, 0)][1]), br[(c, 0)][2])
            q3 = interpolate(g(br[(c, 1)][0]), g(br[(c, 1)][1]), br[(c, 1)][2])
            iqr = q3 - q1
            lo, hi = q1 - k * iqr, q3 + k * iqr
            fences[c] = (lo, hi)
            # the next pass sees the composition of both clips
            clips[c] = (lo, hi) if a is None else (min(max(lo, a), b), min(max(hi, a), b))
        chain.append(fences)
    return chain


def apply_clip(df: DataFrame, fences: dict) -> DataFrame:
    """P12 with known fences (literals)."""
    return df.withColumns({c: clip(c, F.lit(lo).cast("double"), F.lit(hi).cast("double"))
                           for c, (lo, hi) in fences.items()})


def filter_iqr(df: DataFrame, columns: Sequence[str] = MEASURES,
               factor: float = IQR_FACTOR) -> DataFrame:
    """Drop rows outside the fences; each column's fences come from the
    rows the previous column left."""
    for c in columns:
        lo, hi = _bounds(iqr_fences(df, c, factor))
        df = df.where(F.col(c).between(lo, hi))
    return df


def null_outliers_sigma(df: DataFrame, columns: Sequence[str] = MEASURES,
                        factor: float = STD_FACTOR) -> DataFrame:
    """Values outside mean +/- k std become NULL. Nulling one column
    leaves the others' moments alone, so one aggregate serves all columns."""
    k = F.lit(float(factor))
    aggs = []
    for i, c in enumerate(columns):
        m, s = F.avg(c), F.stddev_samp(c)
        aggs += [(m - k * s).alias(f"lo{i}"), (m + k * s).alias(f"hi{i}")]
    row = df.agg(*aggs).first()
    new = {}
    for i, c in enumerate(columns):
        lo, hi = F.lit(row[f"lo{i}"]).cast("double"), F.lit(row[f"hi{i}"]).cast("double")
        new[c] = F.when(F.col(c).between(lo, hi), F.col(c))
    return df.withColumns(new)


def filter_sigma(df: DataFrame, columns: Sequence[str] = MEASURES,
                 factor: float = STD_FACTOR) -> DataFrame:
    """Drop rows outside mean +/- k std, column after column."""
    for c in columns:
        lo, hi = _bounds(sigma_bounds(df, c, factor))
        df = df.where(F.col(c).between(lo, hi))
    return df


def add_log_columns(df: DataFrame, columns: Sequence[str] = MEASURES) -> DataFrame:
    """``{c}_log`` = natural log with numpy's edge values."""
    return df.withColumns({f"{c}_log": safe_ln(c) for c in columns})
