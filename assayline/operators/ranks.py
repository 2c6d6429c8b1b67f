"""Distributed order statistics: average rank, percentile rank, exact quantiles.

The reference ranks with pandas (average rank over ties, divided by the
non-null count) and takes linearly interpolated quantiles. A plain
``Window.orderBy`` or the built-in exact ``percentile`` would hold a whole
group (or the whole table) in one task. Here both are built on one
primitive, a cumulative count over the *distinct values*, at every size:

1. ``value_counts``: rows per (group, value); partial aggregation map-side,
   so a hot value costs one row per map task.
2. ``_before``, the rows of the group with a smaller value: the distinct
   table is range-partitioned on (group, value) into as many slices as the
   session has shuffle partitions and stored with its slice number in the
   shared folder; a window runs per (group, slice), and per-slice totals (at
   most slices + groups rows) give the offsets. No task ever holds more than
   one slice, whatever the size of a group.

Average rank = before + (count + 1) / 2; percentile = that / non-null count.
Quantile p reads positions floor(h), ceil(h) with h = (n - 1) p.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayline.session import store

_C, _BEFORE, _N, _B = "_vc", "_before", "_n", "_slice"


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., value, _vc): non-null values only; rows with a null group key
    are left out, as pandas ``groupby`` does."""
    cond = F.col(value).isNotNull()
    for k in by:
        cond = cond & F.col(k).isNotNull()
    return df.where(cond).groupBy(*by, value).agg(F.count(F.lit(1)).alias(_C))


def cumulative_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., value, _vc, _before, _n) over the distinct values of ``value``."""
    by = list(by)
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = store(value_counts(df, value, by).repartitionByRange(slices, *by, value)
                   .withColumn(_B, F.spark_partition_id()), "slices")
    inner = (Window.partitionBy(*by, _B).orderBy(value)
                   .rowsBetween(Window.unboundedPreceding, -1))
    local = ranged.withColumn("_local", F.coalesce(F.sum(_C).over(inner), F.lit(0)))
    totals = ranged.groupBy(*by, _B).agg(F.sum(_C).alias("_bt"))
    # At most slices + groups rows; per group at most `slices` rows.
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    prior = group.orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (totals.withColumn("_off", F.coalesce(F.sum("_bt").over(prior), F.lit(0)))
                     .withColumn(_N, F.sum("_bt").over(group))
                     .drop("_bt"))
    return (local.join(offsets, [*by, _B])
                 .select(*by, value, _C, (F.col("_off") + F.col("_local")).alias(_BEFORE), _N))


def running_offsets(df: DataFrame, amount: str, by: Sequence[str], order: Sequence[str],
                    out: str = "offset") -> DataFrame:
    """``df`` plus ``out``: the sum of ``amount`` over the group's earlier rows
    (``order`` must tell a group's rows apart). Range slices as in
    :func:`cumulative_counts`: a group may be of any size."""
    by, order = list(by), list(order)
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = store(df.repartitionByRange(slices, *by, *order)
                     .withColumn(_B, F.spark_partition_id()), "slices")
    inner = (Window.partitionBy(*by, _B).orderBy(*order)
                   .rowsBetween(Window.unboundedPreceding, -1))
    prior = Window.partitionBy(*by).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    totals = (ranged.groupBy(*by, _B).agg(F.sum(amount).alias("_bt"))
                    .select(*by, _B, F.coalesce(F.sum("_bt").over(prior), F.lit(0)).alias("_off")))
    return (ranged.withColumn("_local", F.coalesce(F.sum(amount).over(inner), F.lit(0)))
                  .join(totals, [*by, _B])
                  .select(*df.columns, (F.col("_off") + F.col("_local")).alias(out)))


def rank_table(cum: DataFrame, value: str, by: Sequence[str] = (), pct: bool = True,
               out: str = "rank") -> DataFrame:
    """(by..., value, out) from a cumulative-count table."""
    rank = F.col(_BEFORE) + (F.col(_C) + F.lit(1)) / F.lit(2.0)
    if pct:
        rank = rank / F.col(_N)
    return cum.select(*by, value, rank.alias(out))


def attach_rank(df: DataFrame, ranks: DataFrame, value: str, by: Sequence[str] = (),
                rank_value: str | None = None, out: str = "rank") -> DataFrame:
    """Left join of per-value ranks onto the rows (null value -> null rank).
    AQE splits a hot (group, value) key on the row side."""
    rv = rank_value or value
    r = ranks.select(*[F.col(k).alias(f"_rk_{k}") for k in by],
                     F.col(rv).alias("_rv"), F.col(out).alias(f"_ro_{out}"))
    cond = [df[k] == r[f"_rk_{k}"] for k in by] + [df[value] == r["_rv"]]
    return (df.join(r, cond, "left")
              .select(*[df[c] for c in df.columns], r[f"_ro_{out}"].alias(out)))


def average_rank(df: DataFrame, value: str, by: Sequence[str] = (), pct: bool = True,
                 out: str | None = None) -> DataFrame:
    """pandas ``rank(method='average', pct=pct)``, optionally per group; a
    null value (or null group key) gets a null rank."""
    by = list(by)
    out = out or f"{value}_rank"
    cum = cumulative_counts(df, value, by)
    return attach_rank(df, rank_table(cum, value, by, pct, out), value, by, out=out)


def quantiles_from_cumulative(cum: DataFrame, value: str, probs: Sequence[float],
                              by: Sequence[str] = (),
                              names: Sequence[str] | None = None) -> DataFrame:
    """Interpolated quantiles read off a cumulative-count table: only the
    rows holding positions floor(h) and ceil(h) survive the filter."""
    by = list(by)
    names = list(names or [f"q{int(round(p * 100))}" for p in probs])
    targets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"))
                        for i, p in enumerate(probs)])
    h = (F.col(_N) - F.lit(1)) * F.col("_q.p")
    hit = (cum.select("*", F.explode(targets).alias("_q"))
              .where((F.col(_BEFORE) <= F.ceil(h)) & (F.floor(h) < F.col(_BEFORE) + F.col(_C)))
              .groupBy(*by, F.col("_q.i").alias("_i"))
              .agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"),
                   F.first(h - F.floor(h)).alias("_f")))
    qv = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(
        F.col("_lo") + F.col("_f") * (F.col("_hi") - F.col("_lo")))
    picks = [F.max(F.when(F.col("_i") == F.lit(i), qv)).alias(n) for i, n in enumerate(names)]
    return hit.groupBy(*by).agg(*picks) if by else hit.agg(*picks)


def quantile_brackets(df: DataFrame, value: str, probs: Sequence[float],
                      by: Sequence[str] = ()) -> DataFrame:
    """(by..., i, lo, hi, frac): the two order statistics around each
    quantile position and the interpolation weight, from one job. A monotone
    map g (a clip) keeps positions, so the quantile of g(x) is
    g(lo) + frac * (g(hi) - g(lo)) without another pass over the data."""
    by = list(by)
    cum = cumulative_counts(df, value, by)
    targets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"))
                        for i, p in enumerate(probs)])
    h = (F.col(_N) - F.lit(1)) * F.col("_q.p")
    return (cum.select("*", F.explode(targets).alias("_q"))
               .where((F.col(_BEFORE) <= F.ceil(h)) & (F.floor(h) < F.col(_BEFORE) + F.col(_C)))
               .groupBy(*by, F.col("_q.i").alias("i"))
               .agg(F.min(value).alias("lo"), F.max(value).alias("hi"),
                    F.first(h - F.floor(h)).alias("frac")))


def interpolate(lo: float, hi: float, frac: float) -> float:
    """Same arithmetic as the Spark expressions above (IEEE doubles)."""
    return lo if lo == hi else lo + frac * (hi - lo)


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float],
                    by: Sequence[str] = (), names: Sequence[str] | None = None) -> DataFrame:
    """Linear-interpolation quantiles (pandas/numpy default), exact.

    Returns (by..., name_1, ...). Without ``by`` there is always one row
    (nulls when no value exists)."""
    names = list(names or [f"q{int(round(p * 100))}" for p in probs])
    return quantiles_from_cumulative(cumulative_counts(df, value, list(by)), value, probs, by,
                                     names)


def stack_columns(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (),
                  name: str = "column", value: str = "value") -> DataFrame:
    """(by..., column, value): several measures as one long column, so their
    order statistics come out of one job with ``column`` as a group key."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value))
                      for c in columns])
    return df.select(*by, F.inline(pairs))


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                     names: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles of several columns in one job: (by..., column, names...)."""
    return exact_quantiles(stack_columns(df, columns, by), "value", probs, by=[*by, "column"],
                           names=names)
