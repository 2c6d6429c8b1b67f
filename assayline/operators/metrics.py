"""Metrics and result tables: A15-A24, M18, M25, U3, T3, F4-F6, X3.

Predictions are kept in long form (dataset, target, y, p) so the metrics of
all targets and datasets come out of one grouped aggregate.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.functions.scalar import error, residual, round_half_even
from assayline.tables import TARGETS


def smape_expr(y="y", p="p") -> Column:
    """100 x mean |y-p| / ((|y|+|p|)/2); a row with y = p = 0 counts 0."""
    y, p = F.col(y), F.col(p)
    term = F.when((y == 0) & (p == 0), F.lit(0.0)).otherwise(
        F.abs(y - p) / ((F.abs(y) + F.abs(p)) / F.lit(2.0)))
    return F.lit(100.0) * F.avg(term)


def mse_expr(y="y", p="p") -> Column:
    """A18 (the reference reports it as 'MAE')."""
    return F.avg(F.pow(F.col(y) - F.col(p), 2))


def rmse_expr(y="y", p="p") -> Column:
    """A16."""
    return F.sqrt(mse_expr(y, p))


def mae_expr(y="y", p="p") -> Column:
    """A17."""
    return F.avg(F.abs(F.col(y) - F.col(p)))


def r2_expr(y="y", p="p") -> Column:
    """1 - SSE / SST, SST = n * population variance of y."""
    sse = F.sum(F.pow(F.col(y) - F.col(p), 2))
    sst = F.count(F.col(y)) * F.var_pop(F.col(y))
    return F.when(sst != 0, F.lit(1.0) - sse / sst)


# Metric chosen by name.
METRICS = {"smape": smape_expr, "rmse": rmse_expr, "mae": mae_expr, "mse": mse_expr,
           "r2": r2_expr}
DEFAULT_METRICS = ("smape", "rmse", "mae", "mse")


def evaluate(pred: DataFrame, by: Sequence[str] = ("dataset", "target"),
             metrics: Sequence[str] = DEFAULT_METRICS, y: str = "y", p: str = "p") -> DataFrame:
    """One row per group with the chosen metrics."""
    return pred.groupBy(*by).agg(*[METRICS[m](y, p).alias(m) for m in metrics])


def long_labels(df: DataFrame, targets: Sequence[str] = TARGETS,
                keep: Sequence[str] = ()) -> DataFrame:
    """F15 (unpivot): wide scores to (keep..., target, y)."""
    return df.unpivot(list(keep), list(targets), "target", "y")


def prediction_table(pred: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Y, p, residual (y - p), error (p - y) per row."""
    return pred.withColumn("residual", residual(y, p)).withColumn("error", error(y, p))


def mean_of_metrics(metrics: DataFrame, by: Sequence[str] = ("dataset",),
                    cols: Sequence[str] = DEFAULT_METRICS) -> DataFrame:
    """Mean over the targets."""
    return metrics.groupBy(*by).agg(*[F.avg(c).alias(c) for c in cols])


def metric_summary(metrics: DataFrame, cols: Sequence[str] = DEFAULT_METRICS,
                   mean_label: str = "mean") -> DataFrame:
    """A20 + U3 + T3: per-target rows and a mean row per dataset, by dataset."""
    means = mean_of_metrics(metrics, ["dataset"], cols).withColumn("target", F.lit(mean_label))
    return (metrics.select("dataset", "target", *cols)
                   .unionByName(means.select("dataset", "target", *cols))
                   .orderBy("dataset", "target"))


def best_family(summary: DataFrame, metric: str = "rmse") -> DataFrame:
    """The family with the least mean metric (one row)."""
    per = summary.groupBy("family").agg(F.avg(metric).alias(f"mean_{metric}"))
    return per.agg(F.min_by("family", F.col(f"mean_{metric}")).alias("family"),
                   F.min(f"mean_{metric}").alias(f"mean_{metric}"))


def learning_curve_summary(scores: DataFrame) -> DataFrame:
    """Mean and population std of fold scores per train size."""
    return scores.groupBy("size_index", "fraction", "kind").agg(
        F.avg("score").alias("score_mean"), F.stddev_pop("score").alias("score_std"))


def error_histogram(pred: DataFrame, value: str = "error", bins: int = 25,
                    by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins over [min, max]; the last bin is closed. The
    range is one aggregate row per group, joined back (bounded by groups)."""
    by = list(by)
    rng = pred.groupBy(*by).agg(F.min(value).alias("_mn"), F.max(value).alias("_mx"))
    if by:
        j = pred.join(rng, by)
    else:  # one row: read it and use literals
        r = rng.first()
        j = pred.withColumn("_mn", F.lit(r["_mn"]).cast("double")).withColumn(
            "_mx", F.lit(r["_mx"]).cast("double"))
    width = F.col("_mx") - F.col("_mn")
    idx = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col(value) - F.col("_mn")) * F.lit(bins) / width).cast("int"),
                F.lit(bins - 1)))
    return (j.where(F.col(value).isNotNull()).groupBy(*by, idx.alias("bin"))
             .agg(F.count(F.lit(1)).alias("n"),
                  F.first("_mn").alias("range_min"), F.first("_mx").alias("range_max")))


def round3(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Python-style (half-even) rounding to 3 places."""
    return df.withColumns({c: round_half_even(c, 3) for c in cols})


# Fixed predictors: group means of the label on train rows --------------------------
def group_mean_predictor(long: DataFrame, group: Sequence[str], split_col: str = "split",
                         fit_on: Sequence[str] = ("train",)) -> DataFrame:
    """Fit: mean label per (target, group...) over the fit rows."""
    return (long.where(F.col(split_col).isin(*fit_on))
                .groupBy("target", *group).agg(F.avg("y").alias("p")))


def apply_group_mean(long: DataFrame, model: DataFrame, group: Sequence[str]) -> DataFrame:
    """Predict: join the group means (one row per target and group)."""
    return long.join(model, ["target", *group], "left")


def learning_curve_group_mean(long: DataFrame, group: Sequence[str], fold: str = "fold",
                              sub: str = "sub", sizes: Sequence[float] = (0.1, 0.325, 0.55,
                                                                          0.775, 1.0),
                              k: int = 5) -> DataFrame:
    """M23 with the group-mean predictor, without multiplying rows.

    Each row lies in one fold and one nested size bucket (the smallest size
    whose subset holds it), so ONE row-level aggregate of (n, sum y, sum y^2)
    per (fold, bucket, target, group) carries everything: the 25 fits and
    their r2 (SSE = Syy - 2 p Sy + n p^2, SST = Syy - Sy^2 / n) are computed on
    that small table. Returns (size_index, fraction, target, kind, score_mean,
    score_std)."""
    group = list(group)
    cuts = [int(round(f * 10000)) for f in sizes]
    bucket = F.lit(None).cast("int")
    for i in reversed(range(len(cuts))):
        bucket = F.when(F.col(sub) < F.lit(cuts[i]), F.lit(i)).otherwise(bucket)
    stats = (long.groupBy(F.col(fold).alias("_f"), bucket.alias("_b"), "target", *group)
                 .agg(F.count("y").alias("_n"), F.sum("y").alias("_sy"),
                      F.sum(F.col("y") * F.col("y")).alias("_syy")))
    combos = F.array(*[F.struct(F.lit(i).alias("size_index"), F.lit(float(f)).alias("fraction"),
                                F.lit(j).alias("k"))
                       for i, f in enumerate(sizes) for j in range(k)])
    per = stats.select("*", F.inline(combos))
    in_train = (F.col("_f") != F.col("k")) & F.col("_b").isNotNull() & \
        (F.col("_b") <= F.col("size_index"))
    roles = per.withColumn("kind", F.when(F.col("_f") == F.col("k"), F.lit("val"))
                                    .when(in_train, F.lit("train")))
    keys = ["size_index", "k", "target", *group]
    model = (roles.where(F.col("kind") == "train").groupBy(*keys)
                  .agg((F.sum("_sy") / F.sum("_n")).alias("p")))
    cell = (roles.where(F.col("kind").isNotNull())
                 .groupBy("size_index", "fraction", "k", "target", "kind", *group)
                 .agg(F.sum("_n").alias("n"), F.sum("_sy").alias("sy"), F.sum("_syy").alias("syy"))
                 .join(model, keys, "left"))
    p = F.col("p")
    sse = F.when(p.isNotNull(), F.col("syy") - F.lit(2.0) * p * F.col("sy") + F.col("n") * p * p)
    fit = (cell.groupBy("size_index", "fraction", "k", "target", "kind")
               .agg(F.sum(sse).alias("sse"), F.sum("n").alias("n"), F.sum("sy").alias("sy"),
                    F.sum("syy").alias("syy")))
    sst = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    scores = fit.select("size_index", "fraction", "k", "target", "kind",
                        F.when(sst != 0, F.lit(1.0) - F.col("sse") / sst).alias("score"))
    return (scores.groupBy("size_index", "fraction", "target", "kind")
                  .agg(F.avg("score").alias("score_mean"), F.stddev_pop("score").alias("score_std")))
