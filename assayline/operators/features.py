"""Feature operators: F2, A1-A6, A13, W1-W4, J3-J5, J10, P6-P8.

All order statistics of one feature build (the global NPX rank, the
per-protein abundance rank, every median) come from ONE stacked
cumulative-count table (see ``ranks``), computed once and stored; the plain
statistics are one aggregate per grouping.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.functions import stats as S
from assayline.functions.scalar import safe_div
from assayline.operators import ranks as R
from assayline.session import store
from assayline.tables import TARGETS

RATIO = "Peptide_per_Protein"
GLOBAL = ""  # group value of whole-table statistics in the stacked table


# F2 ------------------------------------------------------------------------------
def add_ratio(df: DataFrame) -> DataFrame:
    """Peptide_per_Protein = PeptideAbundance / NPX (x/0 -> inf as numpy)."""
    return df.withColumn(RATIO, safe_div("PeptideAbundance", "NPX"))


# Shared order statistics -------------------------------------------------------------
def order_statistics(df: DataFrame, specs: Sequence[tuple[str, str | None]]) -> DataFrame:
    """Cumulative counts for several (column, group column or None) specs in
    one job: (column, grp, value, _vc, _before, _n). Stored, since ranks and
    medians both read it."""
    items = F.array(*[F.struct(F.lit(c).alias("column"),
                               (F.col(g).cast("string") if g else F.lit(GLOBAL)).alias("grp"),
                               F.col(c).cast("double").alias("value"))
                      for c, g in specs])
    stacked = df.select(F.inline(items))
    return store(R.cumulative_counts(stacked, "value", ["column", "grp"]), "cumulative")


def _medians(cum: DataFrame, probs=(0.5,), names=("median",)) -> DataFrame:
    return R.quantiles_from_cumulative(cum, "value", list(probs), ["column", "grp"], list(names))


# W1/W2 + A2 -----------------------------------------------------------------------------
def npx_columns(df: DataFrame, cum: DataFrame, global_q: dict, to_log: bool = True,
                properties_on: str = "all", pct: bool = True,
                stats: Sequence[str] = S.DEFAULT_STATS, simple: dict | None = None) -> DataFrame:
    col = "NPX_log" if to_log else "NPX"
    ranks = R.rank_table(cum.where(F.col("column") == F.lit(col)), "value", pct=pct, out="_r")
    df = R.attach_rank(df, ranks, col, rank_value="value", out="_r")
    consts = [F.lit(global_q[(col, "median")] if s == "median" else simple[f"{col}__{s}"])
              .cast("double").alias(f"{col}_{s}_in_{properties_on}") for s in stats]
    # One projection (chained withColumn re-analyses the whole plan each time).
    return df.select(*[c for c in df.columns if c != "_r"],
                     F.col("_r").alias(f"{col}_percentile_in_{properties_on}"), *consts)


# W3/W4 + A3 -------------------------------------------------------------------------------
def protein_stats_table(df: DataFrame, cum: DataFrame, column: str,
                        stats: Sequence[str] = S.DEFAULT_STATS) -> DataFrame:
    """(UniProt, {column}_{stat}_in_UniProt ...): one row per protein."""
    name = lambda s: f"{column}_{s}_in_UniProt"
    aggs = S.simple_aggs(column, stats, name)
    src = df.where(F.col("UniProt").isNotNull())
    plain = src.groupBy("UniProt").agg(*aggs)
    if "median" not in stats:
        return plain
    med = (_medians(cum.where(F.col("column") == F.lit(column)))
           .select(F.col("grp").alias("UniProt"), F.col("median").alias(name("median"))))
    return plain.join(med, "UniProt", "left")


def abundance_columns(df: DataFrame, cum: DataFrame, to_log: bool = True,
                      properties_on: str = "local", pct: bool = True,
                      stats: Sequence[str] = S.DEFAULT_STATS,
                      source: DataFrame | None = None) -> DataFrame:
    """``source``: the rows without joined columns, when ``df`` already has
    some (the per-protein statistics then do not run those joins again)."""
    col = "PeptideAbundance_log" if to_log else "PeptideAbundance"
    ranks = (R.rank_table(cum.where(F.col("column") == F.lit(col)), "value", ["grp"],
                          pct=pct, out="_r")
              .withColumnRenamed("grp", "UniProt"))
    df = R.attach_rank(df, ranks, col, ["UniProt"], rank_value="value", out="_r")
    df = df.withColumnRenamed("_r", f"{col}_percentile_in_{properties_on}")
    # One row per protein, stored: its size is known when the join is planned,
    # so a small one is broadcast and a large one is shuffled.
    per_protein = store(protein_stats_table(source or df, cum, col, stats), "per-protein")
    out_cols = [f"{col}_{s}_in_UniProt" for s in stats]
    return df.join(per_protein, "UniProt", "left").select(*df.columns, *out_cols)


# A4/A5 ---------------------------------------------------------------------------------------
def target_columns(df: DataFrame, global_q: dict, simple: dict,
                   stats: Sequence[str] = S.DEFAULT_STATS, targets=TARGETS) -> DataFrame:
    cols = []
    for t in targets:
        for s in stats:
            if s == "percentile":
                cols += [F.lit(global_q[(t, f"p{p}")]).cast("double").alias(f"{t}_percentile_p{p}")
                         for p in S.PERCENTILES]
            else:
                v = global_q[(t, "median")] if s == "median" else simple[f"{t}__{s}"]
                cols.append(F.lit(v).cast("double").alias(f"{t}_{s}"))
    return df.select("*", *cols)


def _global_values(df: DataFrame, cum: DataFrame, columns: Sequence[str],
                   stats: Sequence[str], percentiles: bool) -> tuple[dict, dict]:
    """Whole-table statistics as Python floats: one aggregate row plus the
    medians/percentiles read off ``cum``."""
    aggs = []
    for c in columns:
        aggs += S.simple_aggs(c, stats, lambda s, c=c: f"{c}__{s}")
    probs, names = [0.5], ["median"]
    if percentiles:
        probs += [p / 100 for p in S.PERCENTILES]
        names += [f"p{p}" for p in S.PERCENTILES]
    q = {}
    simple = df.agg(*aggs).first().asDict() if aggs else {}
    glob = cum.where((F.col("grp") == F.lit(GLOBAL)) & F.col("column").isin(list(columns)))
    for r in _medians(glob, probs, names).collect():
        for n in names:
            q[(r["column"], n)] = r[n]
    for c in columns:  # an all-null column has no row: NULL statistics
        for n in names:
            q.setdefault((c, n), None)
    return simple, q


def global_stats_row(df: DataFrame, columns: Sequence[str], stats: Sequence[str],
                     name=None) -> DataFrame:
    """A2/A4/A5 as a one-row DataFrame ({column}_{stat} by default)."""
    name = name or (lambda c, s: f"{c}_{s}")
    cum = order_statistics(df, [(c, None) for c in columns])
    simple, q = _global_values(df, cum, columns, stats, "percentile" in stats)
    cols = []
    for c in columns:
        for s in stats:
            if s == "percentile":
                cols += [F.lit(q[(c, f"p{p}")]).cast("double").alias(f"{c}_percentile_p{p}")
                         for p in S.PERCENTILES]
            else:
                v = q[(c, "median")] if s == "median" else simple[f"{c}__{s}"]
                cols.append(F.lit(v).cast("double").alias(name(c, s)))
    return df.sparkSession.range(1).select(*cols)


# A6 ---------------------------------------------------------------------------------------------
def row_target_stats(df: DataFrame, targets=TARGETS,
                     stats: Sequence[str] = S.DEFAULT_STATS) -> DataFrame:
    """updrs_total_{stat}: statistics across the target columns of one row,
    nulls skipped (pandas ``agg(axis=1)``); array functions, no UDF."""
    arr = F.filter(F.array(*[F.col(t).cast("double") for t in targets]), lambda x: x.isNotNull())
    n = F.size(arr)
    total = F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)
    mean = F.when(n > 0, total / n)
    srt = F.array_sort(arr)
    mid = F.floor((n - 1) / 2).cast("int")
    med = F.when(n > 0, (F.element_at(srt, mid + 1)
                         + F.element_at(srt, F.ceil((n - 1) / 2).cast("int") + 1)) / 2)
    ss = F.aggregate(arr, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    var = F.when(n > 1, ss / (n - 1))
    exprs = {"mean": mean, "median": med, "min": F.array_min(arr), "max": F.array_max(arr),
             "std": F.sqrt(var), "var": var}
    return df.select("*", *[exprs[s].alias(f"updrs_total_{s}") for s in stats])


# A1, J3, J4, J5 (L3) ------------------------------------------------------------------------------
def exact_mean(value: str, decimal_scale: int | None):
    """Mean; with ``decimal_scale`` the sum runs in decimal, so the result
    does not depend on summation order (values of that many decimals)."""
    if decimal_scale is None:
        return F.avg(value)
    return F.avg(F.col(value).cast(f"decimal(18,{decimal_scale})")).cast("double")


def patient_stats(df: DataFrame, value: str, decimal_scale: int | None = None) -> DataFrame:
    """A1: max, min, mean, std of a measure per patient."""
    return df.groupBy("patient_id").agg(
        F.max(value).alias(f"{value}_max"), F.min(value).alias(f"{value}_min"),
        exact_mean(value, decimal_scale).alias(f"{value}_mean"),
        F.stddev_samp(value).alias(f"{value}_std"))


def join_patient_stats(df: DataFrame, stats: DataFrame) -> DataFrame:
    """J3."""
    return df.join(stats, "patient_id", "left")


# A13 --------------------------------------------------------------------------------------------------
def grain_check(df: DataFrame) -> DataFrame:
    """One row: rows, distinct patients, and whether they are equal."""
    return (df.agg(F.count(F.lit(1)).alias("n_rows"),
                   F.countDistinct("patient_id").alias("n_patients"))
              .withColumn("one_row_per_patient", F.col("n_rows") == F.col("n_patients")))


# L2 ---------------------------------------------------------------------------------------------------
def build_features(df: DataFrame, to_log: bool = True,
                   percentile_option: bool = True, stats: Sequence[str] = S.DEFAULT_STATS,
                   target_stats: Sequence[str] | None = None, drop_ids: bool = True) -> DataFrame:
    """L2: F2, W1 + A2, W3 + A3, A4, P6 on the cleaned month table."""
    npx = "NPX_log" if to_log else "NPX"
    pa = "PeptideAbundance_log" if to_log else "PeptideAbundance"
    tstats = list(target_stats or stats)
    targets = [t for t in TARGETS if t in df.columns]
    df = add_ratio(df)
    specs = [(npx, None), (pa, "UniProt")] + [(t, None) for t in targets]
    cum = order_statistics(df, specs)
    # One aggregate job and one order-statistic job serve every global value.
    every = list(dict.fromkeys([*stats, *tstats]))
    simple, q = _global_values(df, cum, [npx, *targets], every, "percentile" in tstats)
    base = df
    df = npx_columns(df, cum, q, to_log, pct=percentile_option, stats=stats, simple=simple)
    df = abundance_columns(df, cum, to_log, pct=percentile_option, stats=stats, source=base)
    df = target_columns(df, q, simple, tstats, targets)
    if drop_ids:
        df = df.drop("patient_id", "PeptideAbundance", "NPX", "UniProt", "Peptide")
    return df
