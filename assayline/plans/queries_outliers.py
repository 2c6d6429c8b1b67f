"""Registered queries: outlier bounds and rules, logs, full clean."""

from __future__ import annotations

from assayline.operators import outliers as O
from assayline.plans import flows
from assayline.plans import oracle as Q
from assayline.plans.catalog import register
from assayline.sources.adapter import load_tables

MONTH = 24
_F = ("q1", "q3", "iqr", "lower", "upper")
_S = ("mean", "std", "lower", "upper")
_KEYS = "visit_id, visit_month, patient_id, UniProt, Peptide"
_REST = f"updrs_1, updrs_2, updrs_3, updrs_4, {Q.MED}, null_count"


def _nonnull(spark, sf_dir):
    return flows.deduped_non_null(load_tables(spark, sf_dir), MONTH)


def _fences_sql(col):
    return Q.with_(Q.nonnull(MONTH)) + f"""
SELECT q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper
FROM (SELECT quantile_cont({col}, 0.25) AS q1, quantile_cont({col}, 0.75) AS q3 FROM nonnull) AS f"""


def _sigma_sql(col):
    return Q.with_(Q.nonnull(MONTH)) + f"""
SELECT mu AS mean, sd AS std, mu - 3 * sd AS lower, mu + 3 * sd AS upper
FROM (SELECT avg({col}) AS mu, stddev_samp({col}) AS sd FROM nonnull) AS b"""


@register("iqr_fences_npx", _fences_sql("NPX"), rounded=_F)
def iqr_fences_npx(spark, sf_dir):
    """Exact IQR fences of NPX."""
    return O.iqr_fences(_nonnull(spark, sf_dir), "NPX")


@register("iqr_fences_abundance", _fences_sql("PeptideAbundance"), rounded=_F)
def iqr_fences_abundance(spark, sf_dir):
    """Exact IQR fences of PeptideAbundance."""
    return O.iqr_fences(_nonnull(spark, sf_dir), "PeptideAbundance")


@register("sigma_bounds_npx", _sigma_sql("NPX"), rounded=_S)
def sigma_bounds_npx(spark, sf_dir):
    """Mean +/- 3 std bounds of NPX."""
    return O.sigma_bounds(_nonnull(spark, sf_dir), "NPX")


@register("sigma_bounds_abundance", _sigma_sql("PeptideAbundance"), rounded=_S)
def sigma_bounds_abundance(spark, sf_dir):
    """Mean +/- 3 std bounds of PeptideAbundance."""
    return O.sigma_bounds(_nonnull(spark, sf_dir), "PeptideAbundance")


_clip_sql = (Q.with_(Q.nonnull(MONTH))
             + Q._iqr_clip("nonnull", "c1", "NPX", f"{_KEYS}, PeptideAbundance, {_REST}")
             + Q._iqr_clip("c1", "c2", "PeptideAbundance", f"{_KEYS}, NPX, {_REST}")
             + "\nSELECT * FROM c2")


@register("clip_iqr", _clip_sql, rounded=("NPX", "PeptideAbundance"))
def clip_iqr(spark, sf_dir):
    """P12 on the null-dropped month table."""
    return O.clip_iqr(_nonnull(spark, sf_dir))


def _seq_filter_sql(kind: str) -> str:
    if kind == "iqr":
        def bounds(src, col):
            return (f"(SELECT quantile_cont({col}, 0.25) - 1.5 * (quantile_cont({col}, 0.75) - "
                    f"quantile_cont({col}, 0.25)) AS lo, quantile_cont({col}, 0.75) + 1.5 * "
                    f"(quantile_cont({col}, 0.75) - quantile_cont({col}, 0.25)) AS hi FROM {src})")
    else:
        def bounds(src, col):
            return (f"(SELECT avg({col}) - 3 * stddev_samp({col}) AS lo, "
                    f"avg({col}) + 3 * stddev_samp({col}) AS hi FROM {src})")
    return Q.with_(Q.nonnull(MONTH)) + f""",
f1 AS (SELECT n.* FROM nonnull n, {bounds('nonnull', 'NPX')} b WHERE NPX BETWEEN b.lo AND b.hi),
f2 AS (SELECT n.* FROM f1 n, {bounds('f1', 'PeptideAbundance')} b
       WHERE PeptideAbundance BETWEEN b.lo AND b.hi)
SELECT * FROM f2"""


@register("filter_iqr", _seq_filter_sql("iqr"))
def filter_iqr(spark, sf_dir):
    """Sequential IQR row filter."""
    return O.filter_iqr(_nonnull(spark, sf_dir))


@register("filter_sigma", _seq_filter_sql("sigma"))
def filter_sigma(spark, sf_dir):
    """Sequential sigma row filter."""
    return O.filter_sigma(_nonnull(spark, sf_dir))


_sigma_null_sql = (Q.with_(Q.nonnull(MONTH))
                   + Q._sigma_null("nonnull", "s1", "NPX", f"{_KEYS}, PeptideAbundance, {_REST}")
                   + Q._sigma_null("s1", "s2", "PeptideAbundance", f"{_KEYS}, NPX, {_REST}")
                   + "\nSELECT * FROM s2")


@register("null_outliers_sigma", _sigma_null_sql)
def null_outliers_sigma(spark, sf_dir):
    """P14 on the raw (unclipped) measures, where it finds outliers."""
    return O.null_outliers_sigma(_nonnull(spark, sf_dir))


@register("log_columns", Q.with_(Q.nonnull(MONTH)) + f"""
SELECT *, {Q._ln('NPX')} AS NPX_log, {Q._ln('PeptideAbundance')} AS PeptideAbundance_log
FROM nonnull""", rounded=("NPX_log", "PeptideAbundance_log"))
def log_columns(spark, sf_dir):
    """F1."""
    return O.add_log_columns(_nonnull(spark, sf_dir))


@register("clean_full_month_24", Q.with_(Q.clean(MONTH)) + "\nSELECT * FROM cleaned",
          rounded=("NPX", "PeptideAbundance", "NPX_log", "PeptideAbundance_log"))
def clean_full_month_24(spark, sf_dir):
    """L1 with the visit keys kept."""
    return flows.clean(load_tables(spark, sf_dir), MONTH, keep_visit_keys=True)
