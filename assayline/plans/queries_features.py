"""Registered queries: features."""

from __future__ import annotations

from assayline.operators import features as F
from assayline.operators import ranks as R
from assayline.plans import flows
from assayline.plans import oracle as Q
from assayline.plans.catalog import register
from assayline.sources.adapter import load_tables

MONTH = 24


@register("features_month_24", Q.with_(Q.features(MONTH)) + "\nSELECT * FROM feat",
          rounded=Q.FEATURE_DOUBLES)
def features_month_24(spark, sf_dir):
    """L1 + L2: the 45-column feature table of month 24."""
    return flows.features(load_tables(spark, sf_dir), MONTH)


def _clean(spark, sf_dir, keep=False):
    return flows.clean(load_tables(spark, sf_dir), MONTH, keep_visit_keys=keep)


_CLEAN_SQL = Q.with_(Q.clean(MONTH))


@register("ratio_peptide_per_protein", _CLEAN_SQL + f"""
SELECT visit_id, UniProt, Peptide, {Q._ratio()} AS Peptide_per_Protein FROM cleaned""",
          rounded=("Peptide_per_Protein",))
def ratio_peptide_per_protein(spark, sf_dir):
    """F2 on the cleaned month."""
    df = _clean(spark, sf_dir, keep=True)
    return F.add_ratio(df).select("visit_id", "UniProt", "Peptide", F.RATIO)


@register("global_percentile_rank", _CLEAN_SQL + f"""
SELECT visit_id, UniProt, Peptide, NPX_log,
       ({Q._avg_rank('NPX_log')}) / count(NPX_log) OVER () AS NPX_log_percentile
FROM cleaned""", rounded=("NPX_log", "NPX_log_percentile"))
def global_percentile_rank(spark, sf_dir):
    """Average-rank percentile over all rows (distributed prefix sums)."""
    df = _clean(spark, sf_dir, keep=True)
    df = df.select("visit_id", "UniProt", "Peptide", "NPX_log")
    return R.average_rank(df, "NPX_log", out="NPX_log_percentile")


@register("global_rank", _CLEAN_SQL + f"""
SELECT visit_id, UniProt, Peptide, PeptideAbundance,
       {Q._avg_rank('PeptideAbundance')} AS PeptideAbundance_rank
FROM cleaned""", rounded=("PeptideAbundance", "PeptideAbundance_rank"))
def global_rank(spark, sf_dir):
    """Plain average rank (pct off); PeptideAbundance has many ties."""
    df = _clean(spark, sf_dir, keep=True)
    df = df.select("visit_id", "UniProt", "Peptide", "PeptideAbundance")
    return R.average_rank(df, "PeptideAbundance", pct=False, out="PeptideAbundance_rank")


@register("protein_percentile_rank", _CLEAN_SQL + f"""
SELECT visit_id, UniProt, Peptide, PeptideAbundance_log,
       ({Q._avg_rank('PeptideAbundance_log', 'UniProt')})
         / count(PeptideAbundance_log) OVER (PARTITION BY UniProt) AS pa_percentile_in_protein
FROM cleaned""", rounded=("PeptideAbundance_log", "pa_percentile_in_protein"))
def protein_percentile_rank(spark, sf_dir):
    """Average-rank percentile within UniProt."""
    df = _clean(spark, sf_dir, keep=True)
    df = df.select("visit_id", "UniProt", "Peptide", "PeptideAbundance_log")
    return R.average_rank(df, "PeptideAbundance_log", ["UniProt"],
                          out="pa_percentile_in_protein")


_PSTATS = [f"PeptideAbundance_log_{s}_in_UniProt" for s in Q.STATS]


@register("protein_abundance_stats", _CLEAN_SQL + "\nSELECT UniProt, "
          + ", ".join(f"{Q._AGG[s].format(c='PeptideAbundance_log')} AS "
                      f"PeptideAbundance_log_{s}_in_UniProt" for s in Q.STATS)
          + " FROM cleaned GROUP BY UniProt", rounded=_PSTATS)
def protein_abundance_stats(spark, sf_dir):
    """A3 (and W4's table): six statistics per UniProt, exact medians."""
    df = _clean(spark, sf_dir)
    cum = F.order_statistics(df, [("PeptideAbundance_log", "UniProt")])
    return F.protein_stats_table(df, cum, "PeptideAbundance_log")


_TCOLS = [f"{t}_{s}" for t in Q.TARGETS for s in Q.STATS]
_PCOLS = [f"{t}_percentile_p{p}" for t in Q.TARGETS for p in (10, 25, 50, 75, 90)]


@register("global_npx_stats", _CLEAN_SQL + "\nSELECT "
          + ", ".join(f"{Q._AGG[s].format(c='NPX_log')} AS NPX_log_{s}_in_all" for s in Q.STATS)
          + " FROM cleaned", rounded=[f"NPX_log_{s}_in_all" for s in Q.STATS])
def global_npx_stats(spark, sf_dir):
    """A2: six statistics of NPX_log as one row."""
    df = _clean(spark, sf_dir)
    return F.global_stats_row(df, ["NPX_log"], Q.STATS,
                              name=lambda c, s: f"{c}_{s}_in_all")


@register("target_stats", _CLEAN_SQL + "\nSELECT "
          + ", ".join(f"{Q._AGG[s].format(c=t)} AS {t}_{s}" for t in Q.TARGETS for s in Q.STATS)
          + " FROM cleaned", rounded=_TCOLS)
def target_stats(spark, sf_dir):
    """A4: 24 statistics of the four targets as one row."""
    df = _clean(spark, sf_dir)
    return F.global_stats_row(df, list(Q.TARGETS), Q.STATS)


@register("target_percentiles", _CLEAN_SQL + "\nSELECT "
          + ", ".join(f"quantile_cont({t}, {p / 100}) AS {t}_percentile_p{p}"
                      for t in Q.TARGETS for p in (10, 25, 50, 75, 90))
          + " FROM cleaned", rounded=_PCOLS)
def target_percentiles(spark, sf_dir):
    """A5: p10, p25, p50, p75, p90 of each target."""
    df = _clean(spark, sf_dir)
    return F.global_stats_row(df, list(Q.TARGETS), ["percentile"])


def _row_stats_sql():
    arr = "list_filter([updrs_1, updrs_2, updrs_3, updrs_4], lambda x: x IS NOT NULL)"
    return _CLEAN_SQL + f""",
a AS (SELECT visit_id, UniProt, Peptide, {arr} AS v FROM cleaned)
SELECT visit_id, UniProt, Peptide,
       list_avg(v) AS updrs_total_mean,
       CASE WHEN len(v) > 0 THEN list_median(v) END AS updrs_total_median,
       list_min(v) AS updrs_total_min, list_max(v) AS updrs_total_max,
       list_stddev_samp(v) AS updrs_total_std, list_var_samp(v) AS updrs_total_var
FROM a"""


@register("row_target_stats", _row_stats_sql(),
          rounded=[f"updrs_total_{s}" for s in Q.STATS])
def row_target_stats(spark, sf_dir):
    """Statistics across the four targets of each row."""
    df = _clean(spark, sf_dir, keep=True)
    return F.row_target_stats(df.select("visit_id", "UniProt", "Peptide", *Q.TARGETS)).drop(
        *Q.TARGETS)


def _patient_sql(table, value):
    return Q.with_() + f"""
SELECT patient_id, max({value}) AS {value}_max, min({value}) AS {value}_min,
       {Q.exact_mean(value)} AS {value}_mean, stddev_samp({value}) AS {value}_std
FROM {table} GROUP BY patient_id"""


_PS_NPX = ("NPX_max", "NPX_min", "NPX_mean", "NPX_std")
_PS_PA = ("PeptideAbundance_max", "PeptideAbundance_min", "PeptideAbundance_mean",
          "PeptideAbundance_std")


@register("patient_stats_npx", _patient_sql("proteins", "NPX"), rounded=_PS_NPX)
def patient_stats_npx(spark, sf_dir):
    """A1 on proteins (all months)."""
    return F.patient_stats(load_tables(spark, sf_dir).proteins, "NPX", decimal_scale=2)


@register("patient_stats_abundance", _patient_sql("peptides", "PeptideAbundance"),
          rounded=_PS_PA)
def patient_stats_abundance(spark, sf_dir):
    """A1 on peptides (all months)."""
    return F.patient_stats(load_tables(spark, sf_dir).peptides, "PeptideAbundance",
                           decimal_scale=2)


@register("join_patient_stats", Q.with_() + """,
ps AS (SELECT patient_id, max(NPX) AS NPX_max, min(NPX) AS NPX_min,
              """ + Q.exact_mean("NPX") + """ AS NPX_mean,
              stddev_samp(NPX) AS NPX_std FROM proteins GROUP BY patient_id)
SELECT p.*, ps.NPX_max, ps.NPX_min, ps.NPX_mean, ps.NPX_std
FROM proteins p LEFT JOIN ps ON p.patient_id = ps.patient_id""", rounded=("NPX",) + _PS_NPX)
def join_patient_stats(spark, sf_dir):
    """Per-patient statistics repeated on each protein row."""
    pr = load_tables(spark, sf_dir).proteins
    return F.join_patient_stats(pr, F.patient_stats(pr, "NPX", decimal_scale=2))


@register("grain_check", _CLEAN_SQL + """
SELECT count(*) AS n_rows, count(DISTINCT patient_id) AS n_patients,
       count(*) = count(DISTINCT patient_id) AS one_row_per_patient FROM cleaned""")
def grain_check(spark, sf_dir):
    """A13."""
    df = _clean(spark, sf_dir)
    return F.grain_check(df)
