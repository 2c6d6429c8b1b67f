"""Registered queries: data-quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayline.operators import outliers as O
from assayline.operators import reports as RP
from assayline.plans import flows
from assayline.plans import oracle as Q
from assayline.plans.catalog import register
from assayline.sources.adapter import load_tables

MONTH = 24
_COLS = ["visit_id", "visit_month", "patient_id", "UniProt", "Peptide", "PeptideAbundance",
         "NPX", "updrs_1", "updrs_2", "updrs_3", "updrs_4", Q.MED]
_NC = " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in _COLS)


def _joined(spark, sf_dir):
    return flows.joined_month(load_tables(spark, sf_dir), MONTH)


def _with_repeats(spark, sf_dir):
    """Joined month plus a second copy of its urgent-order visits (updrs_4 > 0),
    so that duplicate sets exist."""
    j = _joined(spark, sf_dir)
    return j.unionByName(j.where(F.col("updrs_4") > 0))


_REPEATS = Q.with_(Q.joined(MONTH)) + """,
rep AS (SELECT * FROM joined UNION ALL SELECT * FROM joined WHERE updrs_4 > 0),
g AS (SELECT count(*) AS c FROM rep GROUP BY ALL_COLS)"""
_REPEATS = _REPEATS.replace("ALL_COLS", ", ".join(_COLS))


@register("duplicate_report", _REPEATS + """
SELECT sum(c) AS n_rows, coalesce(sum(CASE WHEN c > 1 THEN c END), 0) AS duplicate_rows,
       sum(c) - count(*) AS rows_removed,
       CAST(coalesce(sum(CASE WHEN c > 1 THEN c END), 0) AS DOUBLE) * 100.0 / sum(c) AS pct_duplicates
FROM g""", rounded=("pct_duplicates",))
def duplicate_report(spark, sf_dir):
    """A7."""
    return RP.duplicate_report(_with_repeats(spark, sf_dir))


@register("duplicate_flag_counts", _REPEATS + """
SELECT c > 1 AS is_duplicate, sum(c) AS n_rows FROM g GROUP BY c > 1""")
def duplicate_flag_counts(spark, sf_dir):
    """A8."""
    return RP.duplicate_flag_counts(_with_repeats(spark, sf_dir))


@register("mark_duplicates", Q.with_(Q.joined(MONTH)) + """,
rep AS (SELECT * FROM joined UNION ALL SELECT * FROM joined WHERE updrs_4 > 0)
SELECT *, count(*) OVER (PARTITION BY """ + ", ".join(_COLS) + """) > 1 AS is_duplicate
FROM rep""")
def mark_duplicates(spark, sf_dir):
    """W5."""
    return RP.mark_duplicates(_with_repeats(spark, sf_dir))


@register("null_report", Q.with_(Q.joined(MONTH)) + f"""
SELECT count(*) AS n_rows, count_if(({_NC}) > 0) AS rows_with_nulls,
       CAST(count_if(({_NC}) > 0) AS DOUBLE) * 100.0 / count(*) AS pct_with_nulls,
       count_if(({_NC}) > 0) AS rows_removed
FROM joined""", rounded=("pct_with_nulls",))
def null_report(spark, sf_dir):
    """A9."""
    return RP.null_report(_joined(spark, sf_dir))


@register("null_count_histogram", Q.with_(Q.joined(MONTH)) + f"""
SELECT CAST({_NC} AS INTEGER) AS null_count, count(*) AS n_rows FROM joined GROUP BY 1""")
def null_count_histogram(spark, sf_dir):
    """A10."""
    return RP.null_count_histogram(_joined(spark, sf_dir))


@register("total_nulls", Q.with_(Q.joined(MONTH)) + f"""
SELECT CAST(coalesce(sum({_NC}), 0) AS BIGINT) AS total_nulls FROM joined""")
def total_nulls(spark, sf_dir):
    """A28."""
    return RP.total_nulls(_joined(spark, sf_dir))


@register("distinct_months", Q.with_() + """
SELECT DISTINCT visit_month FROM clinical""")
def distinct_months(spark, sf_dir):
    """Distinct visit months."""
    return RP.distinct_values(load_tables(spark, sf_dir).clinical, "visit_month")


@register("distinct_patients", Q.with_() + """
SELECT DISTINCT patient_id FROM peptides""")
def distinct_patients(spark, sf_dir):
    """Sorted distinct patients."""
    return RP.distinct_values(load_tables(spark, sf_dir).peptides, "patient_id")


_SIG_COLS = ("visit_id, visit_month, patient_id, UniProt, Peptide, updrs_1, updrs_2, updrs_3, "
             f"updrs_4, {Q.MED}, null_count")


@register("stage_change_report", Q.with_(Q.nonnull(MONTH))
          + Q._sigma_null("nonnull", "s1", "NPX", f"{_SIG_COLS}, PeptideAbundance")
          + Q._sigma_null("s1", "s2", "PeptideAbundance", f"{_SIG_COLS}, NPX") + """,
b AS (SELECT count(*) AS rows_before, coalesce(sum(CAST(NPX IS NULL AS INTEGER)
        + CAST(PeptideAbundance IS NULL AS INTEGER)), 0) AS nulls_before FROM nonnull),
a AS (SELECT count(*) AS rows_after, coalesce(sum(CAST(NPX IS NULL AS INTEGER)
        + CAST(PeptideAbundance IS NULL AS INTEGER)), 0) AS nulls_after FROM s2)
SELECT CAST(rows_before AS BIGINT) AS rows_before, CAST(rows_after AS BIGINT) AS rows_after,
       (rows_before - rows_after) / rows_before AS proportion_removed,
       CAST(nulls_before AS BIGINT) AS nulls_before, CAST(nulls_after AS BIGINT) AS nulls_after,
       CAST(nulls_after - nulls_before AS BIGINT) AS additional_nulls,
       (nulls_after - nulls_before) / (rows_after * 13.0) AS proportion_additional_nulls
FROM b, a""", rounded=("proportion_removed", "proportion_additional_nulls"))
def stage_change_report(spark, sf_dir):
    """A27 across the sigma rule (P14) on the raw measures."""
    before = flows.deduped_non_null(load_tables(spark, sf_dir), MONTH)
    return RP.stage_change_report(before, O.null_outliers_sigma(before))


# P20 / P22 over the null-dropped month table --------------------------------------------
_SCHEMA = [("visit_id", "object"), ("visit_month", "int32"), ("patient_id", "int64"),
           ("UniProt", "object"), ("Peptide", "object"), ("PeptideAbundance", "float64"),
           ("NPX", "float64"), ("updrs_1", "float64"), ("updrs_2", "float64"),
           ("updrs_3", "float64"), ("updrs_4", "float64"), (Q.MED, "object"),
           ("null_count", "int32")]


def _target_case(col, src):
    if src == "object":
        return "'category'"
    if src.startswith("int"):
        return (f"CASE WHEN {col}__lo > -128 AND {col}__hi < 127 THEN 'int8' "
                f"WHEN {col}__lo > -32768 AND {col}__hi < 32767 THEN 'int16' "
                f"WHEN {col}__lo > -2147483648 AND {col}__hi < 2147483647 THEN 'int32' "
                f"ELSE 'int64' END")
    return (f"CASE WHEN {col}__lo > -65504.0 AND {col}__hi < 65504.0 THEN 'float16' "
            f"WHEN {col}__lo > -3.4028234663852886e38 AND {col}__hi < 3.4028234663852886e38 "
            f"THEN 'float32' ELSE 'float64' END")


def _downcast_sql(tail: str | None = None):
    aggs = ["count(*) AS n_rows"]
    for c, k in _SCHEMA:
        if k == "object":
            aggs += [f"CAST(count(DISTINCT {c}) AS DOUBLE) AS {c}__lo", f"CAST(NULL AS DOUBLE) AS {c}__hi"]
        else:
            aggs += [f"CAST(min({c}) AS DOUBLE) AS {c}__lo", f"CAST(max({c}) AS DOUBLE) AS {c}__hi"]
    rows = []
    for c, k in _SCHEMA:
        obj = k == "object"
        rows.append(
            f"SELECT n_rows, '{c}' AS \"column\", '{k}' AS source_type, "
            f"{'CAST(NULL AS DOUBLE)' if obj else c + '__lo'} AS min, {c}__hi AS max, "
            f"{_target_case(c, k)} AS target_type, "
            f"{c + '__lo' if obj else 'CAST(NULL AS DOUBLE)'} AS n_categories FROM s")
    spark_type = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in RP.SPARK_TYPE.items())
    return (Q.with_(Q.nonnull(MONTH)) + f""",
s AS (SELECT {', '.join(aggs)} FROM nonnull),
p AS ({' UNION ALL '.join(rows)})""" + (
        f"\nSELECT *, CASE target_type {spark_type} END AS spark_type FROM p" if tail is None
        else f",\nq AS (SELECT *, CASE target_type {spark_type} END AS spark_type FROM p)\n{tail}"))


@register("downcast_plan", _downcast_sql(), rounded=("min", "max"))
def downcast_plan(spark, sf_dir):
    """P20."""
    return RP.downcast_plan(flows.deduped_non_null(load_tables(spark, sf_dir), MONTH))


def _width_sql(t, ncat):
    w = " ".join(f"WHEN '{a}' THEN {b}" for a, b in RP.WIDTH.items())
    return (f"CASE WHEN {t} = 'category' THEN (CASE WHEN {ncat} < 128 THEN 1 WHEN {ncat} < 32768 "
            f"THEN 2 ELSE 4 END) ELSE (CASE {t} {w} END) END")


@register("downcast_report", _downcast_sql(
    "SELECT CAST(sum(n_rows * " + _width_sql("source_type", "0") + ") AS BIGINT) AS bytes_before, "
    "CAST(sum(n_rows * " + _width_sql("target_type", "n_categories")
    + " + CASE WHEN target_type = 'category' THEN n_categories * 8 ELSE 0 END) AS BIGINT)"
    " AS bytes_after FROM q"))
def downcast_report(spark, sf_dir):
    """P22."""
    return RP.downcast_report(
        flows.deduped_non_null(load_tables(spark, sf_dir), MONTH)).drop("pct_saved")


@register("encode_category", Q.with_(Q.nonnull(MONTH)) + """
SELECT visit_id, UniProt, Peptide, CAST(dense_rank() OVER (ORDER BY UniProt) - 1 AS INTEGER) AS UniProt_code
FROM nonnull""")
def encode_category(spark, sf_dir):
    """UniProt as an alphabetical category code."""
    df = flows.deduped_non_null(load_tables(spark, sf_dir), MONTH).select(
        "visit_id", "UniProt", "Peptide")
    return RP.encode_category(df, "UniProt")


@register("head_5", Q.with_(Q.nonnull(MONTH)) + """
SELECT * FROM nonnull ORDER BY visit_id, UniProt, Peptide LIMIT 5""",
          rounded=("NPX", "PeptideAbundance"))
def head_5(spark, sf_dir):
    """T4: first five rows in key order (the limit is the feature)."""
    return RP.head(flows.deduped_non_null(load_tables(spark, sf_dir), MONTH),
                   ["visit_id", "UniProt", "Peptide"])
