"""Registered queries: sources, month filter, joins, cleaning."""

from __future__ import annotations

from assayline.operators import clean as C
from assayline.plans import flows
from assayline.plans import oracle as Q
from assayline.plans.catalog import register
from assayline.sources.adapter import load_tables

MONTH = 24


@register("clean_month_24", Q.with_(Q.nonnull(MONTH)) + "\nSELECT * FROM nonnull")
def clean_month_24(spark, sf_dir):
    """Minimum slice: P1 x3, J1, J2, U1, P10."""
    return flows.deduped_non_null(load_tables(spark, sf_dir), MONTH)


def _tables(spark, sf_dir):
    return load_tables(spark, sf_dir)


def _nonnull(spark, sf_dir):
    return flows.deduped_non_null(_tables(spark, sf_dir), MONTH)


# The three tables as loaded -------------------------------------------------
@register("load_proteins", Q.with_() + "\nSELECT * FROM proteins", rounded=("NPX",))
def load_proteins(spark, sf_dir):
    """Proteins table (all months)."""
    return _tables(spark, sf_dir).proteins


@register("load_peptides", Q.with_() + "\nSELECT * FROM peptides", rounded=("PeptideAbundance",))
def load_peptides(spark, sf_dir):
    """Peptides table (all months)."""
    return _tables(spark, sf_dir).peptides


@register("load_clinical", Q.with_() + "\nSELECT * FROM clinical")
def load_clinical(spark, sf_dir):
    """Clinical table (all months)."""
    return _tables(spark, sf_dir).clinical


# P1 ------------------------------------------------------------------------------
@register("filter_month_proteins", Q.with_(Q.joined(MONTH)) + "\nSELECT * FROM m_pro",
          rounded=("NPX",))
def filter_month_proteins(spark, sf_dir):
    """Proteins of month 24 (pruned at the scan)."""
    return C.filter_month(_tables(spark, sf_dir).proteins, MONTH)


@register("filter_month_peptides", Q.with_(Q.joined(MONTH)) + "\nSELECT * FROM m_pep",
          rounded=("PeptideAbundance",))
def filter_month_peptides(spark, sf_dir):
    """Peptides of month 24."""
    return C.filter_month(_tables(spark, sf_dir).peptides, MONTH)


@register("filter_month_clinical", Q.with_(Q.joined(MONTH)) + "\nSELECT * FROM m_cli")
def filter_month_clinical(spark, sf_dir):
    """Clinical rows of month 24."""
    return C.filter_month(_tables(spark, sf_dir).clinical, MONTH)


# J1, J2 ------------------------------------------------------------------------------
@register("join_peptides_proteins", Q.with_(Q.joined(MONTH)) + """
SELECT a.visit_id, a.visit_month, a.patient_id, a.UniProt, a.Peptide, a.PeptideAbundance, b.NPX
FROM m_pep a LEFT JOIN m_pro b ON a.visit_id = b.visit_id AND a.visit_month = b.visit_month
 AND a.patient_id = b.patient_id AND a.UniProt = b.UniProt""")
def join_peptides_proteins(spark, sf_dir):
    """Left join of peptides to proteins."""
    t = C.filter_tables(_tables(spark, sf_dir), MONTH)
    return C.join_peptides_proteins(t.peptides, t.proteins)


@register("join_clinical", Q.with_(Q.joined(MONTH)) + "\nSELECT * FROM joined")
def join_clinical(spark, sf_dir):
    """J1 + J2: the joined month table."""
    return flows.joined_month(_tables(spark, sf_dir), MONTH)


# U1, P9 --------------------------------------------------------------------------------
@register("drop_duplicates_doubled", Q.with_(Q.joined(MONTH)) + """
SELECT DISTINCT * FROM (SELECT * FROM joined UNION ALL SELECT * FROM joined) AS u""")
def drop_duplicates_doubled(spark, sf_dir):
    """U1 on the joined month unioned with itself (every row has a copy)."""
    j = flows.joined_month(_tables(spark, sf_dir), MONTH)
    return C.drop_duplicates(j.unionByName(j))


_ALL_JOINED = ["visit_id", "visit_month", "patient_id", "UniProt", "Peptide", "PeptideAbundance",
               "NPX", "updrs_1", "updrs_2", "updrs_3", "updrs_4", Q.MED]


@register("null_count", Q.with_(Q.joined(MONTH)) + "\nSELECT *, CAST("
          + " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in _ALL_JOINED)
          + " AS INTEGER) AS null_count FROM joined")
def null_count(spark, sf_dir):
    """Nulls per row of the joined month."""
    return C.add_null_count(flows.joined_month(_tables(spark, sf_dir), MONTH))


@register("dropna_joined", Q.with_(Q.joined(MONTH)) + "\nSELECT * FROM joined WHERE "
          + " AND ".join(f"{c} IS NOT NULL" for c in _ALL_JOINED))
def dropna_joined(spark, sf_dir):
    """P11."""
    return C.dropna(flows.joined_month(_tables(spark, sf_dir), MONTH))
