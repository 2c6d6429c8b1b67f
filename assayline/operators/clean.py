"""Cleaning operators: month filter, joins, duplicates, nulls, drops."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.functions.scalar import drop_existing
from assayline.tables import (AssayTables, CLINICAL_KEYS, DEFAULT_MONTH, MEDICATION_COL,
                              PROTEIN_KEYS)

NULL_COUNT = "null_count"


# P1 ---------------------------------------------------------------------------
def filter_month(df: DataFrame, month: int = DEFAULT_MONTH) -> DataFrame:
    """Rows of one visit month; Catalyst pushes it into the scan/aggregate."""
    return df.where(F.col("visit_month") == F.lit(int(month)))


def filter_tables(tables: AssayTables, month: int = DEFAULT_MONTH) -> AssayTables:
    """P1 on all three tables; the source prunes first when it can."""
    return tables.pruned(month).map(lambda d: filter_month(d, month))


# J1, J2 -----------------------------------------------------------------------
def join_peptides_proteins(peptides: DataFrame, proteins: DataFrame) -> DataFrame:
    """Left equi join of peptides to proteins on visit keys and UniProt."""
    return peptides.join(proteins, list(PROTEIN_KEYS), "left")


def join_clinical(df: DataFrame, clinical: DataFrame) -> DataFrame:
    """Left equi join of the visit scores. The clinical table has one row
    per visit; AQE broadcasts it when its runtime size is under the limit."""
    return df.join(clinical, list(CLINICAL_KEYS), "left")


def join_tables(tables: AssayTables) -> DataFrame:
    return join_clinical(join_peptides_proteins(tables.peptides, tables.proteins),
                         tables.clinical)


# U1 / W5 ----------------------------------------------------------------------
def drop_duplicates(df: DataFrame) -> DataFrame:
    """One row per distinct row (NULLs equal), as ``drop_duplicates()``."""
    return df.dropDuplicates()


# P9, P10, P11 -------------------------------------------------------------------
def null_count_col(columns: Sequence[str]):
    return reduce(lambda a, b: a + b,
                  [F.col(c).isNull().cast("int") for c in columns], F.lit(0))


def add_null_count(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Nulls per row over all columns (or the given ones)."""
    cols = [c for c in (columns or df.columns) if c != NULL_COUNT]
    return df.withColumn(NULL_COUNT, null_count_col(cols))


def not_null_condition(columns: Sequence[str]):
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns], F.lit(True))


def drop_null_rows(df: DataFrame, keep_count: bool = True) -> DataFrame:
    """P10: keep rows without any null, looking at every column.

    Written as an ``isNotNull`` conjunction (not ``dropna``) so Catalyst turns
    the left joins below it into inner joins. With ``keep_count`` the helper
    column ``null_count`` (all zero) is kept, as the reference does until P4."""
    cols = [c for c in df.columns if c != NULL_COUNT]
    out = df.where(not_null_condition(cols))
    if keep_count:
        out = drop_existing(out, NULL_COUNT).withColumn(NULL_COUNT, F.lit(0))
    return out


def dropna(df: DataFrame) -> DataFrame:
    """Any null drops the row."""
    return df.where(not_null_condition(df.columns))


# P2-P8 drops ----------------------------------------------------------------------
def drop_medication(df: DataFrame) -> DataFrame:
    return df.drop(MEDICATION_COL)


def drop_group_key(df: DataFrame) -> DataFrame:
    return df.drop("group_key")


def drop_null_count(df: DataFrame) -> DataFrame:
    return df.drop(NULL_COUNT)


def drop_visit_keys(df: DataFrame) -> DataFrame:
    return df.drop("visit_id", "visit_month")


def drop_identifiers_and_raw(df: DataFrame) -> DataFrame:
    return df.drop("patient_id", "PeptideAbundance", "NPX", "UniProt", "Peptide")


def drop_raw_measures(df: DataFrame) -> DataFrame:
    return df.drop("PeptideAbundance", "NPX")


def drop_protein_ids(df: DataFrame) -> DataFrame:
    return df.drop("UniProt", "Peptide")
