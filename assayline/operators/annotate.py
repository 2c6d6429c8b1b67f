"""Protein annotation operators: J7-J9, F7-F12.

Joins to snapshot tables of one row per protein segment; the alignment is an
Arrow-batched pandas UDF over distinct pairs, whose dynamic programme handles
a whole row of letters in one step (bit-parallel).
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayline.operators.sequences import first_positions
from assayline.session import store

# Texts of the reference's annotation helpers.
NAME_NOT_FOUND = "Nombre no encontrado"
GO_NO_DESCRIPTION = "Descripción no disponible"
FOUND = "El péptido '%s' se encuentra en la posición %d de la proteína."
NOT_FOUND = "El péptido no se encontró en la secuencia de la proteína."
NO_SEQUENCE = "No se pudo obtener la secuencia de la proteína."

SEQUENCE_PATH = "$.sequence.value"
NAME_PATH = "$.proteinDescription.recommendedName.fullName.value"


def json_protein_sequence(json_col) -> Column:
    """sequence.value, '' when absent."""
    return F.coalesce(F.get_json_object(json_col, SEQUENCE_PATH), F.lit(""))


def json_protein_name(json_col) -> Column:
    """recommended full name, default text when absent."""
    return F.coalesce(F.get_json_object(json_col, NAME_PATH), F.lit(NAME_NOT_FOUND))


def position_message(has_sequence: Column, position: Column, shown: Column) -> Column:
    """F8: found at / not found / no sequence."""
    return (F.when(~F.coalesce(has_sequence, F.lit(False)), F.lit(NO_SEQUENCE))
             .when(position >= 0, F.format_string(FOUND, shown, position))
             .otherwise(F.lit(NOT_FOUND)))


def read_records(records: DataFrame) -> DataFrame:
    """(uniprot, segment, start, length, residues, protein_name) of JSON
    records (uniprot, json). A record that names no segment holds its whole
    sequence."""
    seq = json_protein_sequence("json")

    def number(field: str, default: Column) -> Column:
        return F.coalesce(F.get_json_object("json", f"$.sequence.{field}").cast("long"),
                          default.cast("long")).alias(field)

    return records.select("uniprot", number("segment", F.lit(0)), number("start", F.lit(0)),
                          number("length", F.length(seq)), seq.alias("residues"),
                          json_protein_name("json").alias("protein_name"))


def join_protein_record(df: DataFrame, records: DataFrame, peptide_seq: Column,
                        uniprot: str = "UniProt", peptide: str = "Peptide") -> DataFrame:
    """Peptide rows + protein_length, protein_name, position (F7: first place
    from 0, -1 if it does not stand in the protein, null without a sequence)
    and message (F8). Sequences are joined segment by segment; a row gets its
    protein's length and name, never its sequence. An empty peptide stands at 0."""
    parsed = store(read_records(records.where(F.col("json").isNotNull())), "records")
    rows = store(df.withColumn("_pseq", peptide_seq), "peptides")
    segments = parsed.where(F.length("residues") > 0).select(
        F.col("uniprot").alias("_u"), "segment", "start", "residues")
    found = first_positions(rows.select(F.col(uniprot).alias("_u"), "_pseq"), segments, "_u",
                            "_pseq").select(F.col("_u").alias("_fu"), F.col("_pseq").alias("_fp"),
                                            F.col("position").alias("_at"))
    # One row per protein.
    own = parsed.groupBy(F.col("uniprot").alias("_u")).agg(
        F.max("length").alias("protein_length"), F.min("protein_name").alias("protein_name"))
    j = (rows.join(own, rows[uniprot] == own["_u"], "left")
             .join(found, (F.col(uniprot) == F.col("_fu")) & (F.col("_pseq") == F.col("_fp")),
                   "left"))
    known = F.col("protein_length") > 0
    at = F.when(F.col("_pseq") == "", F.lit(0).cast("long")).otherwise(F.col("_at"))
    return (j.withColumn("position", F.when(known & F.col("_pseq").isNotNull(),
                                            F.coalesce(at, F.lit(-1).cast("long"))))
             .withColumn("message", position_message(known, F.col("position"), F.col(peptide)))
             .select(*df.columns, "protein_length", "protein_name", "position", "message"))


def join_go_terms(proteins: DataFrame, annotations: DataFrame, names: DataFrame,
                  uniprot: str = "UniProt") -> DataFrame:
    """Protein -> distinct GO ids -> names, default text for a missing name.
    Annotations are de-duplicated per (protein, id) before the joins."""
    ids = annotations.select(F.col("uniprot").alias(uniprot), "go_id").distinct()
    j = proteins.select(uniprot).distinct().join(ids, uniprot, "inner")
    return (j.join(names, "go_id", "left")
             .select(uniprot, "go_id", F.coalesce("name", F.lit(GO_NO_DESCRIPTION)).alias("go_name")))


def go_map(terms: DataFrame, uniprot: str = "UniProt") -> DataFrame:
    """one map GO id -> name per protein (one entry per id, ids sorted).
    Bounded per protein by its distinct GO ids."""
    return terms.groupBy(uniprot).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("go_id", "go_name"))))
        .alias("go_terms"))


def _lcs_bits(a: str, b: str):
    """Rows of the longest-common-subsequence programme of a against b, one bit
    a letter of b (bit-parallel, Hyyro 2004): a cleared bit is a place where the
    row's length grows. Returns the letters' bit masks and a step function."""
    masks: dict = {}
    for j, c in enumerate(b):
        masks[c] = masks.get(c, 0) | 1 << j
    full = (1 << len(b)) - 1

    def step(row: int, c: str) -> int:
        m = row & masks.get(c, 0)
        return ((row + m) | (row - m)) & full

    return full, step


def lcs_length(a: str, b: str) -> int:
    row, step = _lcs_bits(a, b)
    for c in a:
        row = step(row, c)
    return len(b) - row.bit_count()


def align(a: str, b: str) -> tuple[int, str, str]:
    """(score, aligned a, aligned b) with match 1, mismatch 0, gap 0.

    Of the optimal alignments it is the one that, read from the right, matches
    equal letters, else leaves a gap in b if that costs nothing, else in a.
    Every isqrt(len(a))-th row is kept and the rows between two of them are
    computed again on the way back, so memory is len(b) * sqrt(len(a)) bits."""
    first, step = _lcs_bits(a, b)
    every = max(1, math.isqrt(len(a)))
    kept, row = [first], first
    for i, c in enumerate(a, 1):
        row = step(row, c)
        if i % every == 0:
            kept.append(row)
    score = len(b) - row.bit_count()
    i, j, length = len(a), len(b), score
    rows, start = [], len(a) + 1
    out_a, out_b = [], []
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j, length = i - 1, j - 1, length - 1
            out_a.append(a[i])
            out_b.append(b[j])
            continue
        if i - 1 < start:  # the block of rows that holds row i - 1
            start = (i - 1) // every * every
            rows = [kept[start // every]]
            for c in a[start:i - 1]:
                rows.append(step(rows[-1], c))
        above = j - (rows[i - 1 - start] & ((1 << j) - 1)).bit_count()
        if above == length:
            i -= 1
            out_a.append(a[i])
            out_b.append("-")
        else:
            j -= 1
            out_a.append("-")
            out_b.append(b[j])
    out_a += a[:i][::-1] + "-" * j
    out_b += "-" * i + b[:j][::-1]
    return score, "".join(out_a)[::-1], "".join(out_b)[::-1]


@F.pandas_udf(T.LongType())
def alignment_score(a: pd.Series, b: pd.Series) -> pd.Series:
    """optimal pairwise alignment score with match 1, mismatch 0, gap 0
    (the aligner's defaults): the LCS length, in local and global mode alike.
    Null where one is null."""
    return pd.Series([None if x is None or y is None else lcs_length(x, y)
                      for x, y in zip(a, b)], dtype="Int64")


@F.pandas_udf(T.StructType([T.StructField("score", T.LongType()),
                            T.StructField("aligned_a", T.StringType()),
                            T.StructField("aligned_b", T.StringType())]))
def alignment(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """:func:`align` of every pair; nulls where one is null."""
    rows = [(None, None, None) if x is None or y is None else align(x, y) for x, y in zip(a, b)]
    out = pd.DataFrame(rows, columns=["score", "aligned_a", "aligned_b"])
    return out.astype({"score": "Int64"})


def pair_rows(df: DataFrame, by: list[str], order: list[str], peptide: str) -> DataFrame:
    """J9 (re-aimed): each row with the next row of its group (one shuffle, no
    self-join); rows without a next row are left out."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.select("*", F.col(peptide).alias("peptide_a"),
                     F.lead(peptide).over(w).alias("peptide_b")).where("peptide_b is not null")


def pair_alignments(rows: DataFrame) -> DataFrame:
    """Distinct (peptide_a, peptide_b) of :func:`pair_rows` with their score and
    aligned strings."""
    pairs = rows.select("peptide_a", "peptide_b").distinct()
    return pairs.withColumn("_al", alignment("peptide_a", "peptide_b")).select(
        "peptide_a", "peptide_b", "_al.*")


def next_pairs(df: DataFrame, by: list[str], order: list[str], peptide: str) -> DataFrame:
    """:func:`pair_rows` scored by F12. Only distinct pairs are scored."""
    rows = pair_rows(df, by, order, peptide)
    pairs = rows.select("peptide_a", "peptide_b").distinct()
    scores = pairs.withColumn("score", alignment_score("peptide_a", "peptide_b"))
    return rows.join(scores, ["peptide_a", "peptide_b"])
