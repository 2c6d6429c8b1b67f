"""Registered queries: protein annotation (S12, S13, J7-J9, F7-F12) and
long/wide target forms (F14, F15), plus the plain drops (P2, P4-P8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayline.operators import annotate as AN
from assayline.operators import clean as C
from assayline.operators import metrics as M
from assayline.plans import flows
from assayline.plans import oracle as Q
from assayline.plans.catalog import register
from assayline.sources import annotation as SA
from assayline.sources.adapter import _read, load_tables

MONTH = 24


def _lit(text: str) -> str:
    """SQL string literal (quotes doubled)."""
    return "'" + text.replace("'", "''") + "'"


_FOUND_SQL = _lit(AN.FOUND.replace("%s", "{}").replace("%d", "{}"))
_RES = "upper(replace({c}, ' ', ''))"
_REC_SQL = f""",
rec AS (SELECT p_brand AS uniprot, min(p_type) AS name,
          coalesce(string_agg(DISTINCT {_RES.format(c='p_name')}, ''
                              ORDER BY {_RES.format(c='p_name')}), '') AS seq
        FROM part GROUP BY p_brand)"""


@register("protein_record_fields", Q.with_() + _REC_SQL + f""",
sg AS (SELECT *, unnest(range(greatest(1, (len(seq) + {SA.SEGMENT - 1}) // {SA.SEGMENT}))) AS segment
       FROM rec)
SELECT uniprot, segment, segment * {SA.SEGMENT} AS start, len(seq) AS length,
       substr(seq, segment * {SA.SEGMENT} + 1, {SA.SEGMENT}) AS sequence,
       coalesce(name, '{AN.NAME_NOT_FOUND}') AS protein_name FROM sg""")
def protein_record_fields(spark, sf_dir):
    """S12 + F9 + F10: JSON records, one a segment of a protein's sequence, built
    and then read back by path."""
    return AN.read_records(SA.protein_records(spark, sf_dir)).withColumnRenamed(
        "residues", "sequence")


@register("peptide_positions", Q.with_() + _REC_SQL + f""",
pp AS (SELECT DISTINCT UniProt, Peptide FROM peptides),
j AS (SELECT pp.UniProt, pp.Peptide, rec.seq AS sequence,
             CASE WHEN rec.uniprot IS NOT NULL THEN coalesce(rec.name, '{AN.NAME_NOT_FOUND}') END AS protein_name,
             {_RES.format(c='pp.Peptide')} AS pseq
      FROM pp LEFT JOIN rec ON pp.UniProt = rec.uniprot)
SELECT UniProt, Peptide, len(sequence) AS protein_length, protein_name,
       CASE WHEN sequence <> '' THEN instr(sequence, pseq) - 1 END AS position,
       CASE WHEN sequence IS NULL OR sequence = '' THEN '{AN.NO_SEQUENCE}'
            WHEN instr(sequence, pseq) > 0 THEN format({_FOUND_SQL}, Peptide,
                 CAST(instr(sequence, pseq) - 1 AS VARCHAR))
            ELSE '{AN.NOT_FOUND}' END AS message
FROM j""")
def peptide_positions(spark, sf_dir):
    """J7 + F7 + F8: every (UniProt, Peptide) of the peptides table located in
    its protein's whole sequence, segment by segment."""
    pp = load_tables(spark, sf_dir).peptides.select("UniProt", "Peptide").distinct()
    return AN.join_protein_record(pp, SA.protein_records(spark, sf_dir), SA.residues("Peptide"))


_GO_SQL = Q.with_() + f""",
ann AS (SELECT DISTINCT p_brand AS uniprot, 'GO:' || lpad(CAST(p_size AS VARCHAR), 7, '0') AS go_id FROM part),
nm AS (SELECT DISTINCT 'GO:' || lpad(CAST(p_size AS VARCHAR), 7, '0') AS go_id,
              'size term ' || CAST(p_size AS VARCHAR) AS name FROM part),
pr AS (SELECT DISTINCT UniProt FROM proteins)
SELECT pr.UniProt, ann.go_id, coalesce(nm.name, '{AN.GO_NO_DESCRIPTION}') AS go_name
FROM pr JOIN ann ON pr.UniProt = ann.uniprot LEFT JOIN nm ON ann.go_id = nm.go_id"""


@register("go_terms", _GO_SQL)
def go_terms(spark, sf_dir):
    """J8 + S13: distinct GO ids per protein with names (default text)."""
    return AN.join_go_terms(load_tables(spark, sf_dir).proteins,
                            SA.go_annotations(spark, sf_dir), SA.go_names(spark, sf_dir))


@register("annotation_go_map", _GO_SQL.replace("SELECT pr.UniProt,", "SELECT UniProt, "
          "string_agg(go_id || '=' || go_name, '; ' ORDER BY go_id) AS go_terms FROM (\n"
          "SELECT pr.UniProt,") + ") GROUP BY UniProt")
def annotation_go_map(spark, sf_dir):
    """one GO id -> name map per protein, shown as its entries in order."""
    entries = F.transform(F.map_entries("go_terms"),
                          lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return AN.go_map(go_terms(spark, sf_dir)).withColumn("go_terms", F.array_join(entries, "; "))


_LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
# Longest common subsequence in list functions: one step per letter of a; the
# new row is the running maximum of (match: left-above + 1, else above).
_LCS_SQL = """list_reduce(
    list_prepend([0 for x in range(len(b) + 1)], [[ascii(x)] for x in string_split(a, '')]),
    lambda row, ch: list_prepend(0, [list_max(
      [CASE WHEN ascii(b[k]) = ch[1] THEN row[k] + 1 ELSE row[k + 1] END
       for k in range(1, j + 1)]) for j in range(1, len(b) + 1)]))[-1]"""


@register("peptide_pair_scores", f"""
WITH named AS (
  SELECT l_orderkey, l_linenumber, {_RES.format(c='p_name')} AS peptide_a,
         lead({_RES.format(c='p_name')}) OVER (PARTITION BY l_orderkey
              ORDER BY {", ".join(_LINE_ORDER)}) AS peptide_b
  FROM lineitem JOIN part ON l_partkey = p_partkey),
pairs AS (SELECT DISTINCT peptide_a AS a, peptide_b AS b FROM named WHERE peptide_b IS NOT NULL),
scored AS (SELECT a, b, {_LCS_SQL} AS score FROM pairs)
SELECT l_orderkey, l_linenumber, peptide_a, peptide_b, CAST(score AS BIGINT) AS score
FROM named JOIN scored ON a = peptide_a AND b = peptide_b""")
def peptide_pair_scores(spark, sf_dir):
    """J9 + F12: each line of an order with the next one, aligned; every
    distinct pair of peptides is scored once."""
    li = _read(spark, sf_dir, "lineitem").select("l_orderkey", *_LINE_ORDER)
    pt = _read(spark, sf_dir, "part").select("p_partkey", SA.residues("p_name").alias("pep"))
    named = li.join(pt, li.l_partkey == pt.p_partkey)
    return AN.next_pairs(named, ["l_orderkey"], list(_LINE_ORDER), "pep").select(
        "l_orderkey", "l_linenumber", "peptide_a", "peptide_b", "score")


@register("peptide_pair_alignments", f"""
WITH RECURSIVE named AS (
  SELECT l_orderkey, {_RES.format(c='p_name')} AS peptide_a,
         lead({_RES.format(c='p_name')}) OVER (PARTITION BY l_orderkey
              ORDER BY {", ".join(_LINE_ORDER)}) AS peptide_b
  FROM lineitem JOIN part ON l_partkey = p_partkey),
pairs AS MATERIALIZED (SELECT row_number() OVER () AS id, * FROM (
  SELECT DISTINCT peptide_a AS a, peptide_b AS b FROM named WHERE peptide_b IS NOT NULL)),
m AS (
  SELECT id, a, b, 0 AS i, [0 for x in range(len(b) + 1)] AS row FROM pairs
  UNION ALL
  SELECT id, a, b, i + 1, list_prepend(0, [list_max(
    [CASE WHEN b[k] = a[i + 1] THEN row[k] + 1 ELSE row[k + 1] END FOR k IN range(1, j + 1)])
    FOR j IN range(1, len(b) + 1)])
  FROM m WHERE i < len(a)),
w AS MATERIALIZED (SELECT * FROM m),
t AS (
  SELECT id, a, b, len(a) AS i, len(b) AS j, '' AS x, '' AS y FROM pairs
  UNION ALL
  SELECT t.id, t.a, t.b,
    CASE WHEN t.i = 0 THEN 0 WHEN t.j = 0 OR a1 OR a2 THEN t.i - 1 ELSE t.i END,
    CASE WHEN t.j = 0 THEN 0 WHEN t.i = 0 OR a1 OR NOT a2 THEN t.j - 1 ELSE t.j END,
    CASE WHEN t.i > 0 AND (t.j = 0 OR a1 OR a2) THEN t.a[t.i] ELSE '-' END || t.x,
    CASE WHEN t.j > 0 AND (t.i = 0 OR a1 OR NOT a2) THEN t.b[t.j] ELSE '-' END || t.y
  FROM (SELECT t.*, t.i > 0 AND t.j > 0 AND t.a[t.i] = t.b[t.j] AS a1,
               coalesce(up.row[t.j + 1] = own.row[t.j + 1], false) AS a2
        FROM t JOIN w own ON own.id = t.id AND own.i = t.i
        LEFT JOIN w up ON up.id = t.id AND up.i = t.i - 1
        WHERE t.i > 0 OR t.j > 0) t)
SELECT t.a AS peptide_a, t.b AS peptide_b, CAST(w.row[-1] AS BIGINT) AS score,
       t.x AS aligned_a, t.y AS aligned_b
FROM t JOIN w ON w.id = t.id AND w.i = len(t.a) WHERE t.i = 0 AND t.j = 0""")
def peptide_pair_alignments(spark, sf_dir):
    """J9 + F12: every distinct pair of peptides of neighbouring lines, aligned."""
    li = _read(spark, sf_dir, "lineitem").select("l_orderkey", *_LINE_ORDER)
    pt = _read(spark, sf_dir, "part").select("p_partkey", SA.residues("p_name").alias("pep"))
    named = li.join(pt, li.l_partkey == pt.p_partkey)
    return AN.pair_alignments(AN.pair_rows(named, ["l_orderkey"], list(_LINE_ORDER), "pep"))


# F14 / F15 -------------------------------------------------------------------------------
_LONG_SQL = Q.with_() + """,
m AS (SELECT * FROM clinical WHERE visit_month = 24),
lf AS (""" + " UNION ALL ".join(
    f"SELECT visit_id, visit_month, patient_id, '{t}' AS updrs_test, visit_id || '_' || '{t}' "
    f"AS row_id, {t} AS rating FROM m" for t in Q.TARGETS) + ")"


def _long_form(spark, sf_dir):
    cl = C.filter_month(load_tables(spark, sf_dir).clinical, MONTH)
    lf = M.long_labels(cl, keep=["visit_id", "visit_month", "patient_id"])
    return lf.select("visit_id", "visit_month", "patient_id", F.col("target").alias("updrs_test"),
                     F.concat_ws("_", "visit_id", "target").alias("row_id"),
                     F.col("y").alias("rating"))


@register("long_form_targets", _LONG_SQL + "\nSELECT * FROM lf")
def long_form_targets(spark, sf_dir):
    """F15 (unpivot) + F14 (row_id = visit_id_target), the test file's form."""
    return _long_form(spark, sf_dir)


@register("pivot_targets", _LONG_SQL + "\nSELECT visit_id, " + ", ".join(
    f"max(CASE WHEN updrs_test = '{t}' THEN rating END) AS {t}" for t in Q.TARGETS)
          + " FROM lf GROUP BY visit_id")
def pivot_targets(spark, sf_dir):
    """F15 (pivot): long form back to one row per visit."""
    return (_long_form(spark, sf_dir).groupBy("visit_id").pivot("updrs_test", list(Q.TARGETS))
            .agg(F.max("rating")))


# Plain drops on the null-dropped month -------------------------------------------------
_NN = Q.with_(Q.nonnull(MONTH))


def _nn(spark, sf_dir):
    return flows.deduped_non_null(load_tables(spark, sf_dir), MONTH)


@register("drop_medication_and_helper", _NN + f"\nSELECT * EXCLUDE ({Q.MED}, null_count) FROM nonnull",
          rounded=("NPX", "PeptideAbundance"))
def drop_medication_and_helper(spark, sf_dir):
    """P2 + P4."""
    return C.drop_medication(C.drop_null_count(_nn(spark, sf_dir)))


@register("drop_visit_keys", _NN + "\nSELECT * EXCLUDE (visit_id, visit_month) FROM nonnull",
          rounded=("NPX", "PeptideAbundance"))
def drop_visit_keys(spark, sf_dir):
    """P5."""
    return C.drop_visit_keys(_nn(spark, sf_dir))


@register("drop_identifiers_and_raw",
          _NN + "\nSELECT * EXCLUDE (patient_id, PeptideAbundance, NPX, UniProt, Peptide) FROM nonnull")
def drop_identifiers_and_raw(spark, sf_dir):
    """P6."""
    return C.drop_identifiers_and_raw(_nn(spark, sf_dir))


@register("drop_raw_measures", _NN + "\nSELECT * EXCLUDE (PeptideAbundance, NPX) FROM nonnull")
def drop_raw_measures(spark, sf_dir):
    """P7."""
    return C.drop_raw_measures(_nn(spark, sf_dir))


@register("drop_protein_ids", _NN + "\nSELECT * EXCLUDE (UniProt, Peptide) FROM nonnull",
          rounded=("NPX", "PeptideAbundance"))
def drop_protein_ids(spark, sf_dir):
    """P8 (keeps patient_id, as the reference does)."""
    return C.drop_protein_ids(_nn(spark, sf_dir))
