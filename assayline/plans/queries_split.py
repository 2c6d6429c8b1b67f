"""Registered queries: sampling, splitting, scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayline.operators import scale as SC
from assayline.operators import split as SP
from assayline.plans import flows
from assayline.plans import oracle as Q
from assayline.plans.catalog import register
from assayline.sources.adapter import load_tables

MONTH = 24
_CLEAN = Q.with_(Q.clean(MONTH))
_KEYS = ["visit_id", "UniProt", "Peptide"]


def _clean(spark, sf_dir):
    return flows.clean(load_tables(spark, sf_dir), MONTH, keep_visit_keys=True)


def _split_query(name, scheme, by_patient=False):
    test, val = SP.SCHEMES[scheme]
    keys = ("patient_id",) if by_patient else ("visit_id", "UniProt", "Peptide")
    sql = _CLEAN + f"\nSELECT visit_id, UniProt, Peptide, patient_id, {Q.split_case(test, val, 42, keys, by_patient)} AS split FROM cleaned"

    @register(name, sql)
    def _q(spark, sf_dir):
        df = _clean(spark, sf_dir).select(*_KEYS, "patient_id")
        return SP.assign_split(df, scheme, by_patient=by_patient)
    _q.__doc__ = f"M4-M6: split {scheme}{' by patient' if by_patient else ''}."
    return _q


split_60_20_20 = _split_query("split_60_20_20", "60_20_20")
split_80_20 = _split_query("split_80_20", "80_20")
split_64_16_20 = _split_query("split_64_16_20", "64_16_20")
split_by_patient = _split_query("split_80_20_by_patient", "80_20", by_patient=True)


@register("kfold5", _CLEAN + f"""
SELECT visit_id, UniProt, Peptide, CAST({Q.bucket(42, 'visit_id', 'UniProt', 'Peptide')} % 5 AS INTEGER) AS fold
FROM cleaned""")
def kfold5(spark, sf_dir):
    """M7."""
    return SP.assign_folds(_clean(spark, sf_dir).select(*_KEYS))


@register("train_size_subsets", _CLEAN + f""",
tr AS (SELECT row_number() OVER (ORDER BY {Q.row_hash(43, 'visit_id', 'UniProt', 'Peptide')}) AS r,
              count(*) OVER () AS n
       FROM (SELECT *, {Q.split_case()} AS split FROM cleaned) WHERE split = 'train'),
sizes AS (SELECT * FROM (VALUES {", ".join(f"({i}, {f}::DOUBLE)" for i, f in enumerate(SP.TRAIN_SIZES))})
          AS v(size_index, fraction))
SELECT size_index, fraction, count(tr.r) AS n_rows
FROM sizes LEFT JOIN tr ON tr.r <= floor(fraction * tr.n) GROUP BY size_index, fraction""")
def train_size_subsets(spark, sf_dir):
    """Rows of each nested train subset (80/20 train part)."""
    tr = SP.assign_split(_clean(spark, sf_dir).select(*_KEYS), "80_20").where(
        F.col("split") == "train")
    return SP.train_size_counts(tr, SP.TRAIN_SIZES)


@register("union_train_val", _CLEAN + f"""
SELECT visit_id, UniProt, Peptide, split FROM (
  SELECT *, {Q.split_case(0.2, 0.25)} AS split FROM cleaned) AS s WHERE split IN ('train', 'val')""")
def union_train_val(spark, sf_dir):
    """U4 on the 60/20/20 split."""
    df = SP.assign_split(_clean(spark, sf_dir).select(*_KEYS), "60_20_20")
    return SP.union_train_val(df)


@register("union_keys", Q.with_() + """
SELECT patient_id FROM proteins UNION SELECT patient_id FROM peptides
UNION SELECT patient_id FROM clinical""")
def union_keys(spark, sf_dir):
    """U2."""
    t = load_tables(spark, sf_dir)
    return SP.union_keys([t.proteins, t.peptides, t.clinical], "patient_id")


def _sample_sql(key, n, table):
    return Q.with_() + f""",
k AS (SELECT {key} FROM proteins UNION SELECT {key} FROM peptides UNION SELECT {key} FROM clinical),
s AS (SELECT {key} FROM k ORDER BY md5(concat_ws('|', '42', CAST({key} AS VARCHAR))), {key} LIMIT {n})
SELECT * FROM {table} WHERE {key} IN (SELECT {key} FROM s)"""


@register("sample_patients", _sample_sql("patient_id", 50, "peptides"),
          rounded=("PeptideAbundance",))
def sample_patients(spark, sf_dir):
    """M1 + J6 + P23: peptides of 50 sampled patients."""
    return SP.sample_tables(load_tables(spark, sf_dir), "patient_id", 50).peptides


@register("sample_visits", _sample_sql("visit_id", 200, "proteins"), rounded=("NPX",))
def sample_visits(spark, sf_dir):
    """M2: proteins of 200 sampled visits."""
    return SP.sample_tables(load_tables(spark, sf_dir), "visit_id", 200).proteins


@register("sample_rows", _CLEAN + """
SELECT * FROM cleaned ORDER BY md5(concat_ws('|', '42', visit_id, UniProt, Peptide)),
  visit_id, UniProt, Peptide LIMIT 100""",
          rounded=("NPX", "PeptideAbundance", "NPX_log", "PeptideAbundance_log"))
def sample_rows(spark, sf_dir):
    """M3: 100 rows by hash order."""
    return SP.sample_rows(_clean(spark, sf_dir), 100)


_PREP = Q.with_(Q.prepared(MONTH))
_SCALED = tuple(Q.FEATURE_DOUBLES)


@register("prepare_month_24", _PREP + "\nSELECT * FROM prep", rounded=_SCALED)
def prepare_month_24(spark, sf_dir):
    """Features, 80/20 split, min-max scaling fitted on train rows."""
    return flows.prepare(load_tables(spark, sf_dir), MONTH)


@register("project_target_updrs_1", _PREP + "\nSELECT * EXCLUDE (updrs_2, updrs_3, updrs_4) FROM prep",
          rounded=_SCALED)
def project_target_updrs_1(spark, sf_dir):
    """The updrs_1 table (41 features + label)."""
    return SP.project_target(flows.prepare(load_tables(spark, sf_dir), MONTH), "updrs_1")


def _fit_sql(kind):
    feats = Q.FEATURE_DOUBLES
    if kind == "minmax":
        sel = lambda c: f"SELECT '{c}' AS feature, min({c}) AS min, max({c}) AS max FROM sp WHERE split = 'train'"
    else:
        sel = lambda c: f"SELECT '{c}' AS feature, avg({c}) AS mean, stddev_pop({c}) AS std FROM sp WHERE split = 'train'"
    return (Q.with_(Q.features(MONTH, keep_keys=True))
            + f",\nsp AS (SELECT *, {Q.split_case()} AS split FROM feat)\n"
            + "\nUNION ALL\n".join(sel(c) for c in feats))


def _features_with_split(spark, sf_dir):
    df = flows.clean(load_tables(spark, sf_dir), MONTH, keep_visit_keys=True)
    from assayline.operators.features import build_features
    feat = build_features(df, drop_ids=False)
    return SP.assign_split(feat, "80_20")


@register("minmax_fit", _fit_sql("minmax"), rounded=("min", "max"))
def minmax_fit(spark, sf_dir):
    """Min and max of each feature on train rows."""
    return SC.minmax_fit(_features_with_split(spark, sf_dir), Q.FEATURE_DOUBLES)


@register("standard_fit", _fit_sql("standard"), rounded=("mean", "std"))
def standard_fit(spark, sf_dir):
    """Mean and population std of each feature on train rows."""
    return SC.standard_fit(_features_with_split(spark, sf_dir), Q.FEATURE_DOUBLES)


_STD_SCALED = [c for c in Q.FEATURE_DOUBLES if c not in SP.statistic_columns(Q.FEATURE_DOUBLES)]
_STD_PASS = SP.statistic_columns(Q.FEATURE_DOUBLES)


def _standard_sql():
    st = ", ".join(f"avg({c}) AS {c}__m, stddev_pop({c}) AS {c}__s" for c in _STD_SCALED)
    sc = ", ".join(f"(sp.{c} - st.{c}__m) / (CASE WHEN st.{c}__s = 0 THEN 1.0 ELSE st.{c}__s END) "
                   f"AS {c}" for c in _STD_SCALED)
    return (Q.with_(Q.features(MONTH, keep_keys=True))
            + f",\nsp AS (SELECT *, {Q.split_case()} AS split FROM feat),\n"
            + f"st AS (SELECT {st} FROM sp WHERE split = 'train')\n"
            + f"SELECT {sc}, " + ", ".join(f"sp.{c}" for c in _STD_PASS)
            + ", sp.visit_id, sp.visit_month, sp.UniProt, sp.Peptide, sp.split, "
              "sp.updrs_1, sp.updrs_2, sp.updrs_3, sp.updrs_4 FROM sp CROSS JOIN st")


@register("standard_scale_month_24", _standard_sql(), rounded=tuple(Q.FEATURE_DOUBLES))
def standard_scale_month_24(spark, sf_dir):
    """M9: measure columns standardised on train rows (population std),
    statistic columns passed through; scaled columns first."""
    return flows.prepare(load_tables(spark, sf_dir), MONTH, scale="standard")
