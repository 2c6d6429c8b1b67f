"""Every registered query against its DuckDB twin at sf0.001 (fast subset of
tools/compare.py, which runs all of them at sf0.01)."""

import math

import pytest

import __spark_entry__ as E
from assayline.plans import catalog

from conftest import SF001

FAST = ["clean_month_24", "iqr_fences_abundance", "clean_full_month_24", "features_month_24",
        "protein_percentile_rank", "target_percentiles", "duplicate_report", "downcast_plan",
        "peptide_pair_scores", "annotation_go_map", "trial_round_trip", "params_round_trip",
        "metrics_csv_round_trip", "encode_category", "train_size_subsets",
        "split_64_16_20", "prepare_month_24", "metric_summary", "learning_curve_fixed"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def test_every_query_has_a_check():
    qs, sql = catalog.queries(), catalog.oracle_sql()
    rows_only = set(qs) - set(sql)
    # Trees only: their invariants have SQL twins of their own.
    assert all(n.startswith(("fit_", "gbt_", "evaluate_", "feature_importance", "month_report",
                             "month_table", "tune_")) for n in rows_only), rows_only
    assert len(qs) >= 100 and len(sql) >= 95


@pytest.mark.parametrize("name", FAST)
def test_query_matches_duckdb(spark, duck, name):
    sdf = E.queries()[name](spark, SF001)
    cols = sorted(sdf.columns)
    srows = sorted((tuple(_norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
    rel = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in rel.description]
    assert sorted(dcols) == cols
    idx = [dcols.index(c) for c in cols]
    drows = sorted((tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()), key=repr)
    assert srows == drows


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 738


def test_all_oracles_run_in_duckdb(duck):
    bad = {}
    for name, sql in E.oracle_sql().items():
        try:
            duck.execute(sql).fetchall()
        except Exception as e:  # noqa: BLE001
            bad[name] = str(e)[:120]
    assert not bad, bad
