import pandas as pd
import pytest

from assayline.operators import clean as C
from assayline.operators import outliers as O
from assayline.plans import flows
from assayline.sources.adapter import load_tables

from conftest import SF001


def test_minimum_slice_golden_counts(spark):
    t = load_tables(spark, SF001)
    assert flows.joined_month(t, 24).count() == 879
    assert flows.deduped_non_null(t, 24).count() == 738


def test_adapter_table_counts(spark):
    t = load_tables(spark, SF001)
    assert (t.peptides.count(), t.proteins.count(), t.clinical.count()) == (5844, 4926, 798)


def test_null_drop_turns_left_joins_inner(spark):
    plan = flows.deduped_non_null(load_tables(spark, SF001), 24)._jdf.queryExecution() \
        .optimizedPlan().toString()
    assert "LeftOuter" not in plan


def test_month_filter_reaches_scan(spark):
    df = flows.joined_month(load_tables(spark, SF001), 24)
    phys = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in phys


def test_golden_fences_sf0001(spark):
    base = flows.deduped_non_null(load_tables(spark, SF001), 24)
    f = O.iqr_fences(base, "NPX").first()
    assert f["lower"] == pytest.approx(-55107.37125) and f["upper"] == pytest.approx(194017.25875)
    a = O.iqr_fences(base, "PeptideAbundance").first()
    assert (a["lower"], a["upper"]) == (-25.5, 74.5)


def test_second_iqr_pass_changes_skewed_column(spark):
    """On 0,10,10,10 Q1 is 7.5 and the low fence 3.75: clipping moves Q1."""
    df = spark.createDataFrame([(0.0,), (10.0,), (10.0,), (10.0,)], "x double")
    once = O.clip_iqr(df, ["x"])
    assert sorted(r[0] for r in once.collect()) == [3.75, 10.0, 10.0, 10.0]
    twice = O.clip_iqr(once, ["x"])
    pdf = pd.DataFrame({"x": [0.0, 10, 10, 10]})
    for _ in range(2):
        q1, q3 = pdf.x.quantile(0.25), pdf.x.quantile(0.75)
        pdf["x"] = pdf.x.clip(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    assert sorted(r[0] for r in twice.collect()) == sorted(pdf.x.tolist())


def test_sigma_rule_matches_pandas(spark):
    vals = [1.0] * 20 + [100.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in O.null_outliers_sigma(df, ["x"]).collect()]
    s = pd.Series(vals, dtype=float)
    lo, hi = s.mean() - 3 * s.std(), s.mean() + 3 * s.std()
    exp = [v if v is not None and lo <= v <= hi else None for v in vals]
    assert got == exp


def test_duplicates_and_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, None), (2, "a"), (3, "b")],
                               "k int, v string")
    assert C.drop_duplicates(df).count() == 3
    assert C.dropna(df).count() == 2
    assert [r[0] for r in C.add_null_count(df).select("null_count").collect()] == [1, 1, 1, 0, 0]


def test_clean_leaves_checked_columns_non_null(spark):
    df = flows.clean(load_tables(spark, SF001), 24)
    for c in ("updrs_1", "updrs_2", "updrs_3", "updrs_4", "NPX_log", "PeptideAbundance_log"):
        assert df.where(df[c].isNull()).count() == 0
    assert "null_count" not in df.columns and "visit_id" not in df.columns


def test_fence_chain_equals_sequential_passes(spark):
    import random
    rnd = random.Random(5)
    rows = [(rnd.expovariate(0.01), float(rnd.randint(0, 40))) for _ in range(500)]
    rows += [(0.0, 10.0), (1e6, 10.0), (None, 10.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    chain = O.iqr_fence_chain(df, ["a", "b"], passes=3)
    seq = df
    for k in range(3):
        exp = {r["column"]: (r["lower"], r["upper"])
               for r in O.iqr_fences_by_column(seq, ["a", "b"]).collect()}
        assert chain[k] == exp, k          # bit-identical fences
        seq = O.apply_clip(seq, exp)
    skew = spark.createDataFrame([(0.0,), (10.0,), (10.0,), (10.0,)], "x double")
    two = O.iqr_fence_chain(skew, ["x"], passes=2)
    assert two[0]["x"] == (3.75, 13.75)
    once = O.apply_clip(skew, two[0])
    assert two[1]["x"] == O.iqr_fences_by_column(once, ["x"]).select("lower", "upper").first()[:]


def test_month_pruning_never_changes_results(spark):
    from assayline.tables import AssayTables
    t = load_tables(spark, SF001)
    plain = AssayTables(t.proteins, t.peptides, t.clinical)   # no source pruning
    for month in (0, 36, 72):
        a = flows.joined_month(t, month)
        b = flows.joined_month(plain, month)
        assert a.count() == b.count() and a.exceptAll(b).count() == 0, month
    assert flows.joined_month(t, 3).count() == 0 == flows.joined_month(plain, 3).count()
