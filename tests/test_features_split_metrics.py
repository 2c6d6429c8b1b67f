import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayline.operators import features as FE
from assayline.operators import metrics as M
from assayline.operators import scale as SC
from assayline.operators import split as SP
from assayline.plans import flows
from assayline.sources.adapter import load_tables

from conftest import SF001


@pytest.fixture(scope="module")
def feat(spark):
    return flows.features(load_tables(spark, SF001), 24).cache()


def test_feature_table_shape(feat):
    assert len(feat.columns) == 45
    assert feat.count() == 738


def test_percentile_in_unit_interval(feat):
    r = feat.agg(F.min("NPX_log_percentile_in_all"), F.max("NPX_log_percentile_in_all"),
                 F.min("PeptideAbundance_log_percentile_in_local")).first()
    # the clip ties the top values, so the largest average rank can be < 1
    assert 0 < r[0] <= 1 and 0 < r[1] <= 1.0 and 0 < r[2] <= 1


def test_target_stats_are_constants(feat):
    assert feat.select("updrs_1_mean", "updrs_3_median").distinct().count() == 1


def test_row_target_stats_match_pandas(spark):
    rows = [(1.0, 2.0, None, 10.0), (None, None, None, None), (3.0, 3.0, 3.0, 3.0)]
    df = spark.createDataFrame(rows, "updrs_1 double, updrs_2 double, updrs_3 double, updrs_4 double")
    got = FE.row_target_stats(df).toPandas()
    pdf = pd.DataFrame(rows, columns=["updrs_1", "updrs_2", "updrs_3", "updrs_4"], dtype=float)
    cols = ["updrs_1", "updrs_2", "updrs_3", "updrs_4"]
    for s in ("mean", "median", "min", "max", "std", "var"):
        exp = pdf[cols].agg(s, axis=1)
        assert np.allclose(got[f"updrs_total_{s}"].astype(float), exp, equal_nan=True), s


def test_splits_disjoint_cover(spark):
    df = flows.clean(load_tables(spark, SF001), 24, keep_visit_keys=True)
    sp = SP.assign_split(df, "60_20_20")
    counts = {r["split"]: r["count"] for r in sp.groupBy("split").count().collect()}
    assert sum(counts.values()) == df.count()
    assert set(counts) == {"train", "val", "test"}
    assert 0.1 < counts["test"] / df.count() < 0.3


def test_patient_split_keeps_patients_whole(spark):
    df = flows.clean(load_tables(spark, SF001), 24, keep_visit_keys=True)
    sp = SP.assign_split(df, "80_20", by_patient=True)
    assert sp.groupBy("patient_id").agg(F.countDistinct("split").alias("n")) \
             .where("n > 1").count() == 0


def test_minmax_zero_range_and_train_range(spark):
    df = spark.createDataFrame([(1.0, 5.0, "train"), (3.0, 5.0, "train"), (9.0, 7.0, "test")],
                               "a double, b double, split string")
    out = {r["split"] + str(r["a"]): r for r in SC.minmax_scale(df, ["a", "b"]).collect()}
    assert out["train0.0"]["b"] == 0.0 and out["train1.0"]["a"] == 1.0
    assert out["test4.0"]["a"] == 4.0 and out["test4.0"]["b"] == 2.0   # no clipping


def test_selectors():
    cols = ["updrs_1", "NPX_log", "NPX_log_mean_in_all", "updrs_2_std", "Peptide_per_Protein"]
    assert SP.target_columns(cols) == ["updrs_1", "updrs_2_std"]
    assert SP.statistic_columns(cols) == ["NPX_log_mean_in_all", "updrs_2_std"]
    assert SP.name_token("NPX_log_mean_in_all") == "mean"


def test_smape_zero_rule(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 2.0), (4.0, 2.0)], "y double, p double")
    got = df.agg(M.smape_expr().alias("s"), M.rmse_expr().alias("r"),
                 M.mae_expr().alias("m"), M.mse_expr().alias("q")).first()
    y, p = np.array([0, 0, 4.0]), np.array([0, 2, 2.0])
    term = np.zeros(3)
    pos = (y != 0) | (p != 0)
    term[pos] = np.abs(y - p)[pos] / ((np.abs(y) + np.abs(p))[pos] / 2)
    assert got["s"] == pytest.approx(100 * term.mean())
    assert got["r"] == pytest.approx(np.sqrt(((y - p) ** 2).mean()))
    assert got["m"] == pytest.approx(np.abs(y - p).mean())
    assert got["q"] == pytest.approx(((y - p) ** 2).mean())
    assert 0 <= got["s"] <= 200


def test_error_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(float(x),) for x in range(26)], "error double")
    bins = {r["bin"]: r["n"] for r in M.error_histogram(df).collect()}
    assert sum(bins.values()) == 26 and max(bins) == 24
    counts, _ = np.histogram(np.arange(26.0), bins=25)
    assert [bins.get(i, 0) for i in range(25)] == counts.tolist()


def test_scaled_train_columns_in_unit_interval(spark):
    prep = flows.prepare(load_tables(spark, SF001), 24)
    feats = flows.model_features(prep.columns)
    tr = prep.where("split = 'train'")
    row = tr.agg(*[F.min(c).alias(f"lo_{i}") for i, c in enumerate(feats)],
                 *[F.max(c).alias(f"hi_{i}") for i, c in enumerate(feats)]).first()
    for i, c in enumerate(feats):
        lo, hi = row[f"lo_{i}"], row[f"hi_{i}"]
        assert lo is None or (lo >= 0.0 and hi <= 1.0 + 1e-12), c
    # four target tables share one shape (P16 is a projection)
    assert len({len(SP.project_target(prep, t).columns) for t in
                ("updrs_1", "updrs_2", "updrs_3", "updrs_4")}) == 1


def test_sigma_rule_data_loss_limits(spark):
    """The reference's limits: at most 10 % rows removed, 20 % new nulls."""
    from assayline.operators import outliers as O
    from assayline.operators import reports as RP
    before = flows.deduped_non_null(load_tables(spark, SF001), 24)
    r = RP.stage_change_report(before, O.null_outliers_sigma(before)).first()
    assert r["proportion_removed"] <= 0.1
    assert r["proportion_additional_nulls"] <= 0.2
    assert r["additional_nulls"] > 0


def test_keyword_options(spark):
    """to_log off, plain ranks, a statistic subset, percentile stats."""
    df = flows.clean(load_tables(spark, SF001), 24)
    out = FE.build_features(df, to_log=False, percentile_option=False,
                            stats=["mean", "max"], target_stats=["median", "percentile"])
    cols = set(out.columns)
    assert {"NPX_percentile_in_all", "NPX_mean_in_all", "NPX_max_in_all",
            "PeptideAbundance_percentile_in_local", "PeptideAbundance_mean_in_UniProt",
            "updrs_1_median", "updrs_4_percentile_p90"} <= cols
    assert "NPX_log_mean_in_all" not in cols and "NPX_std_in_all" not in cols
    # pct off gives plain average ranks (>= 1)
    assert out.agg(F.min("NPX_percentile_in_all")).first()[0] >= 1.0
    from assayline.operators import outliers as O
    wide = O.clip_iqr(df, ["NPX"], factor=0.5).agg(F.max("NPX")).first()[0]
    narrow = O.clip_iqr(df, ["NPX"], factor=3.0).agg(F.max("NPX")).first()[0]
    assert wide <= narrow


def test_learning_curve_decomposition_matches_brute_force(spark):
    """The one-aggregate learning curve equals explicit per-fit computation."""
    rng = np.random.default_rng(1)
    n = 600
    pdf = pd.DataFrame({"target": rng.choice(["t1", "t2"], n), "UniProt": rng.choice(list("abcd"), n),
                        "y": rng.integers(0, 20, n).astype(float),
                        "fold": rng.integers(0, 5, n), "sub": rng.integers(0, 10000, n)})
    sizes = (0.1, 0.325, 0.55, 0.775, 1.0)
    got = M.learning_curve_group_mean(spark.createDataFrame(pdf), ["UniProt"], sizes=sizes).toPandas()
    exp = []
    for i, f in enumerate(sizes):
        for t in ("t1", "t2"):
            for kind in ("train", "val"):
                scores = []
                for k in range(5):
                    d = pdf[pdf.target == t]
                    tr = d[(d.fold != k) & (d["sub"] < round(f * 10000))]
                    part = tr if kind == "train" else d[d.fold == k]
                    p = part.UniProt.map(tr.groupby("UniProt").y.mean())
                    sse = ((part.y - p) ** 2).sum()          # rows without a prediction skipped
                    sst = len(part) * part.y.var(ddof=0)
                    scores.append(1 - sse / sst if sst else np.nan)
                s = pd.Series(scores).dropna()
                exp.append((i, t, kind, s.mean(), s.std(ddof=0)))
    e = pd.DataFrame(exp, columns=["size_index", "target", "kind", "m", "s"])
    j = got.merge(e, on=["size_index", "target", "kind"])
    assert len(j) == len(e) == 20
    assert np.allclose(j.score_mean, j.m) and np.allclose(j.score_std, j.s)


def test_split_sizes_are_exact(spark, monkeypatch):
    """Sizes to a row, at any number of digits a pass; keys that
    come twice stay together."""
    for digits, n in ((4, 1003), (1, 1003), (2, 57), (4, 1), (4, 0)):
        monkeypatch.setattr(SP, "_DIGITS", digits)
        df = spark.range(n).selectExpr("cast(id as string) visit_id", "'u' UniProt", "'p' Peptide",
                                       "id patient_id")
        for scheme in SP.SCHEMES:
            counts = {r["split"]: r["count"] for r in
                      SP.assign_split(df, scheme).groupBy("split").count().collect()}
            test, val = SP.split_sizes(n, scheme)
            assert (counts.get("test", 0), counts.get("val", 0)) == (test, val)
            assert counts.get("train", 0) == n - test - val
        got = [r["n_rows"] for r in
               SP.train_size_counts(df, SP.TRAIN_SIZES).orderBy("size_index").collect()]
        assert got == [int(f * n) for f in SP.TRAIN_SIZES]
        small, large = (SP.train_size_subset(df, f) for f in (0.1, 0.55))
        assert small.count() == int(0.1 * n) and small.join(large, "visit_id").count() == small.count()
    assert SP.split_sizes(1003, "60_20_20") == (201, 201)
    twice = spark.range(100).selectExpr("cast(id % 50 as string) visit_id", "'u' UniProt",
                                        "'p' Peptide")
    sp = SP.assign_split(twice, "80_20")
    assert sp.where("split = 'test'").count() == 20
    assert sp.groupBy("visit_id").agg(F.countDistinct("split").alias("k")).where("k > 1").count() == 0
