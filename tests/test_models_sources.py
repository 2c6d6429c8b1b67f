import json
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayline.operators import models as MD
from assayline.operators import split as SP
from assayline.operators import trees as TR
from assayline.operators import tuning as TU
from assayline.sources import files as FS
from assayline.tables import AssayTables


def _learnable(spark, n=400):
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 1, size=(n, 3))
    y = 10 * x[:, 0] + (x[:, 1] > 0.5) * 5
    rows = [(f"v{i}", "u", "p", float(a), float(b), float(c), float(t), float(t), float(t),
             float(t)) for i, ((a, b, c), t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "visit_id string, UniProt string, Peptide string, "
                               "a double, b double, c double, updrs_1 double, updrs_2 double, "
                               "updrs_3 double, updrs_4 double")
    return SP.assign_split(df, "60_20_20")


def test_forest_beats_mean_and_repeats(spark):
    vec = MD.vectorize(_learnable(spark), ["a", "b", "c"])
    train = vec.where("split = 'train'")
    m1, rep = MD.fit(train, "random_forest", "updrs_1", {"n_estimators": 20, "max_depth": 5})
    m2, _ = MD.fit(train, "random_forest", "updrs_1", {"n_estimators": 20, "max_depth": 5})
    test = vec.where("split = 'test'")
    p1 = [r["p"] for r in MD.predict(m1, test).orderBy("visit_id").collect()]
    p2 = [r["p"] for r in MD.predict(m2, test).orderBy("visit_id").collect()]
    assert p1 == p2
    pred = MD.predict(m1, test)
    mse = pred.agg(F.avg(F.pow(F.col("updrs_1") - F.col("p"), 2))).first()[0]
    var = test.agg(F.var_pop("updrs_1")).first()[0]
    assert mse < var and rep.ignored == []


def test_param_map():
    tp, ignored, clamped = MD.tree_params("lightgbm", {"max_depth": 0, "num_leaves": 200,
                                                       "reg_alpha": 1.5, "subsample": 0.6})
    assert (tp.max_depth, tp.max_leaves, tp.l1, tp.row_rate) == (TR.DEEPEST, 200, 1.5, 0.6)
    assert ignored == clamped == [] and tp.min_leaf == 20 and tp.boosted
    tp, ignored, _ = MD.tree_params("random_forest", MD.default_params("random_forest"))
    assert (tp.trees, tp.max_depth, tp.max_leaves, tp.min_split, tp.min_leaf) == \
        (156, 28, 985, 20, 20)
    assert tp.drawn(41) == 5 and not tp.boosted and ignored == []
    _, ignored, clamped = MD.tree_params("xgboost", {"max_depth": 90, "unheard_of": 1})
    assert ignored == ["unheard_of"] and clamped
    for family, space in TU.SEARCH_SPACES.items():
        if family != "group_mean":
            assert MD.tree_params(family, {name: hi for name, _, _, hi in space})[1] == []


def test_empty_month_guard(spark):
    vec = MD.vectorize(_learnable(spark, 50), ["a", "b", "c"])
    model, _ = MD.fit(vec.where("split = 'none'"), "random_forest", "updrs_1")
    assert model is None


def test_trials_reproducible_and_in_range(spark):
    a = TU.sample_trials(spark, "xgboost", 20).collect()
    b = TU.sample_trials(spark, "xgboost", 20).collect()
    assert a == b
    for r in a:
        assert 10 <= r["params"]["n_estimators"] <= 100
        assert 0.01 <= r["params"]["learning_rate"] <= 0.3
    for r in TU.sample_trials(spark, "random_forest", 50).collect():
        assert 2 <= r["params"]["max_depth"] <= 32


def test_early_stop_point():
    assert TU.early_stop_point([5, 4, 4, 4, 4, 4, 4]) == 6
    assert TU.early_stop_point([5, 4, 3, 2, 1]) is None


def test_csv_nan_to_null_and_validation(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    with open(f"{d}/p.csv", "w") as f:
        f.write("visit_id,visit_month,patient_id,UniProt,NPX\n1_0,0,1,P1,NaN\n1_0,0,1,P2,3.5\n")
    df = FS.read_csv(spark, f"{d}/p.csv", "proteins")
    assert [r["NPX"] for r in df.orderBy("UniProt").collect()] == [None, 3.5]
    t = AssayTables(df, df, df)
    assert FS.validate_inputs(t, 24) and any("peptides lacks" in p for p in FS.validate_inputs(t, 24))
    assert any("month" in p for p in FS.validate_inputs(t, 25))


def test_params_json_scan_and_sinks(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    with open(f"{d}/random_forest_params_model_2.json", "w") as f:
        json.dump({"max_depth": 12, "min_samples_leaf": 2}, f)
    got = FS.read_params_json(spark, d).first()
    assert (got["family"], got["target"], got["params"]["max_depth"]) == \
        ("random_forest", "updrs_2", 12.0)
    out = tempfile.mkdtemp(dir="/tmp")
    trials = TU.trial_table(spark, "random_forest", "updrs_1",
                            [(0, {"max_depth": 3}, 50.0), (1, {"max_depth": 5}, 40.0)])
    for run in ("a", "b", "a"):  # a rerun replaces its own trials only
        FS.append_trials(trials, f"{out}/trials", run)
    back = FS.read_trials(spark, f"{out}/trials")
    assert back.count() == 4 and {r["run"] for r in back.collect()} == {"a", "b"}
    best = TU.best_trial(back).first()
    assert best["trial"] == 1 and best["value"] == 40.0
    m = spark.createDataFrame([("rf", 1.0, 2.0, 4.0, "test")],
                              "Modelo string, SMAPE double, RMSE double, MAE double, Dataset string")
    FS.write_metrics_csv(m, f"{out}/metrics/a")
    assert FS.read_metrics_csv(spark, f"{out}/metrics/a").count() == 1
    assert os.path.isdir(f"{out}/trials")


def test_learning_curve_shape(spark):
    vec = MD.vectorize(_learnable(spark, 300), ["a", "b", "c"])
    lc = MD.learning_curve(vec, "random_forest", "updrs_1", {"n_estimators": 5, "max_depth": 3},
                           sizes=(0.5, 1.0), k=3).collect()
    assert len(lc) == 4   # 2 sizes x (train, val)
    full = [r for r in lc if r["fraction"] == 1.0 and r["kind"] == "val"][0]
    assert full["score_mean"] > 0.5 and full["score_std"] >= 0


def test_drop_constant_features(spark):
    from assayline.plans import flows
    from assayline.sources.adapter import load_tables
    tables = load_tables(spark, "/root/testdata/sf0.001")
    vec, feats = flows.prepared_vectors(tables, 24)
    assert 0 < len(feats) < 41
    assert "updrs_1_mean" not in feats and "NPX_log" in feats
    # Constants do not starve the trees: nodes draw on past them.
    wide, every = flows.prepared_vectors(tables, 24, drop_constant=False)
    params = {"n_estimators": 10, "max_depth": 10, "min_samples_leaf": 2, "max_features": "log2"}
    few, many = (MD.fit(v.where("split = 'train'"), "random_forest", "updrs_1", params)[0]
                 for v in (wide, vec))
    assert many.total_nodes < 1.2 * few.total_nodes and few.total_nodes > 100
    imp = MD.feature_importance(spark, many, feats, every).collect()
    assert len(imp) == len(every) == 41 and sum(r["importance"] for r in imp) == pytest.approx(1)
    assert {r["importance"] for r in imp if r["feature"] not in feats} == {0.0}


def test_two_families_of_parameters_survive(spark):
    out = tempfile.mkdtemp(dir="/tmp")
    schema = "params map<string,double>, family string, target string"
    for family, value in (("random_forest", 1.0), ("xgboost", 2.0), ("random_forest", 3.0)):
        FS.write_params(spark.createDataFrame([({"max_depth": value}, family, "updrs_1")], schema),
                        out)
    got = {r["family"]: r["params"]["max_depth"] for r in FS.read_params(spark, out).collect()}
    assert got == {"random_forest": 3.0, "xgboost": 2.0}
    from assayline.plans import flows
    assert flows.saved_params(spark, out, "xgboost") == {"updrs_1": {"max_depth": 2.0}}
    assert flows.saved_params(spark, out + "/none", "xgboost") == {}
    assert flows.saved_params(spark, None, "xgboost") == {}


def test_search_without_validation_rows(spark):
    """An empty validation split ends the search and falls back to defaults."""
    from assayline.plans import flows
    vec = MD.vectorize(_learnable(spark, 80), ["a", "b", "c"]).where("split <> 'val'")
    hist = TU.run_trials(vec, "random_forest", "updrs_1",
                         TU.sample_trials(spark, "random_forest", 3))
    assert len(hist) == 1 and hist[0][2] is None and TU.best_of(hist) is None
    assert TU.best_of([(0, {}, 2.0), (1, {}, 1.0), (2, {}, None)])[0] == 1
    assert flows.month_table({12: spark.createDataFrame([("t", 1.0)], "target string, smape double")
                              }).first()["month"] == "month_12"


def test_every_parameter_of_a_search_is_drawn_and_obeyed(spark):
    for family in ("random_forest", "xgboost", "lightgbm"):
        for r in TU.sample_trials(spark, family, 3).collect():
            assert set(r["params"]) == {n for n, *_ in TU.SEARCH_SPACES[family]}
    assert MD.default_params("random_forest")["n_estimators"] == 156
    assert MD.default_params("lightgbm")["learning_rate"] == 0.1
    _, report = MD.fit(MD.vectorize(_learnable(spark, 60), ["a", "b", "c"]), "random_forest",
                       "updrs_1", {"n_estimators": 2, "max_depth": 90})
    row = MD.report_rows(spark, {"updrs_1": (None, report)}).first()
    assert row["ignored"] == "" and "max_depth=90->60" in row["clamped"]


def test_csv_sources(spark):
    """S1-S3 as files, and P3 on the test form."""
    from assayline.operators import clean as C
    d = tempfile.mkdtemp(dir="/tmp")
    key = "visit_id,visit_month,patient_id"
    files = {"train_proteins": f"{key},UniProt,NPX\n1_0,0,1,P,2.5\n",
             "train_peptides": f"{key},UniProt,Peptide,PeptideAbundance\n1_0,0,1,P,AB,NaN\n",
             "train_clinical_data": f"{key},updrs_1,updrs_2,updrs_3,updrs_4,"
                                    "upd23b_clinical_state_on_medication\n1_0,0,1,1,2,3,,On\n",
             "test_proteins": f"{key},UniProt,NPX,group_key\n1_0,0,1,P,2.5,0\n",
             "test_peptides": f"{key},UniProt,Peptide,PeptideAbundance,group_key\n1_0,0,1,P,AB,4,0\n",
             "test": f"{key},updrs_test,row_id,group_key\n1_0,0,1,updrs_1,1_0_updrs_1,0\n"}
    for name, text in files.items():
        with open(f"{d}/{name}.csv", "w") as f:
            f.write(text)
    t = FS.load_train_csv(spark, d)
    assert t.proteins.first()["NPX"] == 2.5 and t.clinical.first()["updrs_4"] is None
    assert t.peptides.first()["PeptideAbundance"] is None
    caller = FS.load_caller_tables(spark, f"{d}/train_clinical_data.csv",
                                   f"{d}/train_proteins.csv", f"{d}/train_peptides.csv")
    assert FS.validate_inputs(caller, 24) == []
    prot, pep, test = FS.load_test_csv(spark, d)
    assert "group_key" not in C.drop_group_key(prot).columns
    assert (pep.first()["group_key"], test.first()["row_id"]) == (0, "1_0_updrs_1")


def test_apply_downcast(spark):
    from assayline.operators import reports as RP
    df = spark.createDataFrame([(1, 2.0, "a"), (300, 3.0, None)], "i long, d double, s string")
    plan = RP.downcast_plan(df).collect()
    assert {r["column"]: r["n_categories"] for r in plan}["s"] == 1.0
    assert [t for _, t in RP.apply_downcast(df, plan).dtypes] == ["smallint", "float", "string"]


def test_month_table_equals_month_report(spark, monkeypatch):
    """Both queries fit with the default parameters, here of small trees."""
    from assayline.plans import queries_models as QM
    from conftest import SF001
    monkeypatch.setitem(MD.DEFAULT_PARAMS, "random_forest", {"n_estimators": 2, "max_depth": 2})
    table = QM.month_table_random_forest(spark, SF001).where("month = 'month_24'")
    report = QM.month_report_random_forest(spark, SF001)
    want = {r["target"]: r["smape"] for r in report.collect()}
    got = {r["target"]: r["smape"] for r in table.collect()}
    assert len(want) == 5 and got == pytest.approx(want, abs=1e-9)


def test_tree_queries_return_scores_of_real_fits(spark, monkeypatch):
    """Learning curve and choice of family on a small month, with the default
    parameters but fewer trees; the choice equals fitting one by one."""
    from assayline.operators import metrics as M
    from assayline.plans import queries_models as QM
    v = MD.vectorize(_learnable(spark, 300), ["a", "b", "c"])
    monkeypatch.setattr(QM, "_vec", lambda spark, sf_dir: (v, []))
    monkeypatch.setitem(MD.DEFAULT_PARAMS, "random_forest",
                        {**MD.DEFAULT_PARAMS["random_forest"], "n_estimators": 3})
    for family in ("gradient_boosting", "xgboost", "lightgbm"):
        monkeypatch.setitem(MD.LIBRARY_DEFAULTS, family,
                            {**MD.LIBRARY_DEFAULTS[family], "n_estimators": 3})
    curve = QM.evaluate_tree_learning_curve(spark, "").collect()
    assert len(curve) == 10 and all(r["score_mean"] <= 1 for r in curve)
    got = QM.evaluate_tree_families(spark, "").collect()
    rmse = {r["family"]: r["mean_rmse"] for r in got}
    assert set(rmse) == set(MD.FAMILIES)
    assert [r["family"] for r in got if r["chosen"]] == [min(rmse, key=rmse.get)]
    model, _ = MD.fit(v.where("split = 'train'"), "xgboost", "updrs_1")
    one = MD.predict(model, v.where("split = 'test'")).select(
        F.col("updrs_1").alias("y"), "p").agg(M.rmse_expr().alias("r")).first()["r"]
    assert rmse["xgboost"] == pytest.approx(one, rel=1e-9)  # all four labels are alike here
