"""The adaptive search: proposals, resumption, refit."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayline.operators import models as MD
from assayline.operators import tuning as TU
from assayline.plans import flows
from assayline.sources import files as FS

from test_models_sources import _learnable


def test_places_and_values_are_inverse():
    for family, space in TU.SEARCH_SPACES.items():
        for name, kind, lo, hi in space:
            for u in (0.0, 0.1, 0.5, 0.77, 0.999):
                v = TU.value_at(u, kind, lo, hi)
                assert lo <= v <= hi, (family, name)
                back = TU.value_at(TU.place_of(v, kind, lo, hi), kind, lo, hi)
                assert back == pytest.approx(v, rel=1e-12, abs=1e-12)


def test_random_start_equals_the_trial_table(spark):
    for family in ("xgboost", "random_forest", "lightgbm"):
        for r in TU.sample_trials(spark, family, 4).collect():
            for name, kind, lo, hi in TU.SEARCH_SPACES[family]:
                u = TU._hash_uniform(42, family, r["trial"], name)
                assert r["params"][name] == pytest.approx(TU.value_at(u, kind, lo, hi), rel=1e-12)


def test_parzen_density_is_one_and_draws_follow_it():
    for places in ([], [0.5], [0.0, 0.0, 1.0], [0.2, 0.21, 0.22, 0.9]):
        p = TU.Parzen(places)
        grid = (np.arange(20000) + 0.5) / 20000
        assert np.mean([p.density(u) for u in grid]) == pytest.approx(1.0, abs=1e-3)
        draws = [p.draw(*u) for u in np.random.default_rng(1).random((4000, 2))]
        assert 0 <= min(draws) and max(draws) <= 1
        want = np.mean([p.density(u) * (u < 0.3) for u in grid])
        assert np.mean(np.array(draws) < 0.3) == pytest.approx(want, abs=0.03)


def test_proposals_close_in_on_the_best():
    """A bowl over xgboost's nine parameters: proposals beat random trials."""
    space = TU.SEARCH_SPACES["xgboost"]

    def value(params):
        return sum((TU.place_of(params[n], k, lo, hi) - 0.3) ** 2 for n, k, lo, hi in space)

    history = []
    for t in range(60):
        if t < TU.STARTUP:
            params = {n: TU.value_at(TU._hash_uniform(42, "xgboost", t, n), k, lo, hi)
                      for n, k, lo, hi in space}
        else:
            params = TU.propose(history, "xgboost", t)
        history.append((t, params, value(params)))
    start = min(v for t, _, v in history if t < TU.STARTUP)
    random = np.mean([v for t, _, v in history if t < TU.STARTUP])
    late = np.mean([v for t, _, v in history if t >= 40])
    assert min(v for _, _, v in history) < 0.6 * start and late < 0.7 * random
    assert TU.propose(history, "xgboost", 60) == TU.propose(history, "xgboost", 60)
    assert TU.propose(history + [(60, params, None)], "xgboost", 61)  # without a value


def test_a_search_that_was_cut_ends_as_an_uncut_one(spark, tmp_path, monkeypatch):
    """Cut after three trials, read back and resumed: the same trials, and those
    that were stored are not run again. Proposals start with the third trial."""
    monkeypatch.setattr(TU, "STARTUP", 2)
    vec = MD.vectorize(_learnable(spark, 200), ["a", "b", "c"])
    folder = str(tmp_path / "trials")
    trials = TU.sample_trials(spark, "gradient_boosting", 6)
    monkeypatch.setitem(TU.SEARCH_SPACES, "gradient_boosting",
                        [("n_estimators", "int", 1, 8), ("learning_rate", "float_log", 0.01, 0.9)])
    trials = TU.sample_trials(spark, "gradient_boosting", 6)
    whole = TU.run_trials(vec, "gradient_boosting", "updrs_1", trials, rounds=9)
    assert [t for t, _, _ in whole] == list(range(6))

    class Cut(Exception):
        pass

    def commit(trial):
        FS.commit_trial(TU.trial_table(spark, "gradient_boosting", "updrs_1", [trial]), folder, "r")
        if trial[0] == 2:
            raise Cut

    assert FS.committed_trials(spark, folder, "r", "gradient_boosting", "updrs_1") == []
    with pytest.raises(Cut):
        TU.run_trials(vec, "gradient_boosting", "updrs_1", trials, rounds=9, commit=commit)
    done = FS.committed_trials(spark, folder, "r", "gradient_boosting", "updrs_1")
    assert [t for t, _, _ in done] == [0, 1, 2]
    assert FS.committed_trials(spark, folder, "other", "gradient_boosting", "updrs_1") == []
    again = []
    got = TU.run_trials(vec, "gradient_boosting", "updrs_1", trials, rounds=9, done=done,
                        commit=again.append)
    assert [t for t, _, _ in again] == [3, 4, 5]
    assert [(t, p) for t, p, _ in got] == [(t, p) for t, p, _ in whole]
    assert [v for *_, v in got] == pytest.approx([v for *_, v in whole], rel=1e-12)
    # A search whose early stop has come is not resumed.
    stopped = [(t, p, 1.0) for t, p, _ in whole[:3]]
    assert len(TU.run_trials(vec, "gradient_boosting", "updrs_1", trials, rounds=2,
                             done=stopped)) == 3


def test_tuned_family_is_refitted_on_train_and_validation(spark, tmp_path, monkeypatch):
    """Best trial per target, models of train + val, stored trials."""
    monkeypatch.setitem(TU.FIXED, "random_forest", {"n_estimators": 3})
    vec = MD.vectorize(_learnable(spark, 200), ["a", "b", "c"])

    class Tables:
        peptides = vec

    folder = str(tmp_path / "search")
    models, best, trials = flows.tune_family(Tables, "random_forest", n_trials=3, vec=vec,
                                             targets=("updrs_1", "updrs_2"), trials_folder=folder)
    rows = {r["target"]: r for r in TU.best_trial(trials).collect()}
    assert set(rows) == set(models) == {"updrs_1", "updrs_2"}
    for b in best.collect():
        assert b["params"] == rows[b["target"]]["params"]
    own = {k: (float(v) if k == "min_samples_split" else int(v))
           for k, v in rows["updrs_1"]["params"].items()}
    want, _ = MD.fit(vec.where(F.col("split") != "test"), "random_forest", "updrs_1", own)
    both = MD.predict(want, MD.predict(models["updrs_1"][0], vec), "q")
    assert both.where("p <> q").count() == 0
    assert FS.read_trials(spark, folder).count() == trials.count() == 6
    # The same run again only reads its trials.
    monkeypatch.setattr(MD, "fit", lambda *a, **k: (None, None))
    _, _, again = flows.tune_family(Tables, "random_forest", n_trials=3, vec=vec,
                                    targets=("updrs_1", "updrs_2"), trials_folder=folder)
    assert {(r["target"], r["trial"], r["value"]) for r in again.collect()} == \
        {(r["target"], r["trial"], r["value"]) for r in trials.collect()}


def test_importances_in_order(spark):
    """Descending, ties by name, the limit is the feature."""
    vec = MD.vectorize(_learnable(spark, 300), ["a", "b", "c"])
    model, _ = MD.fit(vec, "gradient_boosting", "updrs_1", {"n_estimators": 5})
    imp = MD.feature_importance(spark, model, ["a", "b", "c"], ["z", "a", "b", "c", "y"])
    rows = [(r["feature"], r["importance"]) for r in MD.importance_ranked(imp).collect()]
    assert [f for f, _ in rows[:2]] == ["a", "b"] and [f for f, _ in rows[-2:]] == ["y", "z"]
    assert rows[0][1] > rows[1][1] and math.fsum(v for _, v in rows) == pytest.approx(1)
    assert [r["feature"] for r in MD.importance_ranked(imp, 2).collect()] == ["a", "b"]


def test_report_from_a_callers_files(spark, tmp_path):
    """CSV files and saved models give what the tables and the models give;
    parameter files are obeyed; bad requests end before any work."""
    import json

    from assayline.sources.adapter import load_tables
    from conftest import SF001
    tables = load_tables(spark, SF001)
    files = {}
    for name in ("clinical", "proteins", "peptides"):
        files[name] = str(tmp_path / name)
        getattr(tables, name).write.option("header", True).csv(files[name])
    small = {t: {"n_estimators": 2, "max_depth": 3} for t in ("updrs_1", "updrs_2", "updrs_3",
                                                              "updrs_4")}
    models = str(tmp_path / "models")
    _, feats, fitted = flows.train_family(tables, "random_forest", 24, small, save_to=models)

    def rows(df):
        return {r["target"]: r["smape"] for r in df.collect()}

    got = rows(flows.report_from_files(spark, **files, family="random_forest", month=24,
                                       models_folder=models))
    assert got == pytest.approx(rows(flows.month_report(tables, "random_forest", 24, fitted,
                                                        features_used=feats)), rel=1e-12)
    assert len(got) == 5 and got["mean"] == pytest.approx(
        sum(v for t, v in got.items() if t != "mean") / 4)
    params = tmp_path / "params"
    params.mkdir()
    for i, p in enumerate(small.values(), 1):
        (params / f"xgboost_params_model_{i}.json").write_text(json.dumps(p))
    refit = rows(flows.report_from_files(spark, **files, family="xgboost", month=24,
                                         params_folder=str(params)))
    assert refit == pytest.approx(rows(flows.month_report(tables, "xgboost", 24,
                                                          params_by_target=small)), rel=1e-12)
    for bad in ({"month": 25}, {"family": "none"}):
        with pytest.raises(ValueError):
            flows.report_from_files(spark, **files, **{"family": "xgboost", "month": 24, **bad})


def test_tuning_bins_rows_once_for_all_targets(spark, monkeypatch):
    """Train rows for the trials, train + val rows for the refits: two tables,
    however many targets."""
    monkeypatch.setitem(TU.FIXED, "random_forest", {"n_estimators": 1})
    vec = MD.vectorize(_learnable(spark, 120), ["a", "b", "c"])
    made, own = [], MD.TrainData

    def counted(train, targets, *args, **kwargs):
        made.append(tuple(targets))
        return own(train, targets, *args, **kwargs)

    monkeypatch.setattr(MD, "TrainData", counted)

    class Tables:
        peptides = vec

    targets = ("updrs_1", "updrs_2")
    models, _, _ = flows.tune_family(Tables, "random_forest", n_trials=1, vec=vec, targets=targets)
    assert made == [targets, targets] and set(models) == set(targets)


def test_unseen_month_is_prepared_once_for_both_scopes(spark, monkeypatch):
    from assayline.plans import queries_models as QM
    rows = _learnable(spark, 120)
    model = MD.fit(MD.vectorize(rows, ["a", "b", "c"]), "random_forest", "updrs_1",
                   {"n_estimators": 1, "max_depth": 2})
    prepared = []
    monkeypatch.setattr(flows, "train_family",
                        lambda *a, **k: (None, ["a", "b", "c"], {"updrs_1": model}))
    monkeypatch.setattr(flows, "prepare", lambda t, month, *a: prepared.append(month) or rows)
    got = {r["scope"]: r["rows_scored"] for r in
           QM.unseen_month_invariants(spark, "/root/testdata/sf0.001").collect()}
    assert prepared == [36]
    assert got == {"all": rows.count(), "test": rows.where("split = 'test'").count()}
