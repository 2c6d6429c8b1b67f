"""Registered queries: tree models, tuning, persistence.

Whole models have no SQL twin: small trees do (``boosted_tree_splits``), and
fitted models are checked by invariants that have one (rows scored, ranges,
reloading, importances); the search, its early stop and the sinks run on the
fixed predictor, which SQL can follow.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from assayline.operators import metrics as M
from assayline.operators import models as MD
from assayline.operators import split as SP
from assayline.operators import tuning as TU
from assayline.plans import flows
from assayline.plans import oracle as Q
from assayline.plans import queries_metrics as QM
from assayline.plans.catalog import register
from assayline.sources import files as FS
from assayline.session import store
from assayline.sources.adapter import load_tables

MONTH = 24


def _vec(spark, sf_dir, scheme="80_20"):
    return flows.prepared_vectors(load_tables(spark, sf_dir), MONTH, scheme)


def _fit_one(family):
    def q(spark, sf_dir):
        vec, _ = _vec(spark, sf_dir)
        model, _ = MD.fit(vec.where(F.col("split") == "train"), family, "updrs_1")
        return MD.predict(model, vec.where(F.col("split") == "test")).select(
            "visit_id", "UniProt", "Peptide", F.col("updrs_1").alias("y"), "p")
    q.__doc__ = f"M11, M12 + M17: {family} parameters for updrs_1, test predictions."
    return q


register("fit_random_forest_updrs_1", None)(_fit_one("random_forest"))
register("fit_gradient_boosting_updrs_1", None)(_fit_one("gradient_boosting"))
# M13, M14 with their libraries' default parameters.
register("gbt_xgboost_params", None)(_fit_one("xgboost"))
register("gbt_lightgbm_params", None)(_fit_one("lightgbm"))


# Invariants of fitted models: what must hold whatever the trees are, with an SQL twin.
_SMALL = {"random_forest": {"n_estimators": 8, "max_depth": 6},
          "gradient_boosting": {"n_estimators": 3, "max_depth": 3},
          "xgboost": {"n_estimators": 3, "max_depth": 3},
          "lightgbm": {"n_estimators": 3, "max_depth": 3, "num_leaves": 8}}


def _small(family):
    return {t: _SMALL[family] for t in Q.TARGETS}


def _checked(vec, models, loaded):
    """Per dataset and target: rows scored, null predictions, predictions
    outside the train labels' range, rows where a reloaded model differs."""
    bounds = vec.where(F.col("split") == "train").agg(
        *[f(t).alias(f"{n}_{t}") for t in Q.TARGETS for n, f in (("lo", F.min), ("hi", F.max))]
    ).first()
    out = None
    for t, (m, _) in models.items():
        both = MD.predict(loaded[t], MD.predict(m, vec), "p2")
        pred = both.groupBy(F.col("split").alias("dataset")).agg(
            F.lit(t).alias("target"), F.count(F.lit(1)).alias("rows_scored"),
            F.count_if(F.col("p").isNull()).alias("null_predictions"),
            F.count_if((F.col("p") < bounds[f"lo_{t}"] - 1e-9)
                       | (F.col("p") > bounds[f"hi_{t}"] + 1e-9)).alias("outside_range"),
            F.count_if(F.col("p") != F.col("p2")).alias("reload_differs"))
        out = pred if out is None else out.unionByName(pred)
    return out


_ROWS_SQL = Q.with_(Q.clean(MONTH)) + f""",
sp AS (SELECT {Q.split_case()} AS dataset FROM cleaned),
tg AS (SELECT unnest({list(Q.TARGETS)}) AS target)"""


@register("forest_invariants", _ROWS_SQL + """
SELECT dataset, target, count(*) AS rows_scored, 0 AS null_predictions, 0 AS outside_range,
       0 AS reload_differs FROM sp, tg GROUP BY dataset, target""")
def forest_invariants(spark, sf_dir):
    """Four forests fitted, saved and loaded; every
    row scored, inside the train labels' range, alike after loading."""
    root = FS.output_root(spark, "models")
    vec, _, models = flows.train_family(load_tables(spark, sf_dir), "random_forest", MONTH,
                                        params_by_target=_small("random_forest"), save_to=root)
    loaded = {t: MD.load_model("random_forest", f"{root}/random_forest/{t}") for t in models}
    return _checked(vec, models, loaded)


@register("boosting_invariants", _ROWS_SQL + """,
fm AS (SELECT unnest(['gradient_boosting', 'xgboost', 'lightgbm']) AS family)
SELECT family, dataset, count(*) AS rows_scored, 0 AS null_predictions, true AS better_than_worst,
       '' AS ignored
FROM sp, fm GROUP BY family, dataset""")
def boosting_invariants(spark, sf_dir):
    """Every row scored; the error is under that of the farthest
    constant in the label's range; no family ignores a parameter."""
    vec, _ = _vec(spark, sf_dir)
    out = None
    families = ("gradient_boosting", "xgboost", "lightgbm")
    fitted = MD.TrainData(vec.where(F.col("split") == "train"), ["updrs_1"]).fits(
        [(fam, "updrs_1", _SMALL[fam], 0) for fam in families])
    for fam, (model, report) in zip(families, fitted):
        y, p = F.col("updrs_1"), F.col("p")
        got = MD.predict(model, vec).groupBy(F.col("split").alias("dataset")).agg(
            F.lit(fam).alias("family"), F.count(F.lit(1)).alias("rows_scored"),
            F.count_if(p.isNull()).alias("null_predictions"),
            (F.avg((y - p) * (y - p)) <= F.pow(F.max(y) - F.min(y), F.lit(2.0)))
            .alias("better_than_worst"),
            F.lit(", ".join(sorted(report.ignored))).alias("ignored"))
        out = got if out is None else out.unionByName(got)
    return out


@register("importance_invariants", _ROWS_SQL + """
SELECT target, 41 AS n_features, 0 AS negative, 1.0::DOUBLE AS total,
       count_if(dataset = 'train') AS train_rows FROM sp, tg GROUP BY target""",
          rounded=("total",))
def importance_invariants(spark, sf_dir):
    """Importances of each target's forest: one row a feature (constants
    have 0), none negative, sum 1."""
    tables = load_tables(spark, sf_dir)
    prep = flows.prepare(tables, MONTH)
    every = flows.model_features(prep.columns)
    vec, feats, models = flows.train_family(tables, "random_forest", MONTH,
                                            params_by_target=_small("random_forest"))
    n = vec.where(F.col("split") == "train").count()
    out = None
    for t, (m, _) in models.items():
        got = MD.feature_importance(spark, m, feats, every).agg(
            F.lit(t).alias("target"), F.count(F.lit(1)).cast("int").alias("n_features"),
            F.count_if(F.col("importance") < 0).alias("negative"),
            F.sum("importance").alias("total"), F.lit(n).cast("long").alias("train_rows"))
        out = got if out is None else out.unionByName(got)
    return out


@register("unseen_month_invariants", Q.with_(Q.clean(36)) + f""",
sp AS (SELECT {Q.split_case()} AS dataset FROM cleaned),
tg AS (SELECT unnest({list(Q.TARGETS)}) AS target),
sc AS (SELECT unnest(['test', 'all']) AS scope)
SELECT scope, target, count_if(scope = 'all' OR dataset = 'test') AS rows_scored,
       0 AS null_predictions FROM sp, tg, sc GROUP BY scope, target""")
def unseen_month_invariants(spark, sf_dir):
    """Forests of month 24 on month 36, published scope and all rows."""
    tables = load_tables(spark, sf_dir)
    vec, feats, models = flows.train_family(tables, "random_forest", MONTH,
                                            params_by_target=_small("random_forest"))
    unseen = flows.unseen_vectors(tables, feats, 36)  # once for both scopes
    out = None
    for scope in ("test", "all"):
        pred = flows.unseen_predictions(tables, models, feats, 36, scope, vec=unseen)
        got = pred.groupBy("target").agg(
            F.lit(scope).alias("scope"), F.count(F.lit(1)).alias("rows_scored"),
            F.count_if(F.col("p").isNull()).alias("null_predictions"))
        out = got if out is None else out.unionByName(got)
    return out


@register("evaluate_tree_learning_curve", None)
def evaluate_tree_learning_curve(spark, sf_dir):
    """M23 with the default forest: 5 folds x 5 nested train sizes; mean and
    population std of r2 on both sides."""
    vec, _ = _vec(spark, sf_dir)
    return MD.learning_curve(vec.where(F.col("split") == "train"), "random_forest", "updrs_1",
                             MD.default_params("random_forest"))


@register("evaluate_tree_families", None)
def evaluate_tree_families(spark, sf_dir):
    """A21 with trained models: mean test rmse over four targets of all four
    families with their default parameters, and the one with the least chosen.
    The rows are binned once and all sixteen models grow in the same rounds."""
    vec, _ = _vec(spark, sf_dir)
    jobs = [(fam, t, None, 0) for fam in MD.FAMILIES for t in Q.TARGETS]
    fitted = MD.TrainData(vec.where(F.col("split") == "train"), Q.TARGETS).fits(jobs)
    out = None
    for fam in MD.FAMILIES:
        models = {t: m for (f, t, _, _), m in zip(jobs, fitted) if f == fam}
        pred = MD.long_predictions(vec, models, datasets=["test"]).withColumn("family", F.lit(fam))
        out = pred if out is None else out.unionByName(pred)
    ev = store(M.evaluate(out, by=["family", "target"], metrics=["rmse"]), "rmse")
    best = M.best_family(ev, "rmse").select(F.col("family").alias("best"))
    means = ev.groupBy("family").agg(F.avg("rmse").alias("mean_rmse"))
    return means.join(best, F.col("family") == F.col("best"), "left").select(
        "family", "mean_rmse", F.col("best").isNotNull().alias("chosen"))


# Search on the fixed predictor: the same draws, proposals, early stop and choice in SQL.
_N_TRIALS = 16


def _u(*keys: str) -> str:
    return ("(('0x' || substr(md5(" + " || '|' || ".join(keys) + "), 1, 8))::UBIGINT::DOUBLE "
            "/ 4294967296.0)")


def _parzen(rows: str) -> str:
    """Kernels (target, k, at, s) of the places of ``rows`` (target, x, trial)."""
    wide = math.sqrt(3.0) / math.pi
    return f"""
  SELECT target, k, x AS mid, {wide!r} * least(1.0, greatest(1.0 / least(100, n + 2),
         x - coalesce(lag(x) OVER w, 0.0), coalesce(lead(x) OVER w, 1.0) - x)) AS s
  FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY x, trial) - 1 AS k,
               count(*) OVER (PARTITION BY target) AS n FROM ({rows}))
  WINDOW w AS (PARTITION BY target ORDER BY k)
  UNION ALL SELECT target, count(*), 0.5, {wide!r} FROM ({rows}) GROUP BY target"""


def _cdf(u: str) -> str:
    return f"(1.0 / (1.0 + exp(-({u} - mid) / s)))"


def _proposal_sql(k: int) -> str:
    """Trial ``k`` after the trials before it: CTE h{k} (target, trial, weight, value)."""
    density = f"avg({_cdf('u')} * (1.0 - {_cdf('u')}) / s / ({_cdf('1.0')} - {_cdf('0.0')}))"
    best = min(TU.BEST_MOST, max(1, math.ceil(TU.BEST_SHARE * k)))
    before = " UNION ALL ".join(f"SELECT * FROM h{j}" for j in range(TU.STARTUP - 1, k))
    keys = ("'42'", "'group_mean'", f"'{k}'", "'weight'", "c::VARCHAR")
    return f""",
o{k} AS MATERIALIZED (SELECT target, weight AS x, trial,
  row_number() OVER (PARTITION BY target ORDER BY value, trial) <= {best} AS good FROM ({before})),
a{k} AS MATERIALIZED ({_parzen(f"SELECT * FROM o{k} WHERE good")}),
b{k} AS MATERIALIZED ({_parzen(f"SELECT * FROM o{k} WHERE NOT good")}),
c{k} AS MATERIALIZED (
  SELECT target, c, least(1.0, greatest(0.0, mid + s * ln(q / (1.0 - q)))) AS u FROM (
    SELECT d.target, d.c, mid, s, {_cdf('0.0')} + d.v * ({_cdf('1.0')} - {_cdf('0.0')}) AS q
    FROM (SELECT target, c, least(floor({_u(*keys, "'kernel'")} * n), n - 1) AS k,
                 {_u(*keys, "'place'")} AS v
          FROM (SELECT target, count(*) AS n FROM a{k} GROUP BY target), range({TU.CANDIDATES}) AS r(c)) d
    JOIN a{k} USING (target, k))),
e{k} AS MATERIALIZED (SELECT target, arg_max(u, (l - g, -c)) AS weight FROM (
  SELECT target, c, u, (SELECT ln({density}) FROM a{k} WHERE a{k}.target = c{k}.target) AS l,
         (SELECT ln({density}) FROM b{k} WHERE b{k}.target = c{k}.target) AS g FROM c{k})
  GROUP BY target),
h{k} AS MATERIALIZED (SELECT target, {k} AS trial, any_value(weight) AS weight,
  {QM._SMAPE} AS value FROM (
    SELECT v0.target, e.weight, v0.y, e.weight * v0.p0 + (1.0 - e.weight) * v0.overall AS p
    FROM v0 JOIN e{k} e USING (target)) GROUP BY target)"""


_SEARCH_SQL = QM._long_sql("UniProt").replace(Q.split_case(), Q.split_case(0.2, 0.2)) + f""",
ov AS (SELECT target, avg(y) AS overall FROM lg WHERE split = 'train' GROUP BY target),
v0 AS MATERIALIZED (SELECT pr.target, pr.y, coalesce(pr.p, ov.overall) AS p0, ov.overall
                    FROM pr JOIN ov USING (target) WHERE pr.dataset = 'val'),
tr AS (SELECT i::INTEGER AS trial, i::VARCHAR AS t_ FROM range({TU.STARTUP}) AS r(i)),
dr AS (SELECT trial, {_u("'42'", "'group_mean'", "t_", "'weight'")} AS weight FROM tr),
vl AS (SELECT v0.target, dr.trial, dr.weight, v0.y,
              dr.weight * v0.p0 + (1.0 - dr.weight) * v0.overall AS p FROM v0, dr),
h{TU.STARTUP - 1} AS MATERIALIZED (
  SELECT target, trial, any_value(weight) AS weight, {QM._SMAPE} AS value
  FROM vl GROUP BY target, trial)""" + "".join(
    _proposal_sql(k) for k in range(TU.STARTUP, _N_TRIALS)) + f""",
sm AS ({" UNION ALL ".join(f"SELECT * FROM h{k}" for k in range(TU.STARTUP - 1, _N_TRIALS))})"""
_STOP_SQL = f""",
st AS (
  WITH RECURSIVE s(target, trial, weight, value, best, k) AS (
    SELECT target, trial, weight, value, value, 0 FROM sm WHERE trial = 0
    UNION ALL
    SELECT sm.target, sm.trial, sm.weight, sm.value,
           CASE WHEN sm.value < s.best - {TU.TOLERANCE} THEN sm.value ELSE s.best END,
           CASE WHEN sm.value < s.best - {TU.TOLERANCE} THEN 0 ELSE s.k + 1 END
    FROM s JOIN sm ON sm.target = s.target AND sm.trial = s.trial + 1
    WHERE s.k < {TU.EARLY_STOP_ROUNDS})
  SELECT * FROM s)"""


def _search(spark, sf_dir, rounds=TU.EARLY_STOP_ROUNDS):
    """Trial table of the fixed predictor's search."""
    df = flows.clean(load_tables(spark, sf_dir), MONTH, keep_visit_keys=True)
    keys = ["visit_id", "UniProt", "Peptide"]
    long = M.long_labels(SP.assign_split(df.select(*keys, *Q.TARGETS), "64_16_20"),
                         keep=[*keys, "split"])
    hist = TU.shrinkage_history(store(long, "long"), ["UniProt"],
                                TU.sample_trials(spark, "group_mean", _N_TRIALS), rounds)
    out = None
    for t in sorted(hist):
        part = TU.trial_table(spark, "group_mean", t, hist[t])
        out = part if out is None else out.unionByName(part)
    return out


@register("shrinkage_search", _SEARCH_SQL + _STOP_SQL + """
SELECT 'group_mean' AS family, target, trial, weight, value FROM st""",
          rounded=("weight", "value"))
def shrinkage_search(spark, sf_dir):
    """Seeded draws, then proposals of the Parzen estimator, validation
    SMAPE, early stop, per target."""
    return _search(spark, sf_dir).select("family", "target", "trial",
                                         F.col("params")["weight"].alias("weight"), "value")


@register("adaptive_search", _SEARCH_SQL + """
SELECT 'group_mean' AS family, target, trial, weight, value FROM sm""", rounded=("weight", "value"))
def adaptive_search(spark, sf_dir):
    """The same search without early stop: ten random trials a target,
    then six proposals, each after the values of all trials before it."""
    return _search(spark, sf_dir, rounds=_N_TRIALS).select(
        "family", "target", "trial", F.col("params")["weight"].alias("weight"), "value")


@register("trial_round_trip", _SEARCH_SQL + _STOP_SQL + """
SELECT 'run_a' AS run, target, count(*) AS trials, arg_min(trial, (value, trial)) AS best_trial,
       min(value) AS best_value FROM st GROUP BY target
UNION ALL SELECT 'run_b', target, count(*), arg_min(trial, (value, trial)), min(value)
FROM st GROUP BY target""", rounded=("best_value",))
def trial_round_trip(spark, sf_dir):
    """S11 + T5: trials stored under two run ids, one of them twice, read back."""
    trials, root = _search(spark, sf_dir), FS.output_root(spark, "trials")
    for run in ("run_a", "run_b", "run_a"):
        FS.append_trials(trials, root, run)
    return FS.read_trials(spark, root).groupBy("run", "target").agg(
        F.count(F.lit(1)).alias("trials"),
        F.min_by("trial", F.struct("value", "trial")).alias("best_trial"),
        F.min("value").alias("best_value"))


@register("params_round_trip", _SEARCH_SQL + _STOP_SQL + """
SELECT 'group_mean' AS family, target, 'weight' AS name, arg_min(weight, (value, trial)) AS value
FROM st GROUP BY target
UNION ALL SELECT 'overall_mean', target, 'weight', 0.0 FROM st GROUP BY target""",
          rounded=("value",))
def params_round_trip(spark, sf_dir):
    """S7 + S8: two families' best parameters, saved one after the other."""
    best, root = TU.best_trial(_search(spark, sf_dir)), FS.output_root(spark, "params")
    FS.write_params(best.select("params", "family", "target"), root)
    none = F.create_map(F.lit("weight"), F.lit(0.0))
    FS.write_params(best.select(none.alias("params"), F.lit("overall_mean").alias("family"),
                                "target"), root)
    return FS.read_params(spark, root).select("family", "target",
                                              F.explode("params").alias("name", "value"))


@register("metrics_csv_round_trip", QM._long_sql() + f""",
ev AS (SELECT dataset, target, {QM._METRICS_SQL} FROM pr GROUP BY dataset, target)
SELECT dataset, target, smape, rmse, mae, mse FROM ev""", rounded=QM._MCOLS)
def metrics_csv_round_trip(spark, sf_dir):
    """S5 + S6: the metric table written as CSV and read back."""
    root = FS.output_root(spark, "metrics")
    FS.write_metrics_csv(M.evaluate(QM._pred(spark, sf_dir)), root)
    return FS.read_metrics_csv(spark, root, "dataset string, target string, smape double, "
                                            "rmse double, mae double, mse double").drop("file")


@register("evaluate_random_forest", None)
def evaluate_random_forest(spark, sf_dir):
    """M16 + M18 + A20: four forests, metrics per dataset and target, mean rows."""
    vec, _ = _vec(spark, sf_dir)
    models = MD.fit_all_targets(vec, "random_forest")
    return M.metric_summary(M.evaluate(MD.long_predictions(vec, models)))


@register("feature_importance_top11", None)
def feature_importance_top11(spark, sf_dir):
    """M24 + T2: the 11 most important features of the updrs_3 forest."""
    vec, feats = _vec(spark, sf_dir)
    model, _ = MD.fit(vec.where(F.col("split") == "train"), "random_forest", "updrs_3")
    return MD.importance_ranked(MD.feature_importance(spark, model, feats), 11)


@register("month_report_random_forest", None)
def month_report_random_forest(spark, sf_dir):
    """SMAPE per target and mean for one family and month (refit mode)."""
    return flows.month_report(load_tables(spark, sf_dir), "random_forest", MONTH)


@register("month_report_from_files", None)
def month_report_from_files(spark, sf_dir):
    """L7 with S3, S4, S9, S10: forests of month 24 saved; a caller's three CSV
    files (the tables, written out) scored with the loaded models."""
    tables, root = load_tables(spark, sf_dir), FS.output_root(spark, "caller")
    flows.train_family(tables, "random_forest", MONTH, save_to=f"{root}/models")
    for name in ("clinical", "proteins", "peptides"):
        getattr(tables, name).write.option("header", True).csv(f"{root}/{name}")
    return flows.report_from_files(spark, f"{root}/clinical", f"{root}/proteins",
                                   f"{root}/peptides", "random_forest", MONTH,
                                   models_folder=f"{root}/models")


@register("month_table_random_forest", None)
def month_table_random_forest(spark, sf_dir):
    """L7 over two months with the default parameters, stacked under their labels,
    written as CSV and read back."""
    tables, root = load_tables(spark, sf_dir), FS.output_root(spark, "months")
    FS.write_metrics_csv(flows.month_table(
        {m: flows.month_report(tables, "random_forest", m) for m in (12, MONTH)}), root)
    return FS.read_metrics_csv(spark, root, "month string, target string, smape double").drop("file")


@register("evaluate_unseen_month_36", None)
def evaluate_unseen_month_36(spark, sf_dir):
    """L6 + S9/S10: forests trained on month 24, saved, loaded, scored on month 36."""
    tables = load_tables(spark, sf_dir)
    root = FS.output_root(spark, "models")
    _, feats, models = flows.train_family(tables, "random_forest", MONTH, save_to=root)
    loaded, names = flows.load_models(spark, "random_forest", root)
    return flows.evaluate_unseen_month(tables, loaded, names, 36)


@register("tune_random_forest", None)
def tune_random_forest(spark, sf_dir):
    """L9 (M19-M22, T5, S8, S11): 5 trials per target, each stored as it ends,
    early stopping, refit on train + val; trial table saved, read back, best
    trial per target."""
    tables = load_tables(spark, sf_dir)
    root = FS.output_root(spark, "tuning")
    _, best, trials = flows.tune_family(tables, "random_forest", MONTH, n_trials=5,
                                        trials_folder=f"{root}/search")
    FS.append_trials(trials, f"{root}/trials", "run_1")
    FS.write_params(best, f"{root}/params")
    return TU.best_trial(FS.read_trials(spark, f"{root}/trials"))
