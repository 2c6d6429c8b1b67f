"""Registered queries: metrics on fixed predictors (A15-A24, M18, M23 shape, M25, U3, T3, F4-F6).

The fixed predictor is the train-row mean of each target per group
(UniProt by default): it makes every metric SQL-checkable, while the tree
models (rows-only checks) reuse the same metric operators.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from assayline.functions.scalar import hash_bucket
from assayline.operators import metrics as M
from assayline.operators import split as SP
from assayline.plans import flows
from assayline.plans import oracle as Q
from assayline.plans.catalog import register
from assayline.sources.adapter import load_tables

MONTH = 24
_KEYS = ["visit_id", "UniProt", "Peptide"]
_T = Q.TARGETS


def _long(spark, sf_dir):
    df = flows.clean(load_tables(spark, sf_dir), MONTH, keep_visit_keys=True)
    df = SP.assign_split(df.select(*_KEYS, *_T), "80_20")
    return M.long_labels(df, keep=[*_KEYS, "split"])


def _pred(spark, sf_dir, group=("UniProt",)):
    lg = _long(spark, sf_dir)
    model = M.group_mean_predictor(lg, list(group))
    return M.apply_group_mean(lg, model, list(group)).withColumnRenamed("split", "dataset")


def _long_sql(group="UniProt"):
    lg = " UNION ALL ".join(
        f"SELECT visit_id, UniProt, Peptide, split, '{t}' AS target, {t} AS y FROM sp" for t in _T)
    gsel = f"{group}, " if group else ""
    gjoin = f" AND lg.{group} = mdl.{group}" if group else ""
    gby = f", {group}" if group else ""
    return Q.with_(Q.clean(MONTH)) + f""",
sp AS (SELECT *, {Q.split_case()} AS split FROM cleaned),
lg AS ({lg}),
mdl AS (SELECT target, {gsel}avg(y) AS p FROM lg WHERE split = 'train' GROUP BY target{gby}),
pr AS (SELECT lg.visit_id, lg.UniProt, lg.Peptide, lg.split AS dataset, lg.target, lg.y, mdl.p
       FROM lg LEFT JOIN mdl ON lg.target = mdl.target{gjoin})"""


_SMAPE = ("100.0 * avg(CASE WHEN y = 0 AND p = 0 THEN 0.0 "
          "ELSE abs(y - p) / ((abs(y) + abs(p)) / 2.0) END)")
_METRICS_SQL = (f"{_SMAPE} AS smape, sqrt(avg(pow(y - p, 2))) AS rmse, avg(abs(y - p)) AS mae, "
                "avg(pow(y - p, 2)) AS mse")
_MCOLS = ("smape", "rmse", "mae", "mse")


@register("fixed_predictions", _long_sql() + """
SELECT *, y - p AS residual, p - y AS error FROM pr""", rounded=("p", "residual", "error"))
def fixed_predictions(spark, sf_dir):
    """M25 + F4: y, p, residual, error per (row, target)."""
    return M.prediction_table(_pred(spark, sf_dir))


@register("evaluate_fixed", _long_sql() + f"""
SELECT dataset, target, {_METRICS_SQL} FROM pr GROUP BY dataset, target""", rounded=_MCOLS)
def evaluate_fixed(spark, sf_dir):
    """M18 (A15-A18): metrics per dataset and target."""
    return M.evaluate(_pred(spark, sf_dir))


@register("mean_of_metrics", _long_sql() + f""",
ev AS (SELECT dataset, target, {_METRICS_SQL} FROM pr GROUP BY dataset, target)
SELECT dataset, avg(smape) AS smape, avg(rmse) AS rmse, avg(mae) AS mae, avg(mse) AS mse
FROM ev GROUP BY dataset""", rounded=_MCOLS)
def mean_of_metrics(spark, sf_dir):
    """A19."""
    return M.mean_of_metrics(M.evaluate(_pred(spark, sf_dir)))


@register("metric_summary", _long_sql() + f""",
ev AS (SELECT dataset, target, {_METRICS_SQL} FROM pr GROUP BY dataset, target)
SELECT dataset, target, smape, rmse, mae, mse FROM ev
UNION ALL
SELECT dataset, 'mean' AS target, avg(smape), avg(rmse), avg(mae), avg(mse) FROM ev GROUP BY dataset
ORDER BY dataset, target""", rounded=_MCOLS)
def metric_summary(spark, sf_dir):
    """A20 + U3 + T3: per-target rows plus a mean row per dataset."""
    return M.metric_summary(M.evaluate(_pred(spark, sf_dir)))


@register("r2_fixed", _long_sql() + """
SELECT dataset, target, CASE WHEN count(y) * var_pop(y) <> 0
                             THEN 1.0 - sum(pow(y - p, 2)) / (count(y) * var_pop(y)) END AS r2
FROM pr GROUP BY dataset, target""", rounded=("r2",))
def r2_fixed(spark, sf_dir):
    """A22."""
    return M.evaluate(_pred(spark, sf_dir), metrics=["r2"])


@register("error_histogram", _long_sql() + """,
e AS (SELECT target, p - y AS error FROM pr WHERE dataset = 'test'),
r AS (SELECT target, min(error) AS mn, max(error) AS mx FROM e GROUP BY target)
SELECT e.target,
       CASE WHEN r.mx - r.mn = 0 THEN 0
            ELSE least(CAST(floor((e.error - r.mn) * 25 / (r.mx - r.mn)) AS INTEGER), 24) END AS bin,
       count(*) AS n, min(r.mn) AS range_min, min(r.mx) AS range_max
FROM e JOIN r ON e.target = r.target WHERE e.error IS NOT NULL GROUP BY 1, 2""",
          rounded=("range_min", "range_max"))
def error_histogram(spark, sf_dir):
    """25 bins of test errors per target."""
    pr = M.prediction_table(_pred(spark, sf_dir)).where(F.col("dataset") == "test")
    return M.error_histogram(pr.select("target", "error"), by=["target"])


@register("round3_metrics", _long_sql() + f""",
ev AS (SELECT dataset, target, {_METRICS_SQL} FROM pr GROUP BY dataset, target)
SELECT dataset, target, round_even(smape, 3) AS smape, round_even(rmse, 3) AS rmse,
       round_even(mae, 3) AS mae, round_even(mse, 3) AS mse FROM ev""")
def round3_metrics(spark, sf_dir):
    """metrics rounded half-even to 3 places."""
    return M.round3(M.evaluate(_pred(spark, sf_dir)), _MCOLS)


_FAMILIES = (("global_mean", None), ("uniprot_mean", "UniProt"), ("peptide_mean", "Peptide"))


def _family_sql():
    parts = []
    for fam, g in _FAMILIES:
        body = _long_sql(g)[len("WITH "):]
        parts.append(body)
    # Three independent CTE chains would clash on names; build one chain instead.
    lg = " UNION ALL ".join(
        f"SELECT visit_id, UniProt, Peptide, split, '{t}' AS target, {t} AS y FROM sp" for t in _T)
    sel = []
    for fam, g in _FAMILIES:
        if g:
            m = f"(SELECT target, {g}, avg(y) AS p FROM lg WHERE split = 'train' GROUP BY target, {g})"
            on = f"lg.target = m.target AND lg.{g} = m.{g}"
        else:
            m = "(SELECT target, avg(y) AS p FROM lg WHERE split = 'train' GROUP BY target)"
            on = "lg.target = m.target"
        sel.append(f"SELECT '{fam}' AS family, lg.target, lg.y, m.p FROM lg LEFT JOIN {m} m ON {on} "
                   f"WHERE lg.split = 'test'")
    return Q.with_(Q.clean(MONTH)) + f""",
sp AS (SELECT *, {Q.split_case()} AS split FROM cleaned),
lg AS ({lg}),
pr AS ({' UNION ALL '.join(sel)}),
ev AS (SELECT family, target, sqrt(avg(pow(y - p, 2))) AS rmse FROM pr GROUP BY family, target),
fm AS (SELECT family, avg(rmse) AS mean_rmse FROM ev GROUP BY family)
SELECT arg_min(family, mean_rmse) AS family, min(mean_rmse) AS mean_rmse FROM fm"""


@register("best_family_fixed", _family_sql(), rounded=("mean_rmse",))
def best_family_fixed(spark, sf_dir):
    """A21 over three fixed predictors (global, per-UniProt, per-Peptide means)."""
    lg = _long(spark, sf_dir)
    frames = []
    for fam, g in _FAMILIES:
        grp = [g] if g else []
        pr = M.apply_group_mean(lg, M.group_mean_predictor(lg, grp), grp)
        frames.append(pr.where(F.col("split") == "test").select(
            F.lit(fam).alias("family"), "target", "y", "p"))
    allp = frames[0]
    for f in frames[1:]:
        allp = allp.unionByName(f)
    ev = M.evaluate(allp, by=["family", "target"], metrics=["rmse"])
    return M.best_family(ev, "rmse")


def _lc_sql():
    lg = " UNION ALL ".join(
        f"SELECT visit_id, UniProt, Peptide, '{t}' AS target, {t} AS y FROM tr" for t in _T)
    sizes = ", ".join(f"({i}, {f})" for i, f in enumerate(SP.TRAIN_SIZES))
    fold = Q.bucket(42, "visit_id", "UniProt", "Peptide")
    sub = Q.bucket(43, "visit_id", "UniProt", "Peptide")
    return Q.with_(Q.clean(MONTH)) + f""",
tr AS (SELECT * FROM (SELECT *, {Q.split_case()} AS split FROM cleaned) WHERE split = 'train'),
lg AS (SELECT *, {fold} % 5 AS fold, {sub} AS sub FROM ({lg}) AS x),
combos AS (SELECT * FROM (VALUES {sizes}) AS s(size_index, fraction),
           (VALUES (0), (1), (2), (3), (4)) AS f(k)),
roles AS (SELECT c.size_index, c.fraction, c.k, lg.*,
                 CASE WHEN lg.fold = c.k THEN 'val'
                      WHEN lg.sub < CAST(round(c.fraction * 10000) AS BIGINT) THEN 'train' END AS role
          FROM lg, combos c),
mdl AS (SELECT size_index, k, target, UniProt, avg(y) AS p FROM roles WHERE role = 'train'
        GROUP BY size_index, k, target, UniProt),
sc AS (SELECT r.size_index, r.fraction, r.k, r.target, r.role AS kind,
              CASE WHEN count(r.y) * var_pop(r.y) <> 0
                   THEN 1.0 - sum(pow(r.y - m.p, 2)) / (count(r.y) * var_pop(r.y)) END AS score
       FROM roles r LEFT JOIN mdl m ON r.size_index = m.size_index AND r.k = m.k
            AND r.target = m.target AND r.UniProt = m.UniProt
       WHERE r.role IS NOT NULL GROUP BY 1, 2, 3, 4, 5)
SELECT size_index, CAST(fraction AS DOUBLE) AS fraction, target, kind,
       avg(score) AS score_mean, stddev_pop(score) AS score_std
FROM sc GROUP BY size_index, fraction, target, kind"""


@register("learning_curve_fixed", _lc_sql(), rounded=("score_mean", "score_std"))
def learning_curve_fixed(spark, sf_dir):
    """M23 shape with the fixed predictor + A23: 5 folds x 5 train sizes from
    one row-level aggregate (no row is copied per fit), r2 per fit, mean and
    population std over folds."""
    df = flows.clean(load_tables(spark, sf_dir), MONTH, keep_visit_keys=True)
    tr = SP.assign_split(df.select(*_KEYS, *_T), "80_20").where(F.col("split") == "train")
    lg = (M.long_labels(tr, keep=_KEYS)
          .withColumn("fold", F.pmod(hash_bucket(42, *_KEYS), F.lit(5)))
          .withColumn("sub", hash_bucket(43, *_KEYS)))
    return M.learning_curve_group_mean(lg, ["UniProt"], sizes=SP.TRAIN_SIZES)
