"""Tree-ensemble regressors: M11-M17, M23, M24, M26, S9, S10, T1, T2, X4.

All four families are parameter sets of one distributed learner
(``operators.trees``): a forest is bagged trees of plain variance reduction,
the boosting families add one tree after the other on the gradients, with the
parameters that each of them has. Every parameter that the reference's search
spaces and defaults name is obeyed; a name that is unknown is reported.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.operators import split as SP
from assayline.operators import trees as TR
from assayline.session import store
from assayline.tables import TARGETS

SEED = 42
#: Nodes of the models that a learning curve holds at once.
MODEL_NODES = 1_600_000
FAMILIES = ("random_forest", "gradient_boosting", "xgboost", "lightgbm")

# The reference's defaults when no parameter file exists.
DEFAULT_PARAMS = {
    "random_forest": {"n_estimators": 156, "max_depth": 28, "min_samples_split": 20,
                      "min_samples_leaf": 20, "max_features": "log2", "max_leaf_nodes": 985},
}
# Library defaults used where a family has no explicit default (documented
# defaults of the respective libraries).
LIBRARY_DEFAULTS = {
    "random_forest": {"n_estimators": 100},
    "gradient_boosting": {"n_estimators": 100, "max_depth": 3, "learning_rate": 0.1},
    "xgboost": {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.3, "reg_lambda": 1.0,
                "min_child_weight": 1.0},
    "lightgbm": {"n_estimators": 100, "max_depth": -1, "learning_rate": 0.1, "num_leaves": 31,
                 "min_child_samples": 20, "min_child_weight": 0.001},
}
#: The learner's field for each parameter name.
FIELDS = {"n_estimators": "trees", "max_depth": "max_depth", "learning_rate": "rate",
          "min_samples_split": "min_split", "min_samples_leaf": "min_leaf",
          "min_child_samples": "min_leaf", "min_child_weight": "min_child_weight",
          "max_features": "node_features", "max_leaf_nodes": "max_leaves",
          "num_leaves": "max_leaves", "reg_alpha": "l1", "reg_lambda": "l2",
          "gamma": "min_gain", "min_split_gain": "min_gain", "subsample": "row_rate",
          "colsample_bytree": "column_rate"}
_WHOLE = ("trees", "max_depth", "max_leaves")


@dataclass
class FitReport:
    family: str
    target: str
    params: dict
    ignored: list = field(default_factory=list)
    clamped: list = field(default_factory=list)


def default_params(family: str) -> dict:
    """M15."""
    return dict(DEFAULT_PARAMS.get(family, LIBRARY_DEFAULTS.get(family, {})))


def tree_params(family: str, params: dict) -> tuple[TR.TreeParams, list, list]:
    """The learner's parameters from the reference's names: (parameters,
    unknown names, values out of the learner's range)."""
    if family not in FAMILIES:
        raise ValueError(f"unknown family {family}")
    out, ignored, clamped = {"boosted": family != "random_forest"}, [], []
    for k, v in {**LIBRARY_DEFAULTS[family], **params}.items():
        name = FIELDS.get(k)
        if name is None:
            ignored.append(k)
            continue
        if name in _WHOLE and v is not None:
            v = int(v)
        if name == "max_depth":
            if v is None or v <= 0:
                v = TR.DEEPEST  # unlimited in its library
            elif v > TR.DEEPEST:
                clamped.append(f"max_depth={v}->{TR.DEEPEST}")
                v = TR.DEEPEST
        out[name] = v
    return TR.TreeParams(**out), ignored, clamped


def estimator(family: str, label: str, params: dict | None = None):
    """The learner's parameters for a family name, plus the fit report."""
    merged = {**default_params(family), **(params or {})}
    tp, ignored, clamped = tree_params(family, merged)
    return tp, FitReport(family, label, merged, ignored, clamped)


class TreeModel:
    """Fitted trees: arrays per tree, with raw thresholds (left: x <= threshold)."""

    def __init__(self, family: str, base: float, rate: float, trees: list[dict], features: int):
        self.family, self.base, self.rate = family, base, rate
        self.trees, self.features = trees, features

    @classmethod
    def of(cls, family: str, fit: TR.Fit, edges: list) -> "TreeModel":
        trees = []
        for t in fit.trees:
            cut = np.zeros(len(t["feature"]))
            for f in np.unique(t["feature"][t["feature"] >= 0]):
                own = t["feature"] == f
                cut[own] = edges[f][t["bin"][own]]
            trees.append({**{k: t[k] for k in ("path", "feature", "gain", "left", "right", "rows",
                                               "value")}, "threshold": cut})
        p = fit.params
        rate = p.rate if p.boosted else 1.0 / max(1, len(trees))
        return cls(family, fit.base, rate, trees, len(edges))

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for t in self.trees:
            total += t["value"][TR.assign(x, {**t, "bin": t["threshold"]})]
        return self.base + self.rate * total

    @property
    def total_nodes(self) -> int:
        return sum(len(t["feature"]) for t in self.trees)

    def importances(self) -> np.ndarray:
        """Gain per feature: of each tree's total and averaged in a forest,
        summed over the trees of boosting; sums to 1 when a tree has a split."""
        out = np.zeros(self.features)
        for t in self.trees:
            own = np.bincount(t["feature"][t["feature"] >= 0],
                              t["gain"][t["feature"] >= 0], self.features)
            if self.family == "random_forest" and own.sum() > 0:
                own = own / own.sum()
            out += own
        return out / out.sum() if out.sum() > 0 else out


# Missing feature values (a measure nulled by the sigma rule) go into the
# vector as this sentinel, below the scaled [0, 1] train range, so a tree
# can split them off.
MISSING = -1.0


def vectorize(prepared: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """P18 on the shared table; stored because four targets (and every trial)
    read it."""
    filled = prepared.select(*[F.coalesce(F.col(c).cast("double"), F.lit(MISSING)).alias(c)
                               if c in features else F.col(c) for c in prepared.columns])
    return store(SP.split_xy(filled, TARGETS[0], features, out), "vectors")


class TrainData:
    """Rows binned once for any number of fits: the stored table, the bins'
    edges and the labels it holds. None of its rows trains an unset mask bit."""

    def __init__(self, train: DataFrame, targets: Sequence[str], mask=None, bins: int = TR.BINS):
        self.targets, self.bins = list(targets), bins
        self.edges = TR.bin_edges(train, bins=bins)
        self.table = (TR.training_table(train, self.targets, self.edges, mask=mask)
                      if self.edges else None)

    def fits(self, jobs: Sequence[tuple], seed: int = SEED) -> list:
        """(model or None, report) of each (family, target, params, mask bit),
        all grown in the same rounds. M26: no rows give no model."""
        made = []
        for family, target, params, bit in jobs:
            tp, report = estimator(family, target, params)
            made.append((TR.Fit(self.targets.index(target), tp, seed, bit), report))
        done = (TR.fit_trees(self.table, [f for f, _ in made], len(self.edges), self.bins)
                if self.table is not None else [])
        grown = {id(f) for f in done}
        return [(TreeModel.of(r.family, f, self.edges) if id(f) in grown else None, r)
                for f, r in made]


def fit(train: DataFrame, family: str, label: str, params: dict | None = None,
        seed: int = SEED, data: TrainData | None = None):
    """(model, report). M26: an empty input gives (None, report).
    ``data``: the same rows, binned before."""
    return (data or TrainData(train, [label])).fits([(family, label, params, 0)], seed)[0]


def fit_all_targets(vec: DataFrame, family: str, params_by_target: dict | None = None,
                    fit_on: Sequence[str] = ("train",), seed: int = SEED,
                    targets: Sequence[str] = TARGETS, data: TrainData | None = None) -> dict:
    """One model per target, in target order; the rows are binned once and
    all targets grow in the same rounds."""
    data = data or TrainData(vec.where(F.col("split").isin(*fit_on)), targets)
    jobs = [(family, t, (params_by_target or {}).get(t), 0) for t in targets]
    return dict(zip(targets, data.fits(jobs, seed)))


def scores(models: Sequence[TreeModel], features: str = "features") -> F.Column:
    """array<double> of every model's prediction, from one pass over the vector."""
    from pyspark.ml.functions import vector_to_array
    from pyspark import SparkContext
    # Only what scoring needs goes to the tasks, written out once; in the
    # function's closure the driver would hold it pickled besides.
    models = [TreeModel(m.family, m.base, m.rate,
                        [{k: t[k] for k in ("feature", "threshold", "left", "right", "value")}
                         for t in m.trees], m.features) for m in models]
    shared = SparkContext.getOrCreate().broadcast(models)

    @F.pandas_udf("array<double>")
    def predicted(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        m = np.stack(x.to_numpy())
        return pd.Series(list(np.stack([t.scores(m) for t in shared.value], axis=1)))

    return predicted(vector_to_array(features))


def predict(model: TreeModel, df: DataFrame, out: str = "p") -> DataFrame:
    """M17."""
    return df.withColumn(out, scores([model])[0])


def long_predictions(vec: DataFrame, models: dict, keys: Sequence[str] = SP.ROW_KEYS,
                     datasets: Sequence[str] | None = None) -> DataFrame:
    """(keys..., dataset, target, y, p) for every target with a model: one scan
    scores all of them, then the targets are unpivoted."""
    src = vec if datasets is None else vec.where(F.col("split").isin(*datasets))
    own = {t: m for t, (m, _) in models.items() if m is not None}
    if not own:
        raise ValueError("no fitted model")
    rows = src.select(*keys, F.col("split").alias("dataset"),
                      F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("y"))
                                for t in own]).alias("_y"),
                      scores(own.values()).alias("_p"))
    return rows.select(*keys, "dataset", F.inline(F.arrays_zip("_y", "_p"))).select(
        *keys, "dataset", "_y.target", "_y.y", F.col("_p").alias("p"))


def feature_importance(spark, model, features: Sequence[str],
                       every: Sequence[str] | None = None) -> DataFrame:
    """(feature, importance); one row per feature (bounded by the schema).
    A column of ``every`` that was left out of the fit has importance 0."""
    imp = dict(zip(features, model.importances().tolist()))
    return spark.createDataFrame([(f, float(imp.get(f, 0.0))) for f in every or features],
                                 "feature string, importance double")


def report_rows(spark, models: dict) -> DataFrame:
    """(family, target, ignored, clamped) of fitted models."""
    rows = [(r.family, t, ", ".join(sorted(r.ignored)), ", ".join(r.clamped))
            for t, (_, r) in models.items()]
    return spark.createDataFrame(rows, "family string, target string, ignored string, "
                                       "clamped string")


def importance_ranked(imp: DataFrame, limit: int | None = None) -> DataFrame:
    """T1 (T2 with limit 11): features by importance, descending."""
    out = imp.orderBy(F.desc("importance"), "feature")
    return out.limit(limit) if limit else out


_MODEL = ("tree int, path long, feature int, gain double, threshold double, value double, "
          "rows long, family string, base double, rate double, features int")


def save_model(model: TreeModel, path: str, spark=None) -> None:
    """One row a node; the model's own fields on every row."""
    from pyspark.sql import SparkSession
    spark = spark or SparkSession.getActiveSession()
    sizes = [len(t["path"]) for t in model.trees]
    n = sum(sizes)
    columns = {"tree": np.repeat(np.arange(len(sizes), dtype=np.int32), sizes),
               **{k: np.concatenate([t[k] for t in model.trees])
                  for k in ("path", "feature", "gain", "threshold", "value", "rows")},
               "family": pa.repeat(model.family, n), "base": pa.repeat(float(model.base), n),
               "rate": pa.repeat(float(model.rate), n),
               "features": pa.repeat(pa.scalar(model.features, pa.int32()), n)}
    # An Arrow table: no Python object a value, whatever the session's settings.
    spark.createDataFrame(pa.table(columns), _MODEL).coalesce(1).write.mode(
        "overwrite").parquet(path)


def load_model(family: str, path: str, spark=None) -> TreeModel:
    """S10."""
    from pyspark.sql import SparkSession
    spark = spark or SparkSession.getActiveSession()
    df = spark.read.parquet(path).toArrow().to_pandas().sort_values(["tree", "path"])
    if not (df["family"] == family).all():
        raise ValueError(f"{path} holds no {family}")
    trees = []
    for _, t in df.groupby("tree"):
        own = {k: t[k].to_numpy() for k in ("path", "feature", "gain", "threshold", "value",
                                            "rows")}
        at = {p: i for i, p in enumerate(own["path"].tolist())}
        inner = own["feature"] >= 0
        for side, k in (("left", 0), ("right", 1)):
            own[side] = np.array([at[2 * p + k] if f else 0
                                  for p, f in zip(own["path"].tolist(), inner)], np.int32)
        trees.append(own)
    first = df.iloc[0]
    return TreeModel(family, float(first["base"]), float(first["rate"]), trees,
                     int(first["features"]))


def learning_curve(vec: DataFrame, family: str, label: str, params: dict | None = None,
                   sizes: Sequence[float] = SP.TRAIN_SIZES, k: int = 5, seed: int = SEED,
                   scoring: str = "r2") -> DataFrame:
    """M23 + A23: for each train size and fold, fit on that share of the other
    folds (nested hash subsets, whose sizes are approximate), score train and validation rows (r2, or
    negative mse), then mean and population std over folds per size.

    No row is copied per fit: each carries a mask of the fits it trains. As many
    fits as ``MODEL_NODES`` allows grow in the same rounds and are scored in one
    scan; then their trees are dropped, so the driver never holds all of them."""
    from assayline.operators import metrics as M
    spark = vec.sparkSession
    jobs = [(i, float(frac), f) for i, frac in enumerate(sizes) for f in range(k)]
    sub = SP.split_bucket(seed + 1)

    def trains(frac: float, fold: int) -> F.Column:
        return (F.col("fold") != fold) & (sub < F.lit(int(round(frac * 10000))))

    masks = [F.when(trains(frac, f), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long")
             for bit, (_, frac, f) in enumerate(jobs)]
    mask = masks[0]
    for m in masks[1:]:
        mask = mask.bitwiseOR(m)
    data = store(SP.assign_folds(vec, k, seed).withColumn("_mask", mask), "folds")
    binned = TrainData(data, [label], mask=F.col("_mask"))
    expr = M.r2_expr if scoring == "r2" else (lambda y, p: -M.mse_expr(y, p))
    tp = estimator(family, label, params)[0]
    step = max(1, MODEL_NODES // (2 * tp.trees * tp.most_leaves()))
    rows = []
    for lo in range(0, len(jobs), step):
        now = range(lo, min(lo + step, len(jobs)))
        fitted = binned.fits([(family, label, params, bit) for bit in now], seed)
        have = [(bit, m, jobs[bit]) for bit, (m, _) in zip(now, fitted) if m is not None]
        if not have:
            continue
        pred = data.select("fold", "_mask", F.col(label).cast("double").alias("y"),
                           scores([m for _, m, _ in have]).alias("ps"))
        aggs = []
        for at, (bit, _, (_, _, f)) in enumerate(have):
            for kind, own in (("train", F.col("_mask").bitwiseAND(F.lit(1 << bit)) != 0),
                              ("val", F.col("fold") == f)):
                pred = pred.withColumns({f"y_{kind}_{bit}": F.when(own, F.col("y")),
                                         f"p_{kind}_{bit}": F.when(own, F.col("ps")[at])})
                aggs.append(expr(f"y_{kind}_{bit}", f"p_{kind}_{bit}").alias(f"{kind}_{bit}"))
        got = pred.agg(*aggs).first()
        rows += [(i, frac, f, kind, got[f"{kind}_{bit}"]) for bit, _, (i, frac, f) in have
                 for kind in ("train", "val")]
    scored = spark.createDataFrame(rows, "size_index int, fraction double, fold int, kind string, "
                                         "score double")
    return M.learning_curve_summary(scored)
