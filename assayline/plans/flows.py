"""Fixed compositions: clean (L1), features (L2), features_patient (L3),
prepare (L4/L5). Each is lazy up to the bounds' size checks."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F_

from assayline.operators import clean as C
from assayline.operators import features as F
from assayline.operators import scale as SC
from assayline.operators import split as SP
from assayline.operators import outliers as O
from assayline.session import store
from assayline.tables import AssayTables, DEFAULT_MONTH, TARGETS


def joined_month(tables: AssayTables, month: int = DEFAULT_MONTH) -> DataFrame:
    """P1 x3, J1, J2."""
    return C.join_tables(C.filter_tables(tables, month))


def deduped_non_null(tables: AssayTables, month: int = DEFAULT_MONTH) -> DataFrame:
    """P1 x3, J1, J2, U1, P9/P10 (helper column kept, all zero)."""
    return C.drop_null_rows(C.drop_duplicates(joined_month(tables, month)))


def clean(tables: AssayTables, month: int = DEFAULT_MONTH,
          keep_visit_keys: bool = False) -> DataFrame:
    """L1: P1 x3, J1, J2, U1, P10, P12, F1, P12, P14, P4, P2, P5.

    The null-dropped month table feeds several bound aggregates, so it is
    stored once instead of re-running the joins for each bound.
    ``keep_visit_keys`` delays P5 so a split key can use visit_id."""
    base = store(deduped_non_null(tables, month), "month")
    # Both IQR passes' fences from one pass over the month table (the second
    # pass's quartiles follow from the first pass's bracketing order statistics).
    first, second = O.iqr_fence_chain(base, O.MEASURES, passes=2)
    df = O.apply_clip(base, first)
    df = O.add_log_columns(df)
    df = O.apply_clip(df, second)
    df = O.null_outliers_sigma(df)
    df = C.drop_medication(C.drop_null_count(df))
    return df if keep_visit_keys else C.drop_visit_keys(df)


def features(tables: AssayTables, month: int = DEFAULT_MONTH, keep_visit_keys: bool = False,
             **options) -> DataFrame:
    """L1 then L2: the 45-column month feature table (visit keys optional)."""
    return F.build_features(clean(tables, month, keep_visit_keys=keep_visit_keys), **options)


def prepare(tables: AssayTables, month: int = DEFAULT_MONTH, scheme: str = "80_20",
            seed: int = 42, by_patient: bool = False, scale: str = "minmax") -> DataFrame:
    """L1, L2, split, scaling fitted on train rows. One table serves all
    four targets (P16 is a projection of it): keys, split, four labels and
    the 41 scaled features."""
    feat = F.build_features(clean(tables, month, keep_visit_keys=True), drop_ids=False)
    feat = SP.assign_split(feat, scheme, seed, by_patient=by_patient)
    # Stored once: the scaler fit and the scaled projection (and then every
    # target) read it instead of re-running the rank joins.
    feat = store(feat.drop("patient_id", "PeptideAbundance", "NPX"), "features")
    feats = model_features(feat.columns)
    if scale == "minmax":
        return SC.minmax_scale(feat, feats)
    if scale == "standard":
        passthrough = SP.statistic_columns(feats)
        scaled = [c for c in feats if c not in passthrough]
        return SC.standard_scale_passthrough(feat, scaled, passthrough,
                                             keep=[*ID_COLS, "split", *TARGETS])
    return feat


ID_COLS = ("visit_id", "visit_month", "UniProt", "Peptide")


def model_features(columns) -> list:
    """The 41 feature columns: everything but identifiers, split and labels."""
    skip = set(ID_COLS) | {"split", "fold", "patient_id", *TARGETS}
    return [c for c in columns if c not in skip]


# Model flows (L4, L6-L9) ----------------------------------------------------------------
def prepared_vectors(tables: AssayTables, month: int = DEFAULT_MONTH, scheme: str = "80_20",
                     seed: int = 42, drop_constant: bool = True):
    """L4: (prepared month table with its features as one vector, their names).

    Features that are constant on the train rows (most statistic columns are
    one value per month) are left out unless ``drop_constant`` is off: no tree
    can use them, and a node would only draw past them."""
    from assayline.operators import models as MD
    prep = prepare(tables, month, scheme, seed)
    feats = model_features(prep.columns)
    if drop_constant:
        feats = [r["feature"] for r in SC.minmax_fit(prep, feats).collect()
                 if r["min"] is None or r["min"] != r["max"]]
    return MD.vectorize(prep, feats), feats


def train_family(tables: AssayTables, family: str, month: int = DEFAULT_MONTH,
                 params_by_target: dict | None = None, scheme: str = "80_20", seed: int = 42,
                 save_to: str | None = None, params_folder: str | None = None):
    """Parameters given per target, else those saved in ``params_folder``
    (S7), else defaults; fit (and save) each target."""
    from assayline.operators import models as MD
    vec, feats = prepared_vectors(tables, month, scheme, seed)
    params_by_target = {**saved_params(vec.sparkSession, params_folder, family),
                        **(params_by_target or {})}
    models = MD.fit_all_targets(vec, family, params_by_target, seed=seed)
    if save_to:
        save_models(vec.sparkSession, models, feats, family, save_to)
    return vec, feats, models


def save_models(spark, models: dict, features_used, family: str, folder: str) -> None:
    """Every target's model, and the names of the features they were trained on."""
    from assayline.operators import models as MD
    for t, (m, _) in models.items():
        if m is not None:
            MD.save_model(m, f"{folder}/{family}/{t}", spark)
    names = spark.createDataFrame(list(enumerate(features_used)), "place int, feature string")
    names.coalesce(1).write.mode("overwrite").json(f"{folder}/{family}/features")


def load_models(spark, family: str, folder: str, targets=TARGETS):
    """({target: (model, None)}, feature names) of :func:`save_models`."""
    from assayline.operators import models as MD
    names = spark.read.schema("place int, feature string").json(f"{folder}/{family}/features")
    return ({t: (MD.load_model(family, f"{folder}/{family}/{t}", spark), None) for t in targets},
            [r["feature"] for r in names.orderBy("place").collect()])


def saved_params(spark, folder: str | None, family: str) -> dict:
    """{target: params} of one family from a folder of saved parameters; a
    folder that is not there, or holds none of the family, gives none. At most
    one row a target."""
    from pyspark.errors import AnalysisException
    from assayline.sources import files as FS
    if folder is None:
        return {}
    try:
        rows = FS.read_params(spark, folder).where(F_.col("family") == family).collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return {}
    return {r["target"]: dict(r["params"]) for r in rows}


def month_table(reports: dict) -> DataFrame:
    """Month reports (month -> (target, smape)) stacked under their month label."""
    out = None
    for month, df in reports.items():
        part = df.select(F_.lit(f"month_{month}").alias("month"), "target", "smape")
        out = part if out is None else out.unionByName(part)
    return out


def month_report(tables: AssayTables, family: str, month: int = DEFAULT_MONTH,
                 models: dict | None = None, params_by_target: dict | None = None,
                 seed: int = 42, features_used=None) -> DataFrame:
    """Three tables and a month -> SMAPE per target on test rows, plus
    the mean. Scores saved ``models`` (trained on ``features_used``) when given,
    else refits (60/20/20 split)."""
    from assayline.operators import metrics as M
    from assayline.operators import models as MD
    if models is not None and features_used is not None:
        vec = MD.vectorize(prepare(tables, month, "60_20_20", seed), features_used)
    else:
        vec, _ = prepared_vectors(tables, month, "60_20_20", seed)
    if models is None:
        models = MD.fit_all_targets(vec, family, params_by_target, seed=seed)
    pred = MD.long_predictions(vec, models, datasets=["test"])
    ev = M.evaluate(pred, by=["target"], metrics=["smape"])
    mean = ev.agg(F_.avg("smape").alias("smape")).withColumn("target", F_.lit("mean"))
    return ev.unionByName(mean.select("target", "smape"))


def report_from_files(spark, clinical: str, proteins: str, peptides: str, family: str,
                      month: int = DEFAULT_MONTH, params_folder: str | None = None,
                      models_folder: str | None = None, seed: int = 42) -> DataFrame:
    """L7 as a caller meets it (S3, S4, S7, S10): three CSV files, a family and
    a month -> SMAPE per target and their mean. The models are those saved in
    ``models_folder``, else refitted with the parameters in ``params_folder``
    ({family}_params_model_{i}.json, one file a target), else with defaults. A
    month out of the list, an unknown family or a missing table or column is a
    ValueError before any work is done."""
    from assayline.operators import models as MD
    from assayline.sources import files as FS
    tables = FS.load_caller_tables(spark, clinical, proteins, peptides)
    problems = FS.validate_inputs(tables, month)
    if family not in MD.FAMILIES:
        problems.append(f"unknown family {family}")
    if problems:
        raise ValueError("; ".join(problems))
    if models_folder is not None:
        models, names = load_models(spark, family, models_folder)
        return month_report(tables, family, month, models, seed=seed, features_used=names)
    params = {}
    if params_folder is not None:
        rows = FS.read_params_json(spark, params_folder).where(F_.col("family") == family)
        params = {r["target"]: dict(r["params"]) for r in rows.collect()}  # four at most
    return month_report(tables, family, month, params_by_target=params, seed=seed)


def unseen_vectors(tables: AssayTables, features_used, month: int, seed: int = 42) -> DataFrame:
    """Another month prepared with its own scaling, its vectors built from the
    columns that models were trained on."""
    from assayline.operators import models as MD
    return MD.vectorize(prepare(tables, month, "80_20", seed), features_used)


def unseen_predictions(tables: AssayTables, models: dict, features_used, month: int,
                       scope: str = "test", seed: int = 42, vec=None) -> DataFrame:
    """:func:`unseen_vectors` (``vec``: made before), scored; ``scope`` 'test'
    (published) or 'all'."""
    from assayline.operators import models as MD
    if vec is None:
        vec = unseen_vectors(tables, features_used, month, seed)
    return MD.long_predictions(vec, models, datasets=None if scope == "all" else ["test"])


def evaluate_unseen_month(tables: AssayTables, models: dict, features_used, month: int,
                          scope: str = "test", seed: int = 42) -> DataFrame:
    """Metrics of :func:`unseen_predictions`."""
    from assayline.operators import metrics as M
    pred = unseen_predictions(tables, models, features_used, month, scope, seed)
    return M.evaluate(pred.withColumn("dataset", F_.lit(f"month_{month}")))


def tune_family(tables: AssayTables, family: str, month: int = DEFAULT_MONTH,
                n_trials: int = 5, targets=TARGETS, seed: int = 42, vec=None,
                trials_folder: str | None = None, run: str = "run_1"):
    """Adaptive search on val, refit on train + val; returns
    (models, best-parameter table, trial table). With ``trials_folder`` every
    trial is stored as it ends, and a search of the same run that was cut off
    goes on from its stored trials."""
    from assayline.operators import models as MD
    from assayline.operators import tuning as TU
    from assayline.sources import files as FS
    spark = tables.peptides.sparkSession
    if vec is None:
        vec, _ = prepared_vectors(tables, month, "64_16_20", seed)
    trials = TU.sample_trials(spark, family, n_trials, seed)

    @functools.cache
    def binned(*splits):  # once for all targets
        return MD.TrainData(vec.where(F_.col("split").isin(*splits)), targets)

    models, tables_, best_rows = {}, [], []
    for t in targets:
        done, commit = (), None
        if trials_folder is not None:
            done = FS.committed_trials(spark, trials_folder, run, family, t)

            def commit(trial, t=t):
                FS.commit_trial(TU.trial_table(spark, family, t, [trial]), trials_folder, run)

        hist = TU.run_trials(vec, family, t, trials, seed=seed, done=done, commit=commit,
                             binned=functools.partial(binned, "train"))
        tables_.append(TU.trial_table(spark, family, t, hist))
        best = TU.best_of(hist)
        if best is not None:
            models[t] = TU.refit_best(vec, family, t, best[1], seed, binned("train", "val"))
            best_rows.append((family, t, {k: float(v) for k, v in best[1].items()}))
    trial_df = tables_[0]
    for x in tables_[1:]:
        trial_df = trial_df.unionByName(x)
    best_df = spark.createDataFrame(best_rows, "family string, target string, "
                                               "params map<string,double>")
    return models, best_df, trial_df
