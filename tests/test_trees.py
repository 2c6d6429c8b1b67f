"""The distributed tree learner against one tree grown by hand, whatever the
rows' layout and whichever nodes are finished in a group."""

import heapq

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from assayline.operators import models as MD
from assayline.operators import trees as TR


def _rows(spark, n=600, seed=1, parts=4):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)), 1)
    y = np.floor(3 * x[:, 0] + 2 * (x[:, 1] > 0.3) * x[:, 2] + rng.normal(size=n))
    rows = [(f"v{i}", [float(v) for v in r], float(t), float(t * 2 + r[3]))
            for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id string, x array<double>, y1 double, y2 double")
    return df.select("id", array_to_vector("x").alias("features"), "y1",
                     F.when(F.col("id") != "v3", F.col("y2")).alias("y2")).repartition(parts)


@pytest.fixture(scope="module")
def table(spark):
    """The rows and their bins, shared by the tests."""
    from assayline.session import store
    df = store(_rows(spark), "rows")
    return df, MD.TrainData(df, ["y1", "y2"], bins=16)


def _splits(model, tree=0):
    t = model.trees[tree]
    return {int(p): (int(f), float(c), round(float(v), 9), int(n)) for p, f, c, v, n in
            zip(t["path"], t["feature"], t["threshold"], t["value"], t["rows"])}


def _by_hand(x, y, edges, p: TR.TreeParams, scale):
    """One boosted tree on all rows: {path: (feature, threshold, value, rows)}."""
    base = y.mean()
    g = np.rint((base - y) * scale)
    soft = lambda v: np.sign(v) * max(abs(v) - p.l1, 0)
    s = lambda v: soft(v.sum() / scale) ** 2 / (len(v) + p.l2)
    rows = {1: np.arange(len(y))}
    out, queue = {}, []

    def meet(path):
        r = rows[path]
        best = None
        if path.bit_length() - 1 < p.max_depth and len(r) >= p.least_split(len(y)):
            for f, e in enumerate(edges):
                for cut in e:
                    left = x[r, f] <= cut
                    a, b = r[left], r[~left]
                    if min(len(a), len(b)) < max(p.least_leaf(len(y)), p.min_child_weight):
                        continue
                    gain = s(g[a]) + s(g[b]) - s(g[r])
                    if gain >= p.min_gain and gain > 1e-9 and (
                            best is None or gain > best[0] + 1e-9):
                        best = (gain, f, cut, a, b)
        value = -soft(g[r].sum() / scale) / (len(r) + p.l2)
        out[path] = (-1, 0.0, round(float(value), 9), len(r))
        if best:
            heapq.heappush(queue, (-best[0], path, best))

    meet(1)
    leaves = 1
    while queue and leaves < (p.max_leaves or 1 << 30):
        _, path, (_, f, cut, a, b) = heapq.heappop(queue)
        out[path] = (f, float(cut), *out[path][2:])
        rows[2 * path], rows[2 * path + 1] = a, b
        leaves += 1
        meet(2 * path)
        meet(2 * path + 1)
    return out


@pytest.mark.parametrize("family, params", [
    ("gradient_boosting", {"max_depth": 4, "min_samples_leaf": 7, "min_samples_split": 30}),
    ("xgboost", {"max_depth": 5, "reg_lambda": 7.0, "reg_alpha": 3.0, "gamma": 5.0,
                 "min_child_weight": 9}),
    ("lightgbm", {"num_leaves": 9, "min_child_samples": 5, "reg_lambda": 2.0}),
    ("lightgbm", {"num_leaves": 200, "min_child_samples": 3, "max_depth": 6,
                  "min_split_gain": 0.5}),
])
@pytest.mark.parametrize("local_rows", [0, 60, 10 ** 6])
def test_first_tree_equals_one_grown_by_hand(table, monkeypatch, family, params, local_rows):
    monkeypatch.setattr(TR, "LOCAL_ROWS", local_rows)
    df, data = table
    (model, report), = data.fits([(family, "y1", {**params, "n_estimators": 1}, 0)])
    rows = df.collect()
    x = np.array([r["features"].toArray() for r in rows])
    y = np.array([r["y1"] for r in rows])
    tp = MD.estimator(family, "y1", {**params, "n_estimators": 1})[0]
    fit = TR.Fit(0, tp)
    TR.prepare_fits(data.table, [fit])
    want = _by_hand(x, y, data.edges, tp, fit.scale)
    assert _splits(model) == want and len(want) > 8 and report.ignored == []
    if tp.max_leaves:
        assert sum(f < 0 for f, *_ in want.values()) <= tp.max_leaves


def test_models_do_not_depend_on_layout_or_local_nodes(spark, monkeypatch):
    """Forest and boosting, two labels at once, over other partitions, other
    local limits and tiny rounds: the same trees; labels alone give the same."""
    jobs = [("random_forest", "y1", {"n_estimators": 4, "max_features": "log2",
                                     "max_leaf_nodes": 40, "min_samples_leaf": 2}, 0),
            ("xgboost", "y2", {"n_estimators": 12, "max_depth": 3, "subsample": 0.7,
                               "colsample_bytree": 0.6}, 0),
            ("gradient_boosting", "y1", {"n_estimators": 3}, 0)]
    want = None
    for parts, local, hist in ((1, 10 ** 6, 1 << 28), (7, 0, 1 << 28), (3, 50, 1 << 17)):
        monkeypatch.setattr(TR, "LOCAL_ROWS", local)
        monkeypatch.setattr(TR, "HIST_BYTES", hist)
        data = MD.TrainData(_rows(spark, parts=parts), ["y1", "y2"], bins=16)
        fitted = data.fits(jobs)
        got = [[_splits(m, i) for i in range(len(m.trees))] for m, _ in fitted]
        want = want or got
        assert got == want
    turned = MD.TrainData(_rows(spark), ["y2", "y1"], bins=16)
    for (family, label, params, _), trees in zip(jobs, want):
        m, _ = turned.fits([(family, label, params, 0)])[0]
        assert [_splits(m, i) for i in range(len(m.trees))] == trees
    assert [len(t) for t in want] == [4, 12, 3]


def test_parameters_change_the_model(table):
    df, data = table
    plain = {"xgboost": {"n_estimators": 2, "max_depth": 4},
             "lightgbm": {"n_estimators": 2}, "random_forest": {"n_estimators": 2}}
    changes = {"xgboost": {"reg_lambda": 50.0, "reg_alpha": 20.0, "gamma": 100.0,
                           "min_child_weight": 100, "subsample": 0.5, "colsample_bytree": 0.5,
                           "learning_rate": 0.01, "max_depth": 2, "n_estimators": 1},
               "lightgbm": {"num_leaves": 4, "min_child_samples": 100, "min_split_gain": 100.0},
               "random_forest": {"min_samples_split": 0.5, "min_samples_leaf": 50,
                                 "max_leaf_nodes": 5, "max_features": 1.0}}
    jobs = [(f, "y1", {**plain[f], **dict([c])} if c else plain[f], 0)
            for f in plain for c in [None, *changes[f].items()]]
    fitted = data.fits(jobs)
    p = df.select(MD.scores([m for m, _ in fitted]).alias("p")).collect()
    preds = np.array([r["p"] for r in p])
    first = {}
    for k, (family, _, params, _) in enumerate(jobs):
        if params == plain[family]:
            first[family] = k
        else:
            assert not np.allclose(preds[:, k], preds[:, first[family]]), params
    rf = fitted[jobs.index(("random_forest", "y1", {**plain["random_forest"],
                                                    "max_leaf_nodes": 5}, 0))][0]
    assert all((t["feature"] < 0).sum() <= 5 for t in rf.trees)


def test_saved_model_scores_alike(spark, tmp_path):
    df = _rows(spark)
    for family in ("random_forest", "xgboost"):
        model, _ = MD.fit(df, family, "y1", {"n_estimators": 3, "max_depth": 5})
        MD.save_model(model, f"{tmp_path}/{family}")
        again = MD.load_model(family, f"{tmp_path}/{family}")
        both = MD.predict(again, MD.predict(model, df), "q")
        assert both.where("p <> q or p is null").count() == 0
        assert again.importances() == pytest.approx(model.importances())
        assert model.importances().sum() == pytest.approx(1)
    with pytest.raises(ValueError):
        MD.load_model("lightgbm", f"{tmp_path}/xgboost")


def test_learning_curve_equals_separate_fits(spark):
    """Masked fits in shared rounds score as fits on filtered rows do, when the
    bins are the same."""
    from assayline.operators import split as SP
    df = _rows(spark).select("features", "y1", F.col("id").alias("visit_id"),
                             F.lit("u").alias("UniProt"), F.lit("p").alias("Peptide"))
    params = {"n_estimators": 3, "max_depth": 3}
    got = {(r["fraction"], r["kind"]): r for r in MD.learning_curve(
        df, "gradient_boosting", "y1", params, sizes=(0.5, 1.0), k=3).collect()}
    assert len(got) == 4
    data = SP.assign_folds(df, 3, MD.SEED)
    edges = TR.bin_edges(df)
    for frac in (0.5, 1.0):
        scores = {"train": [], "val": []}
        for fold in range(3):
            train = data.where((F.col("fold") != fold)
                               & (SP.split_bucket(MD.SEED + 1) < int(frac * 10000)))
            own = MD.TrainData.__new__(MD.TrainData)
            own.targets, own.bins, own.edges = ["y1"], TR.BINS, edges
            own.table = TR.training_table(train, ["y1"], edges)
            model, _ = own.fits([("gradient_boosting", "y1", params, 0)])[0]
            for kind, part in (("train", train), ("val", data.where(F.col("fold") == fold))):
                pred = np.array([(r["y1"], r["p"]) for r in
                                 MD.predict(model, part).select("y1", "p").collect()])
                sse = ((pred[:, 0] - pred[:, 1]) ** 2).sum()
                scores[kind].append(1 - sse / ((pred[:, 0] - pred[:, 0].mean()) ** 2).sum())
        for kind in scores:
            assert got[(frac, kind)]["score_mean"] == pytest.approx(np.mean(scores[kind]), rel=1e-9)
            assert got[(frac, kind)]["score_std"] == pytest.approx(np.std(scores[kind]), abs=1e-9)


def test_labels_without_rows_and_constant_labels(spark):
    df = _rows(spark, 50).withColumn("none", F.lit(None).cast("double")).withColumn(
        "same", F.lit(4.0))
    (a, _), (b, _) = MD.TrainData(df, ["none", "same"]).fits(
        [("xgboost", "none", None, 0), ("random_forest", "same", {"n_estimators": 2}, 0)])
    assert a is None and b.total_nodes == 2
    assert {r["p"] for r in MD.predict(b, df).collect()} == {4.0}
    assert MD.fit(df.where("false"), "xgboost", "y1")[0] is None


def test_driver_keeps_few_nodes_of_a_large_forest(spark, monkeypatch):
    """Groups make their share of a leaf-limited tree and trees grow in groups:
    the driver meets far fewer nodes than the rows could give, and the forest is
    the one that grows at once in a single group."""
    jobs = [("random_forest", "y1", {"n_estimators": 6, "max_leaf_nodes": 12,
                                     "min_samples_leaf": 1, "min_samples_split": 2,
                                     "max_features": "log2"}, 0)]
    data = MD.TrainData(_rows(spark, n=1500), ["y1"], bins=16)
    monkeypatch.setattr(TR, "LOCAL_ROWS", 10 ** 6)
    want = [_splits(data.fits(jobs)[0][0], i) for i in range(6)]
    most, asked, grow, finish = [], [], TR.grow, TR._finish_job

    def grown(table, fits, trees, *args):
        asked.append(len(trees))
        grow(table, fits, trees, *args)

    def finished(table, fits, wanted, bins):
        finish(table, fits, wanted, bins)
        most.append(sum(len(t.nodes) for t in {id(t): t for t, _ in wanted}.values()))

    monkeypatch.setattr(TR, "grow", grown)
    monkeypatch.setattr(TR, "_finish_job", finished)
    monkeypatch.setattr(TR, "LOCAL_ROWS", 120)
    monkeypatch.setattr(TR, "LOCAL_SPLITS", 1)
    monkeypatch.setattr(TR, "OPEN_NODES", 200)
    model = data.fits(jobs)[0][0]
    assert [_splits(model, i) for i in range(6)] == want
    assert asked == [2, 2, 2] and max(most) <= 400


def test_learning_curve_drops_scored_models(spark, monkeypatch):
    """Fits scored a few at a time give the curve of all at once."""
    df = _rows(spark, 300).select("features", "y1", F.col("id").alias("visit_id"),
                                  F.lit("u").alias("UniProt"), F.lit("p").alias("Peptide"))
    params = {"n_estimators": 2, "max_depth": 3, "max_leaf_nodes": 6}
    curve = [MD.learning_curve(df, "random_forest", "y1", params, sizes=(0.5, 1.0), k=2).collect()]
    held, scores = [], MD.scores
    monkeypatch.setattr(MD, "scores", lambda m: held.append(len(m)) or scores(m))
    monkeypatch.setattr(MD, "MODEL_NODES", 2 * 2 * 2 * 6)
    curve.append(MD.learning_curve(df, "random_forest", "y1", params, sizes=(0.5, 1.0),
                                   k=2).collect())
    assert curve[0] == curve[1] and held == [2, 2]


def test_assign_follows_every_row(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 16, (500, 4)).astype(np.uint8)
    t = {"feature": np.array([1, -1, 3, 0, -1, -1, -1]), "bin": np.array([3, 0, 12, 7, 0, 0, 0]),
         "left": np.array([1, 0, 3, 5, 0, 0, 0]), "right": np.array([2, 0, 4, 6, 0, 0, 0])}
    want = []
    for r in x:
        n = 0
        while t["feature"][n] >= 0:
            n = t["right" if r[t["feature"][n]] > t["bin"][n] else "left"][n]
        want.append(n)
    assert TR.assign(x, t).tolist() == want
    assert TR.assign(np.empty((0, 0), np.uint8), t).tolist() == []


def _random_tree(rng, leaves, features=4, bins=16):
    """Arrays of a tree that splits a random leaf until it has ``leaves``."""
    t = {"feature": [-1], "bin": [0], "left": [0], "right": [0]}
    while sum(f < 0 for f in t["feature"]) < leaves:
        n = rng.choice(np.flatnonzero(np.array(t["feature"]) < 0))
        k = len(t["feature"])
        t["feature"][n], t["bin"][n] = int(rng.integers(features)), int(rng.integers(bins))
        t["left"][n], t["right"][n] = k, k + 1
        for c, v in (("feature", -1), ("bin", 0), ("left", 0), ("right", 0)):
            t[c] += [v, v]
    return {c: np.array(v) for c, v in t.items()}


@pytest.mark.parametrize("leaves", [2, 3, 31, 63, 64, 65, 200])
def test_assign_by_look_up_ends_where_a_walk_does(leaves):
    """Few leaves are found by one look-up a feature, wherever the walk would
    end; trees of more leaves are walked."""
    rng = np.random.default_rng(leaves)
    x = rng.integers(0, 16, (700, 4)).astype(np.uint8)
    t = _random_tree(rng, leaves)
    walked = TR.assign(x.astype(np.int64), t)  # only bins are looked up
    assert TR.assign(x, t).tolist() == walked.tolist()
    assert len(np.unique(walked)) > 1
    if leaves <= 64:
        assert TR._assign_few(x, t, t["feature"] >= 0).tolist() == walked.tolist()


def test_rows_are_stored_in_blocks(spark, table, monkeypatch):
    """A pass over the table reads blocks, not rows: no row, label or bin is lost
    in packing them, a missing label stays missing, and joined blocks are whole."""
    df, data = table
    n = df.count()
    assert data.table.count() < n / 50
    rid, mask, x, y, margin = (np.concatenate(c) for c in zip(
        *TR._chunks(data.table.toArrow().to_batches())))
    assert len(rid) == len(np.unique(rid)) == n and mask.tolist() == [1] * n
    assert x.shape == (n, 4) and margin.shape == (n, 0)
    rows = df.collect()
    want = TR.to_bins(np.array([r["features"].toArray() for r in rows]), data.edges)
    labels = [(r["y1"], r["y2"]) for r in rows]
    assert sorted(map(str, zip(x.tolist(), y[:, 0].tolist()))) == sorted(
        map(str, zip(want.tolist(), [a for a, _ in labels])))
    assert np.isnan(y[:, 1]).sum() == sum(b is None for _, b in labels) == 1
    monkeypatch.setattr(TR, "BLOCK_ROWS", 7)
    monkeypatch.setattr(TR, "CHUNK_ROWS", 50)
    packed = TR._packed(rid, mask, x, y, margin)
    assert packed.num_rows == -(-n // 7)
    parts = list(TR._chunks([packed.slice(0, 40), packed.slice(40)]))
    assert {len(p[0]) for p in parts[:-1]} == {56}
    assert np.concatenate([p[0] for p in parts]).tolist() == rid.tolist()
    assert np.concatenate([p[2] for p in parts]).tolist() == x.tolist()


def test_driver_drops_what_its_rounds_sent(table, monkeypatch):
    """Every round's broadcast is destroyed, on the driver too, and models go to
    the tasks as a broadcast, not pickled in the function."""
    from pyspark import SparkContext
    from pyspark.core.broadcast import Broadcast
    from pyspark.serializers import CloudPickleSerializer
    df, data = table
    sent, ended, dumped = [], [], []
    send, end, dumps = SparkContext.broadcast, Broadcast.destroy, CloudPickleSerializer.dumps
    monkeypatch.setattr(SparkContext, "broadcast",
                        lambda self, v: sent.append(send(self, v)) or sent[-1])
    monkeypatch.setattr(Broadcast, "destroy",
                        lambda self, *a: ended.append(self) or end(self, *a))
    monkeypatch.setattr(TR, "LOCAL_ROWS", 60)
    (model, _), = data.fits([("xgboost", "y1", {"n_estimators": 11, "max_depth": 4}, 0)])
    assert len(sent) > 11 and {id(b) for b in sent} == {id(b) for b in ended}
    big = dict(model.trees[0])
    spare = 200_000  # nodes that no row reaches
    for k in big:
        big[k] = np.concatenate([big[k], np.zeros(spare, big[k].dtype)])
    big["feature"][-spare:] = -1
    model.trees = [big, *model.trees[1:]]

    def watched(self, obj):
        dumped.append(len(out := dumps(self, obj)))
        return out

    monkeypatch.setattr(CloudPickleSerializer, "dumps", watched)
    assert MD.predict(model, df).where("p is null").count() == 0
    assert dumped and max(dumped) < 1_000_000


def test_sums_of_rows_are_exact_in_pieces(monkeypatch):
    """Rows and weights that share a number, rows picked by place, and pieces
    give the sums of a plain loop; row weights are the quantiles of Poisson(1)."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 8, (400, 5)).astype(np.uint8)
    at = np.sort(rng.choice(400, 300, replace=False))
    slot, drawn = rng.integers(0, 3, 300), np.array([[0, 2], [0, 4], [0, 1]])
    w, g = rng.integers(1, 12, 300), np.rint(rng.normal(0, 2 ** 28, 300))
    for weight in (w, np.ones(300, np.int64)):
        want = np.zeros((3, 2, 8, 3), np.int64)
        for r, s, v, d in zip(at, slot, weight, g):
            for j, f in enumerate(drawn[s]):
                want[s, j, x[r, f]] += (1, v, v * int(d))
        for pack in (TR._PACK, 16 * 7):
            monkeypatch.setattr(TR, "_PACK", pack)
            got = np.zeros_like(want)
            if pack == 16 * 7:  # pieces of 7 rows: 77 at most in weight
                assert weight.max() * 7 < pack
            TR.add_sums(got, x, slot, drawn, *TR.row_sums(weight, g), at)
            assert np.array_equal(got, want)
    rid = rng.integers(0, 2 ** 63, 200_000).astype(np.uint64)
    want = np.searchsorted(TR._POISSON, TR._uniform(rid, 42, 7, 1), side="right")
    assert np.array_equal(TR.row_weights(rid, TR.TreeParams(), 42, 7), want)


@pytest.mark.parametrize("features", [None, "log2"])
def test_trees_over_rows_in_memory_add_up_the_smaller_child(monkeypatch, features):
    """A node's sums from its sibling's give the tree that all sums give, with
    fewer rows added up; where nodes draw features nothing is taken over."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 16, (3000, 4)).astype(np.uint8)
    g = np.rint((x[:, 0] * 3.0 - x[:, 1] + rng.normal(0, 4, 3000)) * 2 ** 10)
    fit = TR.Fit(0, TR.TreeParams(max_depth=6, node_features=features), total=3000, scale=2.0 ** 10)
    added, add = [], TR.add_sums
    monkeypatch.setattr(TR, "add_sums", lambda out, x, slot, *a: added.append(len(slot))
                        or add(out, x, slot, *a))
    trees, work = [], []
    for space in (TR.HIST_BYTES, 0):  # no space: one node at a time, nothing kept
        monkeypatch.setattr(TR, "HIST_BYTES", space)
        t = TR.Tree(fit, 0, 4)
        TR.grow_here(x, np.ones(3000, np.int64), g, t, 16)
        trees.append(t.nodes)
        work.append(sum(added))
        added.clear()
    assert trees[0] == trees[1] and len(trees[0]) > 60
    assert work[0] < 0.75 * work[1] if features is None else work[0] == work[1]


def test_groups_are_dealt_by_their_rows():
    got = TR.deal(["a", "b", "c", "d", "e"], [5, 9, 5, 1, 4], 2)
    assert sorted(got) == list("abcde") and got["b"] != got["a"] == got["c"]
    load = [sum(n for g, n in zip("abcde", [5, 9, 5, 1, 4]) if got[g] == k) for k in (0, 1)]
    assert max(load) == 13 or max(load) == 14
