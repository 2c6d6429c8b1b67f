"""Histogram trees grown by Spark aggregates: the learners of M11-M14.

Rows are binned once (quantile bins, one byte a feature) and stored. A tree is
grown in rounds; in a round every task assigns its rows to the open nodes of
all trees, adds up (rows, weight, gradient) per (tree, node, feature, bin) and
emits these sums; one shuffle by node combines them and yields each node's best
split, and only that split reaches the driver. Trees of a forest, targets and
fits of a learning curve grow in the same rounds. Sums are integers (gradients
in fixed point), so no result depends on partitions or order.

Small nodes are finished where their rows meet: a node of at most ``LOCAL_ROWS``
rows (``LOCAL_MORE`` times as many where the trees of a round make groups enough)
sends them to one group, and the same code grows its subtree there (the
in-memory step of Panda et al., PLANET, 2009). Which nodes go that way never
changes a tree. Under a leaf limit a group grows its share of the leaves, best
first, and goes on in a later round where the queue asks for more; so the driver
holds a few times the leaves that a tree may have, however many rows there are,
and of a forest only ``OPEN_NODES`` nodes are open at once.

Split of a node: the largest gain S(GL, HL) + S(GR, HR) - S(G, H) with
S = soft(G, l1)^2 / (H + l2), ties to the smaller feature number, then the
smaller bin; value of a leaf: -soft(G, l1) / (H + l2) (Chen and Guestrin,
2016). With l1 = l2 = 0 this is the variance reduction and the mean, as in
forests and plain gradient boosting.

Limits: ``max_leaves`` grows best first. The gain of a node does not depend on
the order in which nodes are opened, so rounds open every node that the queue,
replayed over the gains known so far, would split, until a replay opens none.
``node_features`` draws features per node by a seeded order and goes on in that
order while those drawn give no split. ``min_split`` and ``min_leaf`` count
rows (shares of the fit's rows up to 1, and below 1), ``min_child_weight``
weights.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.session import store

#: A node of at most so many rows is finished in one group; tests lower it.
LOCAL_ROWS = 65_536
#: So many times as many, as long as there are trees and groups for all cores.
LOCAL_MORE = 16
#: Splits that a group makes of a node at least, under a leaf limit.
LOCAL_SPLITS = 8
#: Nodes that the driver keeps of the trees it is growing; finished ones are arrays.
OPEN_NODES = 300_000
#: Bytes of the sums that one task holds in a round.
HIST_BYTES = 256 << 20
BINS = 64
#: Edges lie this share of a quantile above it.
EDGE = 1e-9
#: Trees after which a boosting fit's margins are stored.
STORE_EVERY = 10
#: Deepest node (paths are numbers of 62 bits).
DEEPEST = 60
UNKNOWN, LEAF = -2, -1
_POISSON = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(12)])
#: Poisson(1) quantile of each range of 2**-16, and the ranges that hold a step.
_RANGES = np.arange(1 << 16) * 2.0 ** -16
_DRAWS = np.searchsorted(_POISSON, _RANGES, side="right").astype(np.uint8)
_STEPS = np.searchsorted(_POISSON, _RANGES + 2.0 ** -16, side="right") != _DRAWS
#: Counts of rows share a float with those of weights, up to so many rows.
_PACK = 1 << 25


@dataclass(frozen=True)
class TreeParams:
    trees: int = 100
    max_depth: int = DEEPEST
    max_leaves: int | None = None
    min_split: float = 2
    min_leaf: float = 1
    min_child_weight: float = 0.0
    l1: float = 0.0
    l2: float = 0.0
    min_gain: float = 0.0
    rate: float = 1.0
    row_rate: float = 1.0
    column_rate: float = 1.0
    node_features: str | float | int | None = None
    boosted: bool = False

    def least_leaf(self, total: int) -> int:
        return max(1, math.ceil(self.min_leaf * total) if self.min_leaf < 1 else int(self.min_leaf))

    def least_split(self, total: int) -> int:
        n = self.min_split
        return max(2, math.ceil(n * total) if n <= 1 else int(n))

    def most_leaves(self, total: int | None = None) -> int:
        """A bound of the leaves of a tree (over ``total`` rows)."""
        return min(self.max_leaves or (1 << 62), 1 << min(self.max_depth, DEEPEST),
                   (1 << 62) if total is None else max(1, total // self.least_leaf(total)))

    def drawn(self, features: int) -> int:
        """Features drawn per node."""
        m = self.node_features
        if m is None:
            return features
        if isinstance(m, str):
            n = {"log2": math.log2(features), "sqrt": math.sqrt(features),
                 "all": features, "auto": features}.get(m)
            n = float(m) * features if n is None else n
        else:
            n = m * features if isinstance(m, float) and m <= 1 else m
        return max(1, min(features, int(n)))


@dataclass
class Fit:
    """One model to grow: the label's place among the targets and the bit of
    the rows' mask that says which rows train it."""
    target: int
    params: TreeParams
    seed: int = 42
    bit: int = 0
    base: float = 0.0
    scale: float = 1.0
    total: int = 0
    trees: list = field(default_factory=list)   # finished trees
    margin: int = 0                             # trees that the stored margins hold


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser on uint64."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        return x


def _hash(ids: np.ndarray, *salts: int) -> np.ndarray:
    h = ids.astype(np.uint64, copy=False)
    for s in salts:
        with np.errstate(over="ignore"):
            h = _mix(h + np.uint64((s * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64)))
    return h


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


def _uniform(ids: np.ndarray, *salts: int) -> np.ndarray:
    return _unit(_hash(ids, *salts))


def row_weights(rid: np.ndarray, p: TreeParams, seed: int, tree: int) -> np.ndarray:
    """Weight of each row in a tree: Poisson(1) bagging for a forest, 0 or 1 by
    ``row_rate`` for boosting."""
    if not p.boosted:
        h = _hash(rid, seed, tree, 1)
        at = (h >> np.uint64(48)).astype(np.int64)
        w, steps = _DRAWS[at], np.flatnonzero(_STEPS[at])
        w[steps] = np.searchsorted(_POISSON, _unit(h[steps]), side="right")
        return w
    if p.row_rate >= 1:
        return np.ones(len(rid), np.int64)
    return (_uniform(rid, seed, tree, 2) < p.row_rate).astype(np.int64)


def tree_features(features: int, p: TreeParams, seed: int, tree: int) -> np.ndarray:
    """Features that a tree may use."""
    every = np.arange(features)
    if p.column_rate >= 1:
        return every
    keep = max(1, int(p.column_rate * features))
    return np.sort(np.argsort(_uniform(every, seed, tree, 3), kind="stable")[:keep])


def feature_orders(own: np.ndarray, paths: np.ndarray, m: int, seed: int,
                   tree: int) -> np.ndarray:
    """Per path the order in which the node tries the tree's features ``own``;
    without a draw (``m`` of them at once) their own order."""
    if m >= len(own):
        return np.tile(own, (len(paths), 1))
    # One id a (path, feature).
    ids = paths.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    u = _uniform(_mix(ids + own.astype(np.uint64)[None, :]), seed, tree, 4)
    return own[np.argsort(u, axis=1, kind="stable")]


def _soft(g, l1: float):
    if l1 == 0:
        return g
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def score(g, h, p: TreeParams):
    d = h + p.l2
    return np.where(d > 0, _soft(g, p.l1) ** 2 / np.where(d > 0, d, 1.0), 0.0)


def leaf_values(g: np.ndarray, h: np.ndarray, p: TreeParams) -> np.ndarray:
    d = h + p.l2
    return np.where(d > 0, -_soft(g, p.l1) / np.where(d > 0, d, 1.0), 0.0)


# Sums and splits -------------------------------------------------------------------------
def row_sums(w: np.ndarray, g: np.ndarray) -> tuple:
    """What :func:`add_sums` adds of each row: rows and weight in one number
    (None where all weights are 1), and the weighted gradient."""
    if (w == 1).all():
        return None, g
    return 1.0 + w * float(_PACK), w * g


def add_sums(out: np.ndarray, x: np.ndarray, slot: np.ndarray, drawn: np.ndarray,
             both: np.ndarray | None, pull: np.ndarray, at: np.ndarray | None = None) -> None:
    """Adds rows (those ``at`` these places of ``x``) to ``out`` [slot, drawn
    feature, bin, (rows, weight, gradient)]. Float sums of fixed-point numbers
    stay below 2**53, so they are exact."""
    slots, m, bins, _ = out.shape
    if len(slot) > _PACK >> 4:  # rows, and weights of up to 2**31, share 53 bits
        for lo in range(0, len(slot), _PACK >> 4):
            own = slice(lo, lo + (_PACK >> 4))
            add_sums(out, x, slot[own], drawn, None if both is None else both[own], pull[own],
                     np.arange(len(x))[own] if at is None else at[own])
        return
    flat, base = np.ravel(x), slot * bins
    start = (np.arange(len(x)) if at is None else at) * x.shape[1]
    for j in range(m):
        f = drawn[:, j]
        # One feature for all slots, or each slot's own.
        key = flat.take(start + (f[0] if (f == f[0]).all() else f.take(slot))) + base
        if both is None:
            weight = rows = np.bincount(key, None, slots * bins)
        else:
            weight, rows = np.divmod(np.bincount(key, both, slots * bins), _PACK)
        for c, found in enumerate((rows, weight, np.bincount(key, pull, slots * bins))):
            out[:, j, :, c] += found.reshape(slots, bins).astype(np.int64, copy=False)


def best_splits(sums: np.ndarray, drawn: np.ndarray, p: TreeParams, scale: float, total: int):
    """Per slot: feature (LEAF without a valid one), bin, gain, sums of the left
    part and of the node."""
    left = np.cumsum(sums, axis=2)
    node = left[:, :, -1:, :]
    right = node - left
    least = p.least_leaf(total)
    ok = ((left[..., 0] >= least) & (right[..., 0] >= least)
          & (left[..., 1] >= p.min_child_weight) & (right[..., 1] >= p.min_child_weight)
          & (drawn >= 0)[:, :, None])
    s = [score(v[..., 2] / scale, v[..., 1].astype(np.float64), p) for v in (left, right, node)]
    gain = s[0] + s[1] - s[2]
    # Not a gain: what rounding leaves of equal scores.
    real = gain > 1e-10 * (s[0] + s[1] + s[2])
    flat = np.where(ok & real & (gain >= p.min_gain), gain, -np.inf).reshape(len(sums), -1)
    best = flat.argmax(axis=1)
    at = np.arange(len(sums))
    j, b = np.divmod(best, sums.shape[2])
    found = np.isfinite(flat[at, best])
    return (np.where(found, drawn[at, j], LEAF), b, np.where(found, flat[at, best], 0.0),
            left[at, j, b], node[at, -1, 0])


# One tree --------------------------------------------------------------------------------
class Tree:
    """Nodes by path (root 1, children 2 p and 2 p + 1): [rows, weight,
    gradient, feature, bin, gain, features tried]."""

    def __init__(self, fit: Fit, number: int, features: int):
        self.fit, self.number, self.features = fit, number, features
        self.own = tree_features(features, fit.params, fit.seed, number)
        self.root = 1
        self.limit = fit.params.max_leaves or (1 << 62)
        self.nodes: dict = {1: [None, 0, 0, UNKNOWN, 0, 0.0, 0]}

    def open(self, path: int) -> bool:
        """Can this node be split at all?"""
        n, p = self.nodes[path], self.fit.params
        if n[3] != UNKNOWN:
            return False
        if n[0] is None:
            return True
        total = self.fit.total
        if (path.bit_length() - 1 >= min(p.max_depth, DEEPEST) or n[0] < 2 * p.least_leaf(total)
                or n[0] < p.least_split(total)):
            n[3] = LEAF
            return False
        return True

    def replay(self) -> tuple[list, list]:
        """(paths that split, open paths whose split is still unknown) of the
        best-first queue over the gains known so far."""
        split, unknown, queue = [], [], []

        def meet(path: int) -> None:
            if self.open(path):
                unknown.append(path)
            elif self.nodes[path][3] >= 0:
                heapq.heappush(queue, (-self.nodes[path][5], path))

        meet(self.root)
        while queue and len(split) + 1 < self.limit:
            path = heapq.heappop(queue)[1]
            split.append(path)
            meet(2 * path)
            meet(2 * path + 1)
        return split, unknown

    def prune(self, split: list) -> None:
        """Forgets what lies below nodes that the queue did not split. Gains found
        later only add rivals, so it never will."""
        keep = {self.root, *(c for p in split for c in (2 * p, 2 * p + 1))}
        self.nodes = {p: n for p, n in self.nodes.items() if p in keep}

    def drawn(self, paths: list) -> np.ndarray:
        """Per path the features to try now, in number order after any -1."""
        m = self.fit.params.drawn(self.features)
        orders = feature_orders(self.own, np.array(paths, np.int64), m, self.fit.seed,
                                self.number)
        tried = np.array([self.nodes[p][6] for p in paths])
        at = tried[:, None] + np.arange(m)[None, :]
        now = np.take_along_axis(orders, np.minimum(at, orders.shape[1] - 1), axis=1)
        return np.sort(np.where(at < orders.shape[1], now, -1), axis=1)

    def settle(self, path: int, feature: int, b: int, gain: float, left, node) -> None:
        n = self.nodes[path]
        n[:3] = [int(v) for v in node]
        if feature < 0:  # none of those drawn: go on with the next ones
            n[6] += self.fit.params.drawn(self.features)
            if n[6] >= len(self.own):
                n[3] = LEAF
            return
        n[3:6] = [int(feature), int(b), float(gain)]
        left = [int(v) for v in left]
        self.nodes[2 * path] = [*left, UNKNOWN, 0, 0.0, 0]
        self.nodes[2 * path + 1] = [*(a - v for a, v in zip(n[:3], left)), UNKNOWN, 0, 0.0, 0]

    def arrays(self, splits: list | None = None) -> dict:
        """Compact arrays of the tree over ``splits`` (all known ones if None):
        a node without children has feature -1."""
        known = ([p for p, n in self.nodes.items() if n[3] >= 0 and 2 * p in self.nodes]
                 if splits is None else splits)
        inner = set(known)
        order = sorted({self.root, *(c for p in known for c in (2 * p, 2 * p + 1))})
        at = {p: i for i, p in enumerate(order)}
        n = [self.nodes[p] for p in order]
        fit = self.fit
        return {
            "path": np.array(order, np.int64),
            "feature": np.array([v[3] if p in inner else -1 for p, v in zip(order, n)], np.int32),
            "bin": np.array([v[4] for v in n], np.uint8),
            "gain": np.array([v[5] if p in inner else 0.0 for p, v in zip(order, n)]),
            "left": np.array([at.get(2 * p, 0) if p in inner else 0 for p in order], np.int32),
            "right": np.array([at.get(2 * p + 1, 0) if p in inner else 0 for p in order], np.int32),
            "rows": np.array([v[0] or 0 for v in n], np.int64),
            "value": leaf_values(np.array([v[2] for v in n]) / fit.scale,
                                 np.array([v[1] for v in n], np.float64), fit.params)}


def assign(x: np.ndarray, t: dict) -> np.ndarray:
    """Place in ``t`` (arrays) of the node that each row of bins ends in."""
    inner = t["feature"] >= 0
    if x.dtype == np.uint8 and len(x) and 0 < 2 * np.count_nonzero(inner) < 128:
        return _assign_few(x, t, inner)
    # A node's children stand side by side; a row stays in its leaf.
    left = np.where(inner, t["left"], np.arange(len(inner)))
    feature = np.where(inner, t["feature"], 0).astype(np.int64)
    cut = np.where(inner, t["bin"], 255 if t["bin"].dtype == np.uint8 else np.inf)
    flat = np.ravel(x)
    node, own = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    at, start = np.arange(len(x)), np.arange(len(x)) * x.shape[1]
    while True:
        live = inner[own]
        n = np.count_nonzero(live)
        if 2 * n < len(own) or not n:  # rows that have arrived stay behind
            node[at] = own
            at, own, start = at[live], own[live], start[live]
        if not n:
            return node
        own = left.take(own) + (flat.take(start + feature.take(own)) > cut.take(own))


def _assign_rows(x: np.ndarray, rows: np.ndarray, t: dict) -> np.ndarray:
    """:func:`assign` for some rows of ``x``."""
    if len(t["feature"]) == 1:
        return np.zeros(len(rows), np.int64)
    return assign(x if len(rows) == len(x) else x[rows], t)


def _assign_few(x: np.ndarray, t: dict, inner: np.ndarray) -> np.ndarray:
    """:func:`assign` for up to 64 leaves, a look-up a feature in place of a step
    a level: per (feature, bin) the leaves, from left to right, that a row may
    still reach; the first one left is its own (Lucchese et al., QuickScorer, 2015)."""
    leaves: list = []
    reach: dict = {}
    every = (1 << 64) - 1

    def walk(n: int) -> int:
        """The leaves under a node, as bits."""
        if not inner[n]:
            leaves.append(n)
            return 1 << (len(leaves) - 1)
        left = walk(int(t["left"][n]))
        f = int(t["feature"][n])
        of = reach.setdefault(f, np.full(256, every, np.uint64))
        of[int(t["bin"][n]) + 1:] &= np.uint64(every ^ left)
        return left | walk(int(t["right"][n]))

    walk(0)
    left = None
    for f, of in reach.items():
        own = of[x[:, f]]
        left = own if left is None else left & own
    first = np.bitwise_count((left & -left) - np.uint64(1))
    return np.array(leaves, np.int64)[first]


def grow_here(x: np.ndarray, w: np.ndarray, g: np.ndarray, tree: Tree, bins: int) -> None:
    """Grows ``tree`` over rows in memory, by the rounds of the distributed way."""
    fit = tree.fit
    rows, flat = {tree.root: np.arange(len(x))}, np.ravel(x)
    both, pull = row_sums(w, g)
    held: dict = {}  # sums of split nodes, where all nodes try the same features
    whole = fit.params.drawn(tree.features) >= len(tree.own)
    step = max(1, (HIST_BYTES >> 3) // (tree.features * bins * 24))

    def rows_of(path: int) -> np.ndarray:
        """A node's rows; those of its parent are dealt to both children at once."""
        if path not in rows:
            up, n = rows.pop(path >> 1), tree.nodes[path >> 1]
            right = flat.take(up * x.shape[1] + n[3]) > n[4]
            rows[path & ~1], rows[path | 1] = up[~right], up[right]
        return rows[path]

    while True:
        _, unknown = tree.replay()
        if not unknown:
            return
        unknown.sort()
        for lo in range(0, len(unknown), step):
            paths = unknown[lo:lo + step]
            drawn = tree.drawn(paths)
            own = [rows_of(p) for p in paths]
            sums = np.zeros((len(paths), drawn.shape[1], bins, 3), np.int64)
            # Of two children only the smaller is added up: sums are integers, so
            # the other's are exactly what is left of their parent's.
            less = {}
            for i in range(len(paths) - 1) if whole else ():
                if paths[i] ^ 1 == paths[i + 1] and paths[i] >> 1 in held:
                    j = i + (len(own[i]) <= len(own[i + 1]))
                    less[j] = 2 * i + 1 - j
            some = [i for i in range(len(own)) if i not in less]
            here = np.concatenate([own[i] for i in some])
            slot = np.repeat(some, [len(own[i]) for i in some])
            add_sums(sums, x, slot, drawn, None if both is None else both.take(here),
                     pull.take(here), here)
            for j, i in less.items():
                sums[j] = held[paths[j] >> 1] - sums[i]
            for path in paths:
                held.pop(path >> 1, None)
            for path, one, *found in zip(paths, sums, *best_splits(sums, drawn, fit.params,
                                                                   fit.scale, fit.total)):
                tree.settle(path, *found)
                if whole and tree.nodes[path][3] >= 0 and len(held) < step:
                    held[path] = one.copy()


# Binning ---------------------------------------------------------------------------------
def bin_edges(df: DataFrame, features: str = "features", bins: int = BINS) -> list[np.ndarray]:
    """Per feature the distinct inner quantiles (exact, distributed), a billionth
    up, so that values which differ by rounding only share a bin; at most
    ``bins`` - 1 a feature reach the driver."""
    from pyspark.ml.functions import vector_to_array

    from assayline.operators.ranks import exact_quantiles
    long = df.select(F.posexplode(vector_to_array(features)).alias("f", "value"))
    names = [f"q{i}" for i in range(1, bins)]
    rows = exact_quantiles(long, "value", [i / bins for i in range(1, bins)], ["f"], names).collect()
    found = {}
    for r in rows:
        q = np.array([r[n] for n in names])
        found[r["f"]] = np.unique(q + EDGE * np.abs(q))
    return [found[i] for i in sorted(found)]


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def to_bins(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin of each value: the number of edges below it."""
    out = np.empty(values.shape, np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.searchsorted(e, values[:, j], side="left")
    return out


#: A row of the stored table is a block of training rows, each column its bytes:
#: so a pass costs Spark a few copies in place of a conversion a row.
BLOCK = ("rid", "mask", "bins", "y", "margin")
TRAIN = "n long, " + ", ".join(f"{c} binary" for c in BLOCK)
BLOCK_ROWS = 4_096


def _packed(*columns: np.ndarray) -> pa.RecordBatch:
    """Blocks of the rows of the BLOCK columns."""
    n, cuts = len(columns[0]), range(0, len(columns[0]), BLOCK_ROWS)
    return pa.RecordBatch.from_arrays(
        [pa.array([min(BLOCK_ROWS, n - lo) for lo in cuts], pa.int64()),
         *(pa.array([c[lo:lo + BLOCK_ROWS].tobytes() for lo in cuts], pa.binary())
           for c in columns)], names=["n", *BLOCK])


#: Rows of a task of the stored table, at least and at most.
TASK_ROWS = (8_192, 1_000_000)


def training_table(df: DataFrame, targets: list[str], edges: list[np.ndarray],
                   features: str = "features", mask=None) -> DataFrame:
    """Stored TRAIN table: row hash, fits that the row trains, bins, labels."""
    from pyspark.ml.functions import vector_to_array
    own = [c for c in df.columns if c not in (features, "_mask")]
    src = df.select(F.xxhash64(*own).alias("rid"),
                    (F.lit(1).cast("long") if mask is None else mask).alias("mask"),
                    vector_to_array(features).alias("x"),
                    F.array(*[F.col(t).cast("double") for t in targets]).alias("y"))

    def binned(batches):
        for b in batches:
            if b.num_rows:
                yield _packed(b.column("rid").to_numpy(), b.column("mask").to_numpy(),
                              to_bins(_matrix(b.column("x")), edges), _matrix(b.column("y")),
                              np.empty((b.num_rows, 0)))

    n = df.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = max(-(-n // TASK_ROWS[1]), min(cores, -(-n // TASK_ROWS[0])), 1)
    return store(src.repartition(int(tasks)).mapInArrow(binned, TRAIN), "binned")


#: Rows that a task handles at a time.
CHUNK_ROWS = 65_536


def _chunks(batches):
    """BLOCK arrays of CHUNK_ROWS rows or a few more, from the table's blocks."""
    def arrays():
        rid, mask, x, y, margin = (b"".join(c) for c in zip(*held))
        return (np.frombuffer(rid, np.int64), np.frombuffer(mask, np.int64),
                np.frombuffer(x, np.uint8).reshape(n, -1), np.frombuffer(y).reshape(n, -1),
                np.frombuffer(margin).reshape(n, -1))

    held, n = [], 0
    for b in batches:
        for i, rows in enumerate(b.column("n").to_pylist()):
            held.append([b.column(c)[i].as_buffer() for c in BLOCK])
            n += rows
            if n >= CHUNK_ROWS:
                yield arrays()
                held, n = [], 0
    if n:
        yield arrays()


# Growing ---------------------------------------------------------------------------------
def _rows_of(chunk, fits: list[Fit], past: list[list[dict]]):
    """Arrays of a chunk and a function fit number -> (uses row, gradient)."""
    rid, mask, x, y, margin = chunk
    rid = rid.view(np.uint64)
    seen: dict = {}

    def of(i: int):
        if i not in seen:
            f = fits[i]
            own = y[:, f.target]
            used = ~np.isnan(own) & ((mask >> f.bit) & 1).astype(bool)
            now = margins(x, margin, i, f, past[i]) if f.params.boosted else f.base
            seen[i] = used, np.rint(np.where(used, now - own, 0.0) * f.scale)
        return seen[i]

    return x, rid, of


def margins(x: np.ndarray, stored: np.ndarray, i: int, fit: Fit, past: list[dict]) -> np.ndarray:
    """Score so far: the base, or what is stored, and the trees since then."""
    out = stored[:, i].copy() if stored.shape[1] else np.full(len(x), fit.base)
    for t in past:
        out = out + fit.params.rate * t["value"][assign(x, t)]
    return out


def _light(fits: list[Fit]) -> list[Fit]:
    return [replace(f, trees=[]) for f in fits]


def _past(fits: list[Fit]) -> list[list[dict]]:
    return [f.trees[f.margin:] if f.params.boosted else [] for f in fits]


def _split_job(table: DataFrame, fits: list[Fit], trees: list[Tree], wanted: list[tuple],
               bins: int) -> None:
    """One round: sums of the wanted (tree, path)s by all tasks, combined by
    node; only the best splits reach the driver."""
    spark = table.sparkSession
    number = {id(f): i for i, f in enumerate(fits)}
    m = max(t.fit.params.drawn(t.features) for t, _ in wanted)
    drawn = np.full((len(wanted), m), -1, np.int64)
    owner = np.empty(len(wanted), np.int64)
    per_tree: dict = {}
    for s, (t, path) in enumerate(wanted):
        owner[s] = number[id(t.fit)]
        per_tree.setdefault(id(t), (t, {}))[1][path] = s
    for t, slots in per_tree.values():
        own = t.drawn(list(slots))
        drawn[list(slots.values()), m - own.shape[1]:] = own
    specs = []
    for t, slots in per_tree.values():
        a = t.arrays()
        want = np.array([slots.get(int(p), -1) for p in a["path"]], np.int64)
        specs.append((number[id(t.fit)], t.number, {k: a[k] for k in
                                                    ("feature", "bin", "left", "right")}, want))
    shared = spark.sparkContext.broadcast((_light(fits), _past(fits), specs, drawn, owner))

    def sums(batches):
        fits_, past, specs_, drawn_, _ = shared.value
        out = np.zeros((len(drawn_), drawn_.shape[1], bins, 3), np.int64)
        for b in _chunks(batches):
            x, rid, of = _rows_of(b, fits_, past)
            for i, tree, a, want in specs_:
                used, g = of(i)
                w = np.where(used, row_weights(rid, fits_[i].params, fits_[i].seed, tree), 0)
                rows = np.flatnonzero(w)
                slot = want[_assign_rows(x, rows, a)]
                if (want < 0).any():
                    some = slot >= 0
                    rows, slot = rows[some], slot[some]
                if len(rows):
                    names = np.flatnonzero(np.bincount(slot))
                    place = np.zeros(names[-1] + 1, np.int64)
                    place[names] = np.arange(len(names))
                    part = np.zeros((len(names), *out.shape[1:]), np.int64)
                    add_sums(part, x, place.take(slot), drawn_[names],
                             *row_sums(w[rows], g[rows]), rows)
                    out[names] += part
        some = np.flatnonzero(out[:, 0, :, 0].any(axis=1))
        for lo in range(0, len(some), 1000):
            own = some[lo:lo + 1000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own), pa.array([out[s].tobytes() for s in own], pa.binary())],
                names=["slot", "sums"])

    def combined(batches):
        fits_, _, _, drawn_, owner_ = shared.value
        shape = (drawn_.shape[1], bins, 3)
        total: dict = {}
        for b in batches:
            for s, blob in zip(b.column("slot").to_pylist(), b.column("sums").to_pylist()):
                one = np.frombuffer(blob, np.int64).reshape(shape)
                total[s] = total[s] + one if s in total else one
        slots = np.array(sorted(total), np.int64)
        for i in np.unique(owner_[slots]) if len(slots) else []:
            own = slots[owner_[slots] == i]
            f = fits_[i]
            feature, b, gain, left, node = best_splits(
                np.stack([total[s] for s in own]), drawn_[own], f.params, f.scale, f.total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own), pa.array(feature), pa.array(b), pa.array(gain),
                 pa.array(list(left), pa.list_(pa.int64())),
                 pa.array(list(node), pa.list_(pa.int64()))],
                names=["slot", "feature", "bin", "gain", "l", "n"])

    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), len(wanted) // 8))
    found = (table.mapInArrow(sums, "slot long, sums binary").repartition(parts, "slot")
             .mapInArrow(combined, "slot long, feature long, bin long, gain double, "
                                   "l array<long>, n array<long>").collect())
    done = set()
    for r in found:
        t, path = wanted[r["slot"]]
        t.settle(path, r["feature"], r["bin"], r["gain"], r["l"], r["n"])
        done.add(r["slot"])
    for s, (t, path) in enumerate(wanted):
        if s not in done:  # a tree whose bag is empty
            t.nodes[path][:4] = [0, 0, 0, LEAF]
    shared.destroy()  # unpersist would leave the driver's copy


_NODE = ("tree long, path long, rows long, weight long, gradient long, feature long, bin long, "
         "gain double")


def deal(groups: list, rows: list[int], parts: int) -> dict:
    """Task of each group: the largest first, each to the task with the fewest rows."""
    tasks, out = [(0, k) for k in range(parts)], {}
    for n, group in sorted(zip(rows, groups), key=lambda x: (-x[0], x[1])):
        have, k = heapq.heappop(tasks)
        out[group] = k
        heapq.heappush(tasks, (have + n, k))
    return out


def _finish_job(table: DataFrame, fits: list[Fit], wanted: list[tuple], bins: int) -> None:
    """Rows of each wanted (tree, path), those of a small node, meet in a group and
    its subtree is grown there; the subtrees' nodes reach the driver."""
    spark = table.sparkSession
    number = {id(f): i for i, f in enumerate(fits)}
    trees: dict = {}
    for t, path in wanted:
        trees.setdefault(id(t), (t, []))[1].append(path)
    own = [t for t, _ in trees.values()]
    specs = []
    for t, paths in trees.values():
        a = t.arrays()
        want = np.isin(a["path"], np.array(paths, np.int64))
        specs.append((number[id(t.fit)], t.number, t.features,
                      {k: a[k] for k in ("feature", "bin", "left", "right", "path")}, want))
    # Splits a group makes: twice a tree's leaves over its groups.
    share = [max(LOCAL_SPLITS, -(-2 * t.limit // len(paths))) for t, paths in trees.values()]
    # A task costs more than a small group: few tasks, dealt by the groups' rows.
    rows = [t.nodes[p][0] or t.fit.total for t, p in wanted]
    parts = max(1, min(len(wanted), 2 * spark.sparkContext.defaultParallelism),
                sum(rows) * (own[0].features + 16) >> 26)
    place = {id(t): k for k, t in enumerate(own)}
    tasks = deal([(place[id(t)], p) for t, p in wanted], rows, parts)
    shared = spark.sparkContext.broadcast((_light(fits), _past(fits), specs, tasks))

    def rows_of_nodes(batches):
        fits_, past, specs_, tasks_ = shared.value
        for b in _chunks(batches):
            x, rid, of = _rows_of(b, fits_, past)
            out: list = []
            for k, (i, tree, _, a, want) in enumerate(specs_):
                used, g = of(i)
                w = np.where(used, row_weights(rid, fits_[i].params, fits_[i].seed, tree), 0)
                rows = np.flatnonzero(w)
                node = _assign_rows(x, rows, a)
                if not want.all():
                    here = want[node]
                    rows, node = rows[here], node[here]
                if len(want) > 1:  # few nodes: a sort of short numbers is linear
                    order = np.argsort(node.astype(np.uint16) if len(want) < 1 << 16 else node,
                                       kind="stable")
                    rows, node = rows[order], node[order]
                cuts = np.flatnonzero(np.diff(node)) + 1
                for part, n in zip(np.split(rows, cuts), np.split(node, cuts)):
                    if len(part):
                        path = int(a["path"][n[0]])
                        out.append((tasks_[k, path], k, path, x[part].tobytes(),
                                    w[part].astype(np.uint8).tobytes(), g[part].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (
                        pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
                    names=["task", "tree", "path", "x", "w", "g"])

    def grown(batches):
        fits_, _, specs_, _ = shared.value
        key, parts = None, []

        def result():
            k, path = key
            i, tree, features, _, _ = specs_[k]
            t = Tree(fits_[i], tree, features)
            t.root, t.nodes = path, {path: [None, 0, 0, UNKNOWN, 0, 0.0, 0]}
            t.limit = min(t.limit, share[k] + 1)
            x = np.frombuffer(b"".join(p[0] for p in parts), np.uint8).reshape(-1, features)
            w = np.frombuffer(b"".join(p[1] for p in parts), np.uint8).astype(np.int64)
            g = np.frombuffer(b"".join(p[2] for p in parts), np.float64)
            t.nodes[path][:3] = [len(w), int(w.sum()), int((w * g).sum())]
            grow_here(x, w, g, t, bins)
            rows = [(k, p, *n[:6]) for p, n in t.nodes.items()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c) for c in zip(*rows)],
                names=["tree", "path", "rows", "weight", "gradient", "feature", "bin", "gain"])

        for b in batches:
            for k, path, *blobs in zip(*(b.column(c).to_pylist()
                                         for c in ("tree", "path", "x", "w", "g"))):
                if (k, path) != key:
                    if key is not None:
                        yield result()
                    key, parts = (k, path), []
                parts.append(blobs)
        if key is not None:
            yield result()

    found = (table.mapInArrow(rows_of_nodes, "task int, tree long, path long, x binary, "
                                             "w binary, g binary")
             .repartitionById(parts, F.col("task")).drop("task")
             .sortWithinPartitions("tree", "path").mapInArrow(grown, _NODE).toArrow())
    for b in found.to_batches(10_000):
        for k, path, *n in zip(*(c.to_pylist() for c in b.columns)):
            own[k].nodes[path] = [*n, 0]
    for t, path in wanted:
        if t.nodes[path][3] == UNKNOWN and t.open(path):
            t.nodes[path][3] = LEAF
    shared.destroy()  # unpersist would leave the driver's copy


def grow(table: DataFrame, fits: list[Fit], trees: list[Tree], bins: int,
         local_rows: int | None = None) -> None:
    """Grows ``trees`` of ``fits`` over the TRAIN table, all in the same rounds,
    and appends their arrays to their fits in order."""
    limit = LOCAL_ROWS if local_rows is None else local_rows
    cores = table.sparkSession.sparkContext.defaultParallelism
    if local_rows is None and len(trees) >= cores:
        limit = max(limit, min(LOCAL_MORE * limit, sum(t.fit.total for t in trees) // cores))
    slot = trees[0].features * bins * 24
    pending = {id(t): t for t in trees}
    splits: dict = {}
    while pending:
        large, small = [], []
        for t in list(pending.values()):
            splits[id(t)], unknown = t.replay()
            t.prune(splits[id(t)])
            if not unknown:
                del pending[id(t)]
            for path in unknown:
                n = t.nodes[path][0]
                n = t.fit.total if n is None else n
                (small if n <= limit else large).append((t, path))
        step = max(1, HIST_BYTES // slot)
        for lo in range(0, len(large), step):
            _split_job(table, fits, trees, large[lo:lo + step], bins)
        if small and not large:
            _finish_job(table, fits, small, bins)
    for t in trees:
        t.fit.trees.append(t.arrays(splits[id(t)]))


def prepare_fits(table: DataFrame, fits: list[Fit]) -> list[Fit]:
    """Rows, base and fixed-point scale of each fit, from one aggregate; fits
    without rows are left out."""
    own = _light(fits)

    def summed(batches):
        for _, mask, _, y, _ in _chunks(batches):
            for i, f in enumerate(own):
                v = y[:, f.target]
                v = v[~np.isnan(v) & ((mask >> f.bit) & 1).astype(bool)]
                if len(v):
                    yield pa.RecordBatch.from_pylist(
                        [{"fit": i, "n": len(v), "s": v.sum(), "a": v.min(), "b": v.max()}])

    found = {r["fit"]: r for r in table.mapInArrow(
        summed, "fit long, n long, s double, a double, b double").groupBy("fit").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("a").alias("a"),
        F.max("b").alias("b")).collect()}  # one row a fit
    out = []
    for i, f in enumerate(fits):
        f.total = found[i]["n"] if i in found else 0
        if not f.total:
            continue
        r = found[i]
        f.base = r["s"] / r["n"]
        most = max(abs(r["a"] - f.base), abs(r["b"] - f.base), 1e-30)
        bits = min(28, 58 - max(1, f.total).bit_length())
        f.scale = 2.0 ** (bits - math.ceil(math.log2(most)))
        out.append(f)
    return out


def _with_margins(table: DataFrame, fits: list[Fit]) -> DataFrame:
    """``table`` with the scores of all trees so far stored."""
    shared = table.sparkSession.sparkContext.broadcast((_light(fits), _past(fits)))

    def scored(batches):
        fits_, past = shared.value
        for rid, mask, x, y, old in _chunks(batches):
            new = np.stack([margins(x, old, i, f, past[i]) for i, f in enumerate(fits_)], axis=1)
            yield _packed(rid, mask, x, y, new)

    out = store(table.mapInArrow(scored, TRAIN), "margins")
    shared.destroy()
    for f in fits:
        f.margin = len(f.trees)
    return out


def fit_trees(table: DataFrame, fits: list[Fit], features: int, bins: int = BINS,
              local_rows: int | None = None) -> list[Fit]:
    """Grows all trees of all ``fits`` (those of a forest together, those of
    boosting one after the other, all targets and fits in the same rounds).
    Forests of many leaves grow in groups of trees, by ``OPEN_NODES``."""
    fits = prepare_fits(table, fits)
    forests = [f for f in fits if not f.params.boosted]
    # As many trees at once as the driver can keep: with their queues, up to
    # eight nodes a leaf.
    now, nodes = [], 0
    for f, k in ((f, k) for f in forests for k in range(f.params.trees)):
        own = 8 * f.params.most_leaves(f.total)
        if now and nodes + own > OPEN_NODES:
            grow(table, forests, now, bins, local_rows)
            now, nodes = [], 0
        now.append(Tree(f, k, features))
        nodes += own
    if now:
        grow(table, forests, now, bins, local_rows)
    boosted = [f for f in fits if f.params.boosted]
    for k in range(max((f.params.trees for f in boosted), default=0)):
        now = [f for f in boosted if k < f.params.trees]
        grow(table, boosted, [Tree(f, k, features) for f in now], bins, local_rows)
        if (k + 1) % STORE_EVERY == 0:
            table = _with_margins(table, boosted)
    return fits
