"""Operator 9: embedding near-duplicates by a random-projection tree forest.

Vectors with equal labels (not null) and equal dimension are compared by
cosine in double precision. Equal vectors are one class; the forest holds one
member of each class, and class sizes count in the number of links.

Every tree splits its nodes by random hyperplanes: the direction is drawn from
the node's number, the threshold is the median projection of the node, and
vectors within ``SPILL`` typical projected distances of a borderline pair go to
both sides (spill overlap). Nodes larger than ``NODE`` are split by Spark, one
level a round, all nodes and trees at once: medians are mergeable sketches, so
a hot label is no single task. Smaller nodes are split on by the task that
holds them, down to leaves of ``LEAF`` vectors, which are compared whole. A
node that does not shrink (a cloud of near copies) is compared exactly as
pairs of blocks of bounded size; in later trees its members that already met
in a cloud of the first tree are not compared again. Pairs whose unit product
is within rounding of the threshold are recomputed from the vectors' own values.

Every vector carries the numbers of its leaves and clouds, and a pair belongs
to the smallest one both are in. So each link is counted once without a list
of pairs: a leaf emits, for each of its vectors, the number of links that
belong there and one member of its connected part, which is enough for the
components.

Only pairs that some leaf holds are found; the tests measure the recall
against brute force. Defined cases: a vector or label that is null, an empty or zero
vector, and one with a null or non-finite component link with nothing; rows
that repeat count as vectors of their own; a null id has a null component
unless linked; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm.common import components, join_hot, partitions, stored, table

THRESHOLD = 0.98
TREES, SPILL = 4, 1.0
NODE, LEAF = 2048, 256
#: A split that leaves one side with more than this share is no split.
SHRINK = 0.85
MAX_LEVELS = 60
#: Products this close to the threshold are verified.
ROUNDING = 1e-9


def _direction(seed: int, dim: int) -> np.ndarray:
    v = np.random.default_rng(seed & 0xFFFFFFFFFFFFFFFF).normal(size=dim)
    return v / np.linalg.norm(v)


def margin(threshold: float, dim: int) -> float:
    """Half width of the overlap: the projected distance of unit vectors at
    the threshold is about their distance over sqrt(dim)."""
    return SPILL * np.sqrt(max(0.0, 2 - 2 * threshold) / dim)


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    # Rows scaled by a power of two: exact, the cosine stays, and no square overflows.
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) if n else x


def _project(batches):
    for b in batches:
        if not b.num_rows:
            continue
        node = b.column("node").to_numpy()
        out = np.empty(len(node))
        for k in np.unique(node):
            at = np.flatnonzero(node == k)
            x = _matrix(b.column("v").take(pa.array(at)))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            out[at] = x @ _direction(int(k), x.shape[1])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)],
                                         names=[*b.schema.names, "proj"])


def _near(raw: np.ndarray, unit: np.ndarray, norms: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of a leaf are linked; a product within rounding of the
    threshold is verified on the vectors' own values (not unit ones)."""
    cos = unit @ unit.T
    hit = cos >= threshold + ROUNDING
    i, j = np.nonzero(np.triu(np.abs(cos - threshold) < ROUNDING, 1))
    for k in range(0, len(i), 65_536):
        p, q = i[k:k + 65_536], j[k:k + 65_536]
        own = np.einsum("ij,ij->i", raw[p], raw[q]) / (norms[p] * norms[q]) >= threshold
        hit[p, q] = hit[q, p] = own
    np.fill_diagonal(hit, False)
    return hit


def _belongs(places: list[np.ndarray], here: int) -> np.ndarray:
    """Pairs of rows that share no place with a smaller number than ``here``."""
    out = np.ones((len(places), len(places)), bool)
    flat = np.concatenate(places)
    row = np.repeat(np.arange(len(places)), [len(p) for p in places])
    row, flat = row[flat < here], flat[flat < here]
    order = np.argsort(flat, kind="stable")
    cuts = np.flatnonzero(np.diff(flat[order])) + 1
    for rows in np.split(row[order], cuts):
        if len(rows) > 1:
            out[np.ix_(rows, rows)] = False
    return out


def _parts(hit: np.ndarray) -> np.ndarray:
    """First row of each row's connected part."""
    first = np.full(len(hit), -1)
    for s in range(len(hit)):
        front = np.array([s]) if first[s] < 0 else np.array([], int)
        while len(front):
            first[front] = s
            front = np.flatnonzero(hit[front].any(axis=0) & (first < 0))
    return first


def _leaves(unit: np.ndarray, seed: int, width: float):
    """Index arrays of the leaves of a node."""
    todo = [(np.arange(len(unit)), seed)]
    while todo:
        at, s = todo.pop()
        if len(at) > LEAF:
            proj = unit[at] @ _direction(s, unit.shape[1])
            t = np.median(proj)
            sides = at[proj < t + width], at[proj >= t - width]
            if max(map(len, sides)) <= SHRINK * len(at):
                todo += [(side, (s * 2 + k + 1) * 0x9E3779B97F4A7C15) for k, side in
                         enumerate(sides)]
                continue
        yield at


def _assign(threshold: float):
    """(rep, node, place) of the leaves of a node."""
    def places(t: pa.Table) -> pa.Table:
        ids, unit = t.column("rep").to_numpy(), _matrix(t.column("v"))
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        node = t.column("node")[0].as_py()
        rows, at = [], []
        for k, leaf in enumerate(_leaves(unit, node, margin(threshold, unit.shape[1]))):
            rows.append(ids[leaf])
            number = (node ^ (k + 1) * 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9
            at.append(np.full(len(leaf), (number & (1 << 64) - 1) >> 1, np.int64))
        rows, at = np.concatenate(rows), np.concatenate(at)
        return pa.table([pa.array(rows), pa.array(np.full(len(rows), node)), pa.array(at)],
                        names=["rep", "node", "place"])
    return places


def _compared(threshold: float):
    """Per place of a group: its rows and which of their pairs are linked and
    belong there."""
    def places(t: pa.Table):
        place = t.column("place").to_numpy()
        for here in np.unique(place):
            part = t.take(pa.array(np.flatnonzero(place == here)))
            raw = _matrix(part.column("v"))
            norms = np.linalg.norm(raw, axis=1)
            hit = _near(raw, raw / norms[:, None], norms, threshold)
            own = part.column("own").to_numpy()
            if own.min() != own.max():  # two blocks of a cloud
                hit &= own[:, None] != own[None, :]
            flat = part.column("places").combine_chunks()
            cuts = flat.offsets.to_numpy()
            numbers = flat.values.to_numpy()
            hit &= _belongs([numbers[i:j] for i, j in zip(cuts[:-1], cuts[1:])], here)
            yield part, hit
    return places


def _pairs(threshold: float):
    def pairs(t: pa.Table) -> pa.Table:
        left, right = [], []
        for part, hit in _compared(threshold)(t):
            ids = part.column("rep").to_numpy()
            i, j = np.nonzero(np.triu(hit))
            left.append(np.minimum(ids[i], ids[j]))
            right.append(np.maximum(ids[i], ids[j]))
        return pa.table([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))],
                        names=["a", "b"])
    return pairs


def _summary(threshold: float):
    def summary(t: pa.Table) -> pa.Table:
        out = []
        for part, hit in _compared(threshold)(t):
            ids = part.column("rep").to_numpy()
            m = part.column("m").to_numpy()
            some = np.flatnonzero(hit.any(axis=1))
            out.append((ids[some], (hit[some] @ m).astype(np.int64), ids[_parts(hit)[some]]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)],
                        names=["rep", "others", "near"])
    return summary


def _cloud_visits(clouds: DataFrame, node_size: int) -> DataFrame:
    """(rep, node, place, block, own): pairs of blocks that cover every pair
    of a cloud. In later trees the members that share the most frequent cloud
    of the first tree (insiders) do not meet each other again."""
    home = clouds.where("tree = 0").groupBy("rep").agg(F.min("place").alias("home"))
    c = clouds.join(home, "rep", "left").withColumn("home", F.when(F.col("tree") > 0,
                                                                   F.col("home")))
    tally = c.groupBy("node", "home").agg(F.count(F.lit(1)).alias("n"))
    known = F.when(F.col("home").isNotNull(), F.struct("n", "home"))
    blocks = lambda n: F.ceil(n * 2 / F.lit(node_size)).cast("long")
    shape = (tally.groupBy("node").agg(F.sum("n").alias("k"), F.max(known).alias("most"))
                  .withColumn("inside", F.coalesce("most.n", F.lit(0).cast("long")))
                  .select("node", F.col("most.home").alias("main"),
                          blocks(F.col("k") - F.col("inside")).alias("out_blocks"),
                          blocks(F.col("inside")).alias("in_blocks")))
    deal = lambda n: F.pmod(F.xxhash64("rep"), F.greatest(n, F.lit(1).cast("long")))
    inside = F.coalesce(F.col("home") == F.col("main"), F.lit(False))
    n = F.col("out_blocks") + F.col("in_blocks")
    met = (join_hot(c, shape, ["node"], "rep").withColumn("n", n)
           .withColumn("own", F.when(inside, F.col("out_blocks") + deal(F.col("in_blocks")))
                       .otherwise(deal(F.col("out_blocks"))))
           .withColumn("meets", F.when(inside, F.col("out_blocks")).otherwise(F.col("n")))
           .where("meets > 0")
           .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("meets") - 1))))
    return met.select("rep", "node", "place",
                      (F.least("own", "other") * F.col("n") + F.greatest("own", "other"))
                      .alias("block"), "own")


def _visits(reps: DataFrame, threshold: float, trees: int, node_size: int) -> DataFrame:
    """``reps`` (rep, v and more) once for each leaf or pair of blocks in which
    a vector is compared: node, block (the group), place, own (block of a
    cloud, or -1), and places, all leaves and clouds of the vector."""
    kind = reps.schema["v"].dataType.simpleString()
    rows = stored(reps.select(
        F.explode(F.array(*[F.lit(i) for i in range(trees)])).alias("tree"), "rep", "grp", "v")
        .select("tree", F.xxhash64("grp", "tree").alias("node"), "rep", "v"), "nodes")
    settled, clouds, cols = [], [], ["tree", "node", "rep", "v"]
    # ceil(dimension) is constant in a node, so the overlap is a node's number.
    width = F.sqrt(F.lit(max(0.0, 2 - 2 * threshold)) / F.size("v")) * SPILL
    for _ in range(MAX_LEVELS):
        size = stored(rows.groupBy("node").agg(F.count(F.lit(1)).alias("k")), "sizes")
        large = size.where(F.col("k") > node_size)
        settled.append(rows.join(size.where(F.col("k") <= node_size).select("node"), "node")
                           .select(*cols))
        if large.isEmpty():
            break
        proj = stored(join_hot(rows, large.select("node"), ["node"], "rep").select(*cols)
                      .mapInArrow(_project,
                                  f"tree int, node long, rep long, v {kind}, proj double"), "proj")
        at = proj.groupBy("node").agg(F.percentile_approx("proj", 0.5, 1000).alias("t"))
        sided = join_hot(proj, at, ["node"], "rep").withColumn("w", width)
        sides = F.array_compact(F.array(
            F.when(F.col("proj") < F.col("t") + F.col("w"), F.lit(0)),
            F.when(F.col("proj") >= F.col("t") - F.col("w"), F.lit(1))))
        split = stored(sided.select(*cols, F.explode(sides).alias("side")), "sides")
        sizes = split.groupBy("node", "side").agg(F.count(F.lit(1)).alias("s"))
        stuck = stored(sizes.groupBy("node").agg(F.max("s").alias("s")).join(large, "node")
                       .where(F.col("s") > SHRINK * F.col("k")).select("node"), "stuck")
        if not stuck.isEmpty():
            clouds.append(join_hot(proj.select("tree", "node", "rep"), stuck, ["node"], "rep"))
            split = join_hot(split, stuck.withColumn("stuck", F.lit(True)), ["node"], "rep",
                             "left").where("stuck is null")
        rows = stored(split.select("tree", F.xxhash64("node", "side").alias("node"), "rep", "v"),
                      "nodes")
    else:
        raise RuntimeError("the forest did not settle")
    union = lambda parts: functools.reduce(DataFrame.union, parts)
    visits = stored(union(settled).groupBy("node").applyInArrow(
        _assign(threshold), "rep long, node long, place long"), "leaves")
    known = [visits.select("rep", "place")]
    alone = F.lit(-1).cast("long")
    visits = visits.select("rep", "node", "place", alone.alias("block"), alone.alias("own"))
    if clouds:
        number = F.col("node").bitwiseAND((1 << 63) - 1)
        # Clouds of the first tree come before all other places.
        met = stored(union(clouds).select(
            "tree", "node", "rep",
            F.when(F.col("tree") == 0, -1 - number).otherwise(number).alias("place")), "clouds")
        known.append(met.select("rep", "place"))
        visits = visits.union(_cloud_visits(met, node_size))
    places = union(known).groupBy("rep").agg(F.collect_set("place").alias("places"))
    return visits.join(reps.drop("grp").join(places, "rep"), "rep")


def _grouped(visits: DataFrame):
    return (visits.repartition(partitions(visits.sparkSession), "node", "block")
                  .groupBy("node", "block"))


def forest_links(reps: DataFrame, threshold: float = THRESHOLD, trees: int = TREES,
                 node_size: int = NODE) -> DataFrame:
    """(a, b), a < b: linked members of ``reps`` (rep, grp, v), each pair once.
    Vectors keep their element type, so pairs are verified on the values that
    came in. The list of a cloud grows with its square: see :func:`forest_degrees`."""
    return (_grouped(_visits(reps, threshold, trees, node_size))
            .applyInArrow(_pairs(threshold), "a long, b long"))


def forest_degrees(reps: DataFrame, threshold: float = THRESHOLD, trees: int = TREES,
                   node_size: int = NODE) -> DataFrame:
    """(rep, others, near): ``others`` sums to the weights (m) of the members
    linked with ``rep``; the links (rep, near) have the components of all links.
    A vector has at most one row for each leaf or pair of blocks it is in."""
    return (_grouped(_visits(reps, threshold, trees, node_size))
            .applyInArrow(_summary(threshold), "rep long, others long, near long"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding",
                    label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component_id) of every row of ``vectors``."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    valid = F.coalesce(F.col(label).isNotNull() & v.isNotNull() & finite & some, F.lit(False))
    key = F.struct(F.col(label).alias("label"), F.size(v).alias("dim"))
    kind = vectors.schema[vector].dataType.elementType.simpleString()
    rows = vectors.select(F.col(id_col).alias("_rp_id"), valid.alias("ok"), key.alias("grp"),
                          F.xxhash64(v).alias("k1"), F.xxhash64(F.lit(71), v).alias("k2"),
                          v.cast("array<float>" if kind == "float" else "array<double>").alias("v"))
    cls = ["grp", "k1", "k2"]
    # Without an id a row still has a place in its class.
    reps = stored(rows.where("ok and _rp_id is not null").groupBy(*cls)
                  .agg(F.min("_rp_id").alias("rep"), F.count(F.lit(1)).alias("m"),
                       F.first("v").alias("v")), "classes")
    found = stored(forest_degrees(reps.select("rep", "grp", "v", "m"), threshold), "degrees")
    others = found.groupBy("rep").agg(F.sum("others").alias("others"))
    links = found.where("rep <> near").select("rep", "near").distinct()
    cc = components(links, "rep", "near").withColumnRenamed("node", "rep")
    per_class = (reps.drop("v").join(others, "rep", "left").join(cc, "rep", "left").select(
        *cls, (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n"),
        F.coalesce("component", "rep").alias("component")))
    linked = rows.where("ok and _rp_id is not null").select("_rp_id", *cls).join(per_class, cls)
    alone = rows.where("not ok or _rp_id is null")
    return (linked.select(F.col("_rp_id").alias(id_col), F.col("n").alias("n_links"),
                          F.col("component").alias("component_id"))
            .union(alone.select("_rp_id", F.lit(0).cast("long"), "_rp_id")))


def op9_rp_forest_near_dedup(spark, sf_dir: str) -> DataFrame:
    got = near_duplicates(table(spark, sf_dir, "embeddings"))
    return got.withColumn("kept", F.col("vec_id") == F.col("component_id"))


#: All pairs of equal label: the brute-force twin of the query.
SQL = """
WITH v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e)
        / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
r AS (
  WITH RECURSIVE c(vec_id, reach) AS (
    SELECT vec_id, vec_id FROM embeddings
    UNION SELECT l.a, c.reach FROM c JOIN l ON l.b = c.vec_id)
  SELECT vec_id, min(reach) AS component_id FROM c GROUP BY 1)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, r.component_id,
       e.vec_id = r.component_id AS kept
FROM embeddings e JOIN r USING (vec_id)
"""
