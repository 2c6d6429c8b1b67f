"""Registered queries: small boosted trees, split by split, with SQL twins.

The twin bins by exact quantiles, adds up rows and fixed-point gradients per
(node, feature, bin) and picks splits by window sums, so every split, gain and
leaf value of the distributed learner is checked.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from assayline.operators import models as MD
from assayline.operators import split as SP
from assayline.operators import trees as TR
from assayline.plans import flows
from assayline.plans import oracle as Q
from assayline.plans.catalog import register
from assayline.sources.adapter import load_tables

MONTH = 24
FEATURES = ("NPX_log", "PeptideAbundance_log", "Peptide_per_Protein")
LABEL = "updrs_3"
XGBOOST = {"n_estimators": 2, "max_depth": 3, "learning_rate": 0.3, "reg_lambda": 5.0,
           "reg_alpha": 2.0, "gamma": 0.5, "min_child_weight": 4}
LIGHTGBM = {"n_estimators": 1, "num_leaves": 6, "learning_rate": 0.1, "reg_lambda": 1.0,
            "min_child_samples": 10}
#: Bins of the two queries.
BINS = 8


def _score(g: str, h: str, p: TR.TreeParams) -> str:
    soft = f"(sign({g}) * greatest(abs({g}) - {p.l1}::DOUBLE, 0.0))"
    return f"({soft} * {soft} / ({h} + {p.l2}::DOUBLE))"


def _value(g: str, h: str, p: TR.TreeParams) -> str:
    return f"(-(sign({g}) * greatest(abs({g}) - {p.l1}::DOUBLE, 0.0)) / ({h} + {p.l2}::DOUBLE))"


def tree_sql(p: TR.TreeParams, levels: int, total: str = "(SELECT n FROM sc)") -> str:
    """CTEs after ``rows`` (rid, f, x; one row a feature) and ``lab`` (rid, y):
    ``nodes`` (tree, path, f, cut, gain, value, n). ``levels`` bounds the depth."""
    out = [f"""
ed AS (SELECT f, cut, row_number() OVER (PARTITION BY f ORDER BY cut) - 1 AS b FROM (
  SELECT DISTINCT f, q + {TR.EDGE} * abs(q) AS cut FROM (SELECT f, unnest(quantile_cont(x, [{", ".join(f"{i}/{BINS}::DOUBLE" for i in range(1, BINS))}]))
  AS q FROM rows GROUP BY f))),
bn AS MATERIALIZED (SELECT rid, f, count(cut) AS bin FROM (
  SELECT r.rid, r.f, ed.cut FROM rows r LEFT JOIN ed ON ed.f = r.f AND ed.cut < r.x) GROUP BY rid, f),
sc AS MATERIALIZED (SELECT n, base, pow(2.0, least(28, 58 - (floor(log2(n)) + 1)) - ceil(log2(
  greatest(abs(lo - base), abs(hi - base))))) AS scale
  FROM (SELECT count(*) AS n, avg(y) AS base, min(y) AS lo, max(y) AS hi FROM lab)),
m0 AS MATERIALIZED (SELECT rid, y, base AS m FROM lab, sc)"""]
    gl, gr, gn = "(gl / scale)", "((g - gl) / scale)", "(g / scale)"
    hl, hr, hn = "cl::DOUBLE", "(c - cl)::DOUBLE", "c::DOUBLE"
    gain = (f"({_score(gl, hl, p)} + {_score(gr, hr, p)} - {_score(gn, hn, p)})")
    least = max(int(p.min_leaf), 1, p.min_child_weight)
    for t in range(p.trees):
        out.append(f"""
g{t} AS MATERIALIZED (SELECT rid, round_even((m - y) * scale, 0)::BIGINT AS g FROM m{t}, sc),
n{t}_0 AS MATERIALIZED (SELECT rid, 1::BIGINT AS node FROM lab)""")
        for d in range(levels):
            out.append(f"""
a{t}_{d} AS MATERIALIZED (SELECT node, f, bin, count(*) AS c, sum(g) AS g
  FROM n{t}_{d} JOIN g{t} USING (rid) JOIN bn USING (rid) GROUP BY ALL),
w{t}_{d} AS (SELECT node, f, bin, sum(c) OVER (PARTITION BY node, f ORDER BY bin) AS cl,
  (sum(g) OVER (PARTITION BY node, f ORDER BY bin))::DOUBLE AS gl,
  sum(c) OVER (PARTITION BY node, f) AS c, (sum(g) OVER (PARTITION BY node, f))::DOUBLE AS g
  FROM a{t}_{d}),
s{t}_{d} AS MATERIALIZED (SELECT node, f, bin, gain FROM (
  SELECT *, {gain} AS gain,
         {_score(gl, hl, p)} + {_score(gr, hr, p)} + {_score(gn, hn, p)} AS mass
  FROM w{t}_{d}, sc WHERE cl >= {least} AND c - cl >= {least} AND c >= {p.least_split(0) if p.min_split > 1 else 2})
  WHERE gain > 1e-10 * mass AND gain >= {p.min_gain}
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, bin) = 1),
n{t}_{d + 1} AS MATERIALIZED (SELECT n.rid, CASE WHEN s.node IS NULL THEN n.node
    ELSE 2 * n.node + CASE WHEN bn.bin > s.bin THEN 1 ELSE 0 END END AS node
  FROM n{t}_{d} n LEFT JOIN s{t}_{d} s USING (node) LEFT JOIN bn ON bn.rid = n.rid AND bn.f = s.f)""")
        every = "\nUNION ".join(f"SELECT * FROM s{t}_{d}" for d in range(levels))
        out.append(f"\nq{t} AS MATERIALIZED ({every})")
        if p.max_leaves:  # best first: the queue, one pop after the other
            for k in range(p.max_leaves - 1):
                popped = " UNION ALL ".join([f"SELECT node FROM p{t}_{j}" for j in range(k)]
                                            or ["SELECT 0 AS node WHERE false"])
                out.append(f"""
p{t}_{k} AS MATERIALIZED (SELECT node FROM q{t} WHERE node NOT IN ({popped})
  AND (node = 1 OR node // 2 IN ({popped})) ORDER BY gain DESC, node LIMIT 1)""")
            taken = " UNION ALL ".join(f"SELECT node FROM p{t}_{j}" for j in range(p.max_leaves - 1))
        else:
            taken = f"SELECT node FROM q{t}"
        out.append(f"""
k{t} AS MATERIALIZED (SELECT * FROM q{t} WHERE node IN ({taken})),
v{t} AS MATERIALIZED (SELECT 1 AS node UNION ALL SELECT 2 * node FROM k{t}
  UNION ALL SELECT 2 * node + 1 FROM k{t}),
r{t} AS MATERIALIZED (
  SELECT rid, node FROM ({" UNION ".join(f"SELECT * FROM n{t}_{d}" for d in range(levels + 1))})
  WHERE node IN (SELECT node FROM v{t})),
l{t} AS MATERIALIZED (SELECT node, count(*) AS n,
    {_value("(sum(g)::DOUBLE / any_value(scale))", "count(*)::DOUBLE", p)} AS value
  FROM r{t} JOIN g{t} USING (rid), sc GROUP BY node),
m{t + 1} AS MATERIALIZED (SELECT m.rid, m.y, m.m + {p.rate}::DOUBLE * l.value AS m FROM m{t} m
  JOIN (SELECT rid, max(node) AS node FROM r{t} GROUP BY rid) r USING (rid) JOIN l{t} l USING (node))""")
    nodes = "\nUNION ALL ".join(
        f"SELECT {t} AS tree, l.node AS path, k.f, ed.cut, coalesce(k.gain, 0.0) AS gain, l.value, "
        f"l.n FROM l{t} l LEFT JOIN k{t} k USING (node) LEFT JOIN ed ON ed.f = k.f AND ed.b = k.bin"
        for t in range(p.trees))
    out.append(f"\nnodes AS ({nodes})")
    return ",".join(out)


def _sql(family: str, params: dict, levels: int) -> str:
    p = MD.tree_params(family, params)[0]
    cols = ", ".join(f"{{'f': {i}, 'x': coalesce({c}, {MD.MISSING})::DOUBLE}}"
                     for i, c in enumerate(FEATURES))
    return Q.with_(Q.clean(MONTH)) + f""",
src AS MATERIALIZED (SELECT row_number() OVER () AS rid, * FROM (
  SELECT *, {Q._ratio()} AS Peptide_per_Protein, {Q.split_case()} AS ds FROM cleaned)
  WHERE ds = 'train'),
lab AS MATERIALIZED (SELECT rid, {LABEL}::DOUBLE AS y FROM src),
rows AS MATERIALIZED (SELECT rid, u.f, u.x FROM (SELECT rid, unnest([{cols}]) AS u FROM src)),
{tree_sql(p, levels)}
SELECT tree, path, [{", ".join(f"'{c}'" for c in FEATURES)}][f + 1] AS feature, cut AS threshold,
       gain, value, n AS rows FROM nodes"""


def _splits(spark, sf_dir, family: str, params: dict):
    from assayline.operators.features import add_ratio
    df = add_ratio(flows.clean(load_tables(spark, sf_dir), MONTH, keep_visit_keys=True))
    vec = MD.vectorize(SP.assign_split(df, "80_20"), FEATURES)
    data = MD.TrainData(vec.where(F.col("split") == "train"), [LABEL], bins=BINS)
    (model, _), = data.fits([(family, LABEL, params, 0)])
    rows = []  # a model is at most its parameters' size
    for i, t in enumerate(model.trees):
        for path, f, cut, gain, value, n in zip(*(t[k].tolist() for k in (
                "path", "feature", "threshold", "gain", "value", "rows"))):
            inner = f >= 0
            rows.append((i, path, FEATURES[f] if inner else None, cut if inner else None,
                         gain, value, n))
    return spark.createDataFrame(rows, "tree int, path long, feature string, threshold double, "
                                       "gain double, value double, rows long")


@register("boosted_tree_splits", _sql("xgboost", XGBOOST, 3), rounded=("threshold", "gain", "value"))
def boosted_tree_splits(spark, sf_dir):
    """Two rounds of second-order boosting with L1, L2, gamma and least
    child weight: every node's split, gain, value and rows."""
    return _splits(spark, sf_dir, "xgboost", XGBOOST)


@register("leafwise_tree_splits", _sql("lightgbm", LIGHTGBM, 5), rounded=("threshold", "gain", "value"))
def leafwise_tree_splits(spark, sf_dir):
    """One tree grown leaf by leaf up to num_leaves."""
    return _splits(spark, sf_dir, "lightgbm", LIGHTGBM)
