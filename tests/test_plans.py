"""Plan guards over every SQL-checked query: no Cartesian product, no
nested-loop join (no cross joins anywhere), and no Python row-at-a-time UDF."""

import pytest

import __spark_entry__ as E

from conftest import SF001

BANNED = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


def _names(node, out):
    name = node.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return _names(node.executedPlan(), out)
    if "QueryStage" in name:
        return _names(node.plan(), out)
    out.add(name)
    ch = node.children()
    for i in range(ch.size()):
        _names(ch.apply(i), out)
    return out


def test_no_cross_or_row_udf_in_any_sql_query(spark):
    qs, sql = E.queries(), E.oracle_sql()
    bad = {}
    # Tree fits run their jobs while the plan is built; their plans are small.
    for name in (n for n in sql if not n.endswith("_invariants") and "tree" not in n):
        plan = qs[name](spark, SF001)._jdf.queryExecution().executedPlan()
        names = _names(plan, set())
        hit = [b for b in BANNED if any(b in n for n in names)]
        if hit:
            bad[name] = hit
    assert not bad, bad


def test_ranks_run_per_slice(spark):
    """Ranks have one path at every size: no window over values runs in a
    frame that is not divided by the slice number."""
    from assayline.operators import ranks as R
    from assayline.plans import flows
    from assayline.sources.adapter import load_tables
    ranked = R.average_rank(flows.clean(load_tables(spark, SF001), 24), "NPX_log", out="r")
    text = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert ranked.where("r is null and NPX_log is not null").count() == 0
    windows = [x for x in text.split("\n") if "Window [" in x and "NPX_log" in x]
    assert windows and all("_slice" in x for x in windows)
