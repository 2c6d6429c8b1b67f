"""Print the final adaptive plan of each headline query as an indented tree
of physical operators (query stages unwrapped, cached relations as leaves).

Usage: python tools/plan_shapes.py [sf_dir] > PLANS.md"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def tree(node, depth=0, out=None):
    out = [] if out is None else out
    name = node.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return tree(node.executedPlan(), depth, out)
    if "QueryStage" in name:
        return tree(node.plan(), depth, out)
    if name == "WholeStageCodegen" or name.startswith("WholeStageCodegen") or name == "InputAdapter":
        ch = node.children()
        for i in range(ch.size()):
            tree(ch.apply(i), depth, out)
        return out
    detail = ""
    s = node.simpleString(200)
    if name.startswith("Exchange") or "Join" in name or name.startswith("Window"):
        detail = " " + s[len(name):].strip()[:150]
    elif name.startswith("Scan") or name.startswith("FileScan"):
        detail = " " + s.split("PushedFilters")[1][:150] if "PushedFilters" in s else ""
    out.append("  " * depth + "- " + name + detail)
    ch = node.children()
    for i in range(ch.size()):
        tree(ch.apply(i), depth + 1, out)
    return out


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    import bench
    from assayline.plans import catalog
    from assayline.session import local_session
    spark = local_session(shuffle_partitions=16)
    qs = catalog.queries()
    print(f"# Final physical plans of the headline queries ({sf_dir})\n")
    print("Generated by `tools/plan_shapes.py`. Each plan is the adaptive plan after "
          "execution; stored inputs appear as Parquet scans. The jobs that "
          "compute bounds run before it and are not shown.\n")
    for n in bench.HEADLINE:
        df = qs[n](spark, sf_dir)
        t0 = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        dt = time.perf_counter() - t0
        print(f"## `{n}` (final job {dt:.2f} s)\n\n```")
        print("\n".join(tree(df._jdf.queryExecution().executedPlan())))
        print("```\n")
        spark.catalog.clearCache()


if __name__ == "__main__":
    main()
