"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is forced with a ``noop`` write (the whole plan runs, nothing is
collected). Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "clean_month_24",           # minimum slice: filters, joins, dedup, null drop
    "iqr_fences_npx",           # exact quartiles from distributed cumulative counts
    "clean_full_month_24",      # L1
    "global_percentile_rank",   # W1
    "features_month_24",        # L2
    "prepare_month_24",         # L5: split + train-fitted scaling
    "evaluate_fixed",           # M18 on the fixed predictor
    "learning_curve_fixed",     # M23 shape: 25 fits in one job
    "fit_random_forest_updrs_1",  # M11 + M17
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from assayline.plans import catalog
    from assayline.session import local_session

    spark = local_session(cpus=cpus, shuffle_partitions=max(8, int(cpus) * 2)
                          if cpus.isdigit() else 16, app="assayline-bench")
    qs = catalog.queries()
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in qs]
    # Warm the JVM (class loading, JIT, Parquet readers) outside the timings:
    # the flagship query once on the tiny sf0.001 folder.
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm) and "clean_month_24" in qs:
        qs["clean_month_24"](spark, warm).write.format("noop").mode("overwrite").save()
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        spark.catalog.clearCache()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    try:
        sf = float(sf)
    except ValueError:
        pass
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
