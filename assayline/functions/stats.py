"""Statistics chosen by name, shared by A1-A6.

Plain aggregates map to one Spark expression each; ``median`` and
``percentile`` are order statistics and go through
``assayline.operators.ranks`` (exact, distributed), never a single task.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The reference's default statistic list and percentile set.
DEFAULT_STATS = ("mean", "median", "min", "max", "std", "var")
PERCENTILES = (10, 25, 50, 75, 90)

SIMPLE: dict[str, Callable[[str], Column]] = {
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "std": F.stddev_samp,      # ddof 1, one row -> NULL
    "var": F.var_samp,
    "sum": F.sum,
    "count": F.count,
}


def simple_aggs(column: str, stats: Sequence[str], name: Callable[[str], str]) -> list[Column]:
    """Aggregate expressions for the non-order statistics, aliased by ``name``."""
    return [SIMPLE[s](column).alias(name(s)) for s in stats if s in SIMPLE]
