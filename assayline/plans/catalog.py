"""Query catalog: one entry per operator of the inventory.

Each entry pairs a Spark builder ``fn(spark, sf_dir) -> DataFrame`` with the
equivalent DuckDB SQL over the driver's views (or ``None`` where only a
rows check is possible). Double columns named in ``rounded`` are rounded
to 6 places on both sides so that summation order cannot flip a digit.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLACES = 6


@dataclass
class Entry:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    rounded: tuple = field(default_factory=tuple)

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(spark, sf_dir)
        for c in self.rounded:
            df = df.withColumn(c, F.round(F.col(c), PLACES))
        return df

    def oracle(self) -> str | None:
        if self.sql is None or not self.rounded:
            return self.sql
        repl = ", ".join(f"round({c}, {PLACES}) AS {c}" for c in self.rounded)
        return f"SELECT * REPLACE ({repl}) FROM (\n{self.sql}\n) AS q"


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None, rounded=()):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, sql, tuple(rounded))
        return fn
    return deco


def _load_all():
    # Importing the modules fills REGISTRY.
    from assayline.plans import (queries_annotation, queries_clean,  # noqa: F401
                                 queries_features,
                                 queries_metrics, queries_outliers, queries_reports,
                                 queries_models, queries_split, queries_trees)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return {n: e.spark for n, e in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {n: e.oracle() for n, e in REGISTRY.items() if e.sql is not None}
