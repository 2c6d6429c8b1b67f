"""Data-quality reports: A7-A10, A14, A27, A28, W5, P20-P22, T3, T4.

Every report is an aggregate (partial aggregation map-side), never a
collect of rows; the only driver-side values are one-row results.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayline.operators.clean import NULL_COUNT, null_count_col

_CNT = "_dup_n"


def _group_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(_CNT))


def duplicate_report(df: DataFrame) -> DataFrame:
    """Rows in a duplicate set (keep none), their percent, rows removed."""
    g = _group_counts(df)
    return g.agg(
        F.sum(_CNT).alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col(_CNT) > 1, F.col(_CNT))), F.lit(0)).alias("duplicate_rows"),
        (F.sum(_CNT) - F.count(F.lit(1))).alias("rows_removed"),
    ).withColumn("pct_duplicates",
                 F.col("duplicate_rows").cast("double") * 100.0 / F.col("n_rows"))


def duplicate_flag_counts(df: DataFrame) -> DataFrame:
    """Rows by is-duplicate flag (the count plot's data)."""
    g = _group_counts(df)
    return (g.groupBy((F.col(_CNT) > 1).alias("is_duplicate"))
             .agg(F.sum(_CNT).alias("n_rows")))


def mark_duplicates(df: DataFrame) -> DataFrame:
    """``is_duplicate`` true for every member of a duplicate set.

    Group counts joined back with null-safe keys instead of a window over all
    columns, so a huge duplicate set is not one task (AQE splits the hot key)."""
    g = _group_counts(df)
    g = g.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(df.columns)], _CNT)
    cond = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(df.columns)]
    return df.join(g, cond, "left").select(*df.columns, (F.col(_CNT) > 1).alias("is_duplicate"))


def null_report(df: DataFrame) -> DataFrame:
    """Rows with a null, percent, rows a null drop removes."""
    nc = null_count_col([c for c in df.columns if c != NULL_COUNT])
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.count_if(nc > 0).alias("rows_with_nulls")).select(
        "n_rows", "rows_with_nulls",
        (F.col("rows_with_nulls").cast("double") * 100.0 / F.col("n_rows")).alias("pct_with_nulls"),
        F.col("rows_with_nulls").alias("rows_removed"))


def null_count_histogram(df: DataFrame) -> DataFrame:
    """A10: rows by null_count."""
    nc = null_count_col([c for c in df.columns if c != NULL_COUNT])
    return df.groupBy(nc.alias(NULL_COUNT)).agg(F.count(F.lit(1)).alias("n_rows"))


def total_nulls(df: DataFrame) -> DataFrame:
    """Nulls over all cells."""
    nc = null_count_col([c for c in df.columns if c != NULL_COUNT])
    return df.agg(F.coalesce(F.sum(nc), F.lit(0)).cast("long").alias("total_nulls"))


def stage_change_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Share of rows removed and share of new nulls between two stages."""
    b = before.agg(F.count(F.lit(1)).alias("rows_before"),
                   F.coalesce(F.sum(null_count_col(before.columns)), F.lit(0)).alias("nulls_before"))
    a = after.agg(F.count(F.lit(1)).alias("rows_after"),
                  F.coalesce(F.sum(null_count_col(after.columns)), F.lit(0)).alias("nulls_after"))
    rb, ra = b.first(), a.first()  # one row each
    cells = ra["rows_after"] * len(after.columns)
    extra = ra["nulls_after"] - rb["nulls_before"]
    row = (int(rb["rows_before"]), int(ra["rows_after"]),
           (rb["rows_before"] - ra["rows_after"]) / rb["rows_before"] if rb["rows_before"] else None,
           int(rb["nulls_before"]), int(ra["nulls_after"]), int(extra),
           extra / cells if cells else None)
    schema = ("rows_before long, rows_after long, proportion_removed double, "
              "nulls_before long, nulls_after long, additional_nulls long, "
              "proportion_additional_nulls double")
    return before.sparkSession.createDataFrame([row], schema)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values of a column."""
    return df.select(column).distinct().orderBy(column)


# Narrow types ------------------------------------------------------------
# Integer and float ranges used by the reference's strict test.
INT_RANGES = (("int8", -128, 127), ("int16", -32768, 32767),
              ("int32", -2147483648, 2147483647),
              ("int64", -9223372036854775808, 9223372036854775807))
FLOAT_RANGES = (("float16", -65504.0, 65504.0),
                ("float32", -3.4028234663852886e38, 3.4028234663852886e38))
SPARK_TYPE = {"int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint",
              "float16": "float", "float32": "float", "float64": "double",
              "category": "category"}
WIDTH = {"int8": 1, "int16": 2, "int32": 4, "int64": 8, "float16": 2, "float32": 4,
         "float64": 8, "object": 8}


def _kind(dt) -> str:
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    return "object"


def _source_name(dt) -> str:
    return {T.ByteType: "int8", T.ShortType: "int16", T.IntegerType: "int32",
            T.LongType: "int64", T.FloatType: "float32"}.get(type(dt), "float64"
                                                               if _kind(dt) == "float"
                                                               else "object")


def downcast_plan(df: DataFrame) -> DataFrame:
    """P20: per column the narrowest type by the strict min/max rule.

    One aggregate gives min and max of every numeric column, one grouping the
    distinct counts of the text columns; the decision is a CASE per column,
    evaluated in Spark."""
    text = [f.name for f in df.schema.fields if _kind(f.dataType) == "object"]
    distinct = {}
    if text:
        # One combined grouping of all text columns; one row a column comes back.
        stacked = df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
            for c in text])).alias("v")).select("v.*").where("value is not null")
        distinct = {r["column"]: r["n"] for r in stacked.groupBy("column", "value").agg(
            F.lit(1)).groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    aggs = []
    for f in df.schema.fields:
        if f.name in text:
            aggs += [F.lit(float(distinct.get(f.name, 0))).alias(f"{f.name}__lo"),
                     F.lit(None).cast("double").alias(f"{f.name}__hi")]
        else:
            aggs += [F.min(f.name).cast("double").alias(f"{f.name}__lo"),
                     F.max(f.name).cast("double").alias(f"{f.name}__hi")]
    wide = df.agg(F.count(F.lit(1)).alias("n_rows"), *aggs)
    parts = []
    for f in df.schema.fields:
        k, lo, hi = _kind(f.dataType), F.col(f"{f.name}__lo"), F.col(f"{f.name}__hi")
        if k == "int":
            target = F.lit("int64")
            for name, a, b in reversed(INT_RANGES[:-1]):
                target = F.when((lo > F.lit(a)) & (hi < F.lit(b)), F.lit(name)).otherwise(target)
        elif k == "float":
            target = F.lit("float64")
            for name, a, b in reversed(FLOAT_RANGES):
                target = F.when((lo > F.lit(a)) & (hi < F.lit(b)), F.lit(name)).otherwise(target)
        else:
            target = F.lit("category")
        parts.append(F.struct(F.lit(f.name).alias("column"),
                              F.lit(_source_name(f.dataType)).alias("source_type"),
                              (lo if k != "object" else F.lit(None).cast("double")).alias("min"),
                              hi.alias("max"), target.alias("target_type"),
                              (lo if k == "object" else F.lit(None).cast("double"))
                              .alias("n_categories")))
    plan = wide.select("n_rows", F.inline(F.array(*parts)))
    spark_type = F.create_map(*[x for kv in SPARK_TYPE.items() for x in map(F.lit, kv)])
    return plan.withColumn("spark_type", spark_type[F.col("target_type")])


def _width(type_col, n_cat):
    w = F.create_map(*[x for kv in WIDTH.items() for x in map(F.lit, kv)])
    code = (F.when(n_cat < 128, 1).when(n_cat < 32768, 2).otherwise(4))
    return F.when(type_col == "category", code).otherwise(w[type_col])


def downcast_report(df: DataFrame) -> DataFrame:
    """Bytes before and after the narrow types (rows x width per column;
    a category column costs its code width plus 8 bytes per category)."""
    p = downcast_plan(df)
    before = F.col("n_rows") * _width(F.col("source_type"), F.lit(0))
    after = (F.col("n_rows") * _width(F.col("target_type"), F.col("n_categories"))
             + F.when(F.col("target_type") == "category", F.col("n_categories") * 8)
                .otherwise(0))
    return p.agg(F.sum(before).cast("long").alias("bytes_before"),
                 F.sum(after).cast("long").alias("bytes_after")).withColumn(
        "pct_saved", (F.col("bytes_before") - F.col("bytes_after")) * 100.0 / F.col("bytes_before"))


def apply_downcast(df: DataFrame, plan_rows) -> DataFrame:
    """Cast each numeric column to its planned Spark type (plan rows: one per
    column, so bounded by the schema width)."""
    for r in plan_rows:
        if r["target_type"] != "category":
            df = df.withColumn(r["column"], F.col(r["column"]).cast(r["spark_type"]))
    return df


def encode_category(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """String to category code in alphabetical order, null stays null.
    Labels are numbered by distributed cumulative counts, so they never meet
    in one task or on the driver."""
    from assayline.operators import ranks as R
    out = out or f"{column}_code"
    codes = R.cumulative_counts(df.select(column).distinct(), column).select(
        F.col(column).alias("_label"), F.col("_before").cast("int").alias("_code"))
    return (df.join(codes, df[column] == codes["_label"], "left")
              .select(*df.columns, F.col("_code").alias(out)))


def head(df: DataFrame, keys: Sequence[str], n: int = 5) -> DataFrame:
    """T4: first n rows in key order (a top-k: Spark keeps n rows per task)."""
    return df.orderBy(*keys).limit(n)
