"""Adapter from the driver's order tables to the three assay tables.

Mapping (one deterministic rule both Spark and the SQL oracle follow):

* a visit is (customer, order year): ``patient_id = o_custkey``,
  ``visit_month = 12 * (year(o_orderdate) - 1995)``,
  ``visit_id = patient_id || '_' || visit_month``;
* ``UniProt = p_brand`` and ``Peptide = p_name`` of the ordered part;
* peptides: ``PeptideAbundance`` = sum of quantity per (visit, UniProt, Peptide);
* proteins: ``NPX`` = sum of extended price per (visit, UniProt), rolled up
  from the peptide grain, so both tables come from one aggregate of the line
  items; a month's aggregate is stored once, so line items are read once;
* clinical, per visit from ``orders``: updrs_1 = orders, updrs_2 =
  floor(max price / 10000), updrs_3 = floor(sum price / 10000),
  updrs_4 = urgent orders, medication 'On'/'Off'/NULL from the smallest status.

Sums run in decimal(18,2) so every engine gets the same bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.session import store
from assayline.tables import AssayTables, MEDICATION_COL

# Fixed values of the mapping.
BASE_YEAR = 1995
URGENT = "1-URGENT"
SCORE_SCALE = 10000

_DEC = "decimal(18,2)"


# Scan handles (lazy DataFrames, no data) per session and path: building a
# scan lists files and reads a footer, which is paid once per session.
_SCANS: dict = {}


def _alive(df: DataFrame | None, spark: SparkSession) -> bool:
    """A memoised handle is used only by its own, still running session."""
    return (df is not None and df.sparkSession is spark
            and spark.sparkContext._jsc is not None)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    key = (id(spark), f"{sf_dir}/{name}.parquet")
    df = _SCANS.get(key)
    if not _alive(df, spark):
        df = _SCANS[key] = spark.read.parquet(key[1])
    return df


def clear_scan_cache() -> None:
    """Forget scan handles (after the files of a folder were replaced)."""
    _SCANS.clear()
    _TABLES.clear()


def _visit_cols(custkey: str, orderdate: str):
    month = (F.lit(12) * (F.year(F.col(orderdate)) - F.lit(BASE_YEAR))).cast("int")
    return [
        F.col(custkey).cast("long").alias("patient_id"),
        month.alias("visit_month"),
        F.concat_ws("_", F.col(custkey).cast("string"), month.cast("string")).alias("visit_id"),
    ]


def _orders(spark: SparkSession, sf_dir: str, month: int | None) -> DataFrame:
    """orders, pruned to one visit month's order year when asked: a plain
    range on o_orderdate reaches the Parquet scan (row-group skipping),
    which ``year(o_orderdate) = ...`` would not."""
    od = _read(spark, sf_dir, "orders")
    if month is None:
        return od
    if month % 12 != 0:
        return od.where(F.lit(False))
    year = BASE_YEAR + month // 12
    return od.where((F.col("o_orderdate") >= F.lit(f"{year}-01-01").cast("timestamp_ntz"))
                    & (F.col("o_orderdate") < F.lit(f"{year + 1}-01-01").cast("timestamp_ntz")))


def visit_items(spark: SparkSession, sf_dir: str, month: int | None = None) -> DataFrame:
    """One row per line item with its visit keys, UniProt and Peptide."""
    li = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    od = _orders(spark, sf_dir, month).select("o_orderkey", "o_custkey", "o_orderdate")
    pt = _read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name")
    # part is the dimension; Catalyst/AQE choose broadcast from its size.
    return (li.join(od, li.l_orderkey == od.o_orderkey)
              .join(pt, li.l_partkey == pt.p_partkey)
              .select(*_visit_cols("o_custkey", "o_orderdate"),
                      F.col("p_brand").alias("UniProt"),
                      F.col("p_name").alias("Peptide"),
                      "l_quantity", "l_extendedprice"))


def _visit_keys():
    return ["visit_id", "visit_month", "patient_id"]


def assay_items(items: DataFrame) -> DataFrame:
    """(visit, UniProt, Peptide, qty, price): the finer grain of both tables."""
    return (items.groupBy(*_visit_keys(), "UniProt", "Peptide")
                 .agg(F.sum(F.col("l_quantity").cast(_DEC)).alias("qty"),
                      F.sum(F.col("l_extendedprice").cast(_DEC)).alias("price")))


def proteins(assay: DataFrame) -> DataFrame:
    return (assay.groupBy(*_visit_keys(), "UniProt")
                 .agg(F.sum("price").cast("double").alias("NPX")))


def peptides(assay: DataFrame) -> DataFrame:
    return assay.select(*_visit_keys(), "UniProt", "Peptide",
                        F.col("qty").cast("double").alias("PeptideAbundance"))


def clinical(spark: SparkSession, sf_dir: str, month: int | None = None) -> DataFrame:
    od = _orders(spark, sf_dir, month).select(
        "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus", "o_orderpriority")
    status = F.min("o_orderstatus")
    return (od.select(*_visit_cols("o_custkey", "o_orderdate"),
                      "o_totalprice", "o_orderstatus", "o_orderpriority")
              .groupBy(*_visit_keys())
              .agg(F.count(F.lit(1)).cast("double").alias("updrs_1"),
                   F.floor(F.max("o_totalprice") / F.lit(SCORE_SCALE)).cast("double").alias("updrs_2"),
                   F.floor(F.sum(F.col("o_totalprice").cast(_DEC)) / F.lit(SCORE_SCALE))
                    .cast("double").alias("updrs_3"),
                   F.sum(F.when(F.col("o_orderpriority") == F.lit(URGENT), 1).otherwise(0))
                    .cast("double").alias("updrs_4"),
                   F.when(status == F.lit("O"), F.lit("On"))
                    .when(status == F.lit("F"), F.lit("Off")).alias(MEDICATION_COL)))


def load_tables(spark: SparkSession, sf_dir: str, month: int | None = None) -> AssayTables:
    """S1 on the driver tables: the three assay tables, lazily. The month
    filter (P1) calls back here to prune the scans to one order year; that
    month's aggregate is stored, since both tables read it. Handles are memoised
    per session, so a month's line items are aggregated once a session; after
    the files of a folder were replaced, call :func:`clear_scan_cache`."""
    key = (id(spark), sf_dir, month)
    if key not in _TABLES or not _alive(_TABLES[key].clinical, spark):
        assay = assay_items(visit_items(spark, sf_dir, month))
        if month is not None:
            assay = store(assay, "assay")
        _TABLES[key] = AssayTables(proteins(assay), peptides(assay),
                                   clinical(spark, sf_dir, month),
                                   month_pruner=lambda m: load_tables(spark, sf_dir, m))
    return _TABLES[key]


_TABLES: dict = {}


# DuckDB text of the same mapping, used by the oracle queries.
ORACLE_CTES = f"""
visit_items AS (
  SELECT o_custkey AS patient_id,
         CAST(12 * (year(o_orderdate) - {BASE_YEAR}) AS INTEGER) AS visit_month,
         CAST(o_custkey AS VARCHAR) || '_' || CAST(12 * (year(o_orderdate) - {BASE_YEAR}) AS VARCHAR) AS visit_id,
         p_brand AS UniProt, p_name AS Peptide, l_quantity, l_extendedprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
proteins AS (
  SELECT visit_id, visit_month, patient_id, UniProt,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS NPX
  FROM visit_items
  GROUP BY visit_id, visit_month, patient_id, UniProt),
peptides AS (
  SELECT visit_id, visit_month, patient_id, UniProt, Peptide,
         CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS PeptideAbundance
  FROM visit_items GROUP BY visit_id, visit_month, patient_id, UniProt, Peptide),
clinical AS (
  SELECT CAST(o_custkey AS VARCHAR) || '_' || CAST(12 * (year(o_orderdate) - {BASE_YEAR}) AS VARCHAR) AS visit_id,
         o_custkey AS patient_id,
         CAST(12 * (year(o_orderdate) - {BASE_YEAR}) AS INTEGER) AS visit_month,
         CAST(count(*) AS DOUBLE) AS updrs_1,
         CAST(floor(max(o_totalprice) / {SCORE_SCALE}) AS DOUBLE) AS updrs_2,
         CAST(floor(sum(CAST(o_totalprice AS DECIMAL(18,2))) / {SCORE_SCALE}) AS DOUBLE) AS updrs_3,
         CAST(sum(CASE WHEN o_orderpriority = '{URGENT}' THEN 1 ELSE 0 END) AS DOUBLE) AS updrs_4,
         CASE min(o_orderstatus) WHEN 'O' THEN 'On' WHEN 'F' THEN 'Off' END AS {MEDICATION_COL}
  FROM orders GROUP BY 1, 2, 3)"""
