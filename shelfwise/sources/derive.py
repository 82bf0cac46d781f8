"""Derive the daily inventory fact table from TPC-H style tables.

The inventory scripts ship no data, so the fact table is derived from
``lineitem`` (+ ``supplier``, ``nation``, ``region``): ship date -> Date,
part key -> SKU, order key mod 5 -> one of the five warehouses that serve the
part's group of 500, the day's (smallest) supplier key -> supplier, its region ->
Region.  SKUs and suppliers are whole keys and warehouses follow the parts, so
the fact table and all its grains but flags grow with the input; a day's SKU
and warehouse nearly always have one line.  The remaining measures are
integer / decimal formulas of those keys, so Spark and any SQL engine produce
the same rows (see FIXTURES.md; ``FIXTURE_SQL`` is the same derivation as SQL
text for the DuckDB oracle).  Nothing is filtered: every lineitem row
contributes to exactly one daily snapshot row, and a supplier, nation or
region that is unknown leaves Region NULL for the row contract to find.

Plan shape: lineitem scan (6 of 11 columns, no filter) -> partial
HashAggregate on (day, sku, warehouse) -> one shuffle -> final aggregate.
``keyed_days`` gives these narrow rows with their text keys; a table that is laid out for
storing moves and sorts them, and ``with_measures`` computes the 15 columns afterwards.
No join is hinted: ``supplier`` grows with scale, so the planner picks a
broadcast from its size (``spark.sql.autoBroadcastJoinThreshold``, AQE at
run time) and a sort-merge join beyond it; ``nation`` / ``region`` are
TPC-H's fixed 25 / 5-row dimensions and are broadcast the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.schema import COLUMNS


#: Warehouses that stock a part, and parts that share them: warehouses grow with the parts, pairs don't multiply.
STORES, SITE_PARTS = 5, 500


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def source_frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    lineitem = _read(spark, sf_dir, "lineitem")
    supplier = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = _read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = _read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return lineitem, supplier, nation, region


def derive_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory fact table (schema ``INVENTORY_SCHEMA``) from the tables in sf_dir."""
    return derive_from_frames(*source_frames(spark, sf_dir))


def derive_from_frames(lineitem, supplier, nation, region) -> DataFrame:
    return with_measures(keyed_days(lineitem, supplier, nation, region))


def keyed_days(lineitem, supplier, nation, region) -> DataFrame:
    """One narrow row per day, part and warehouse: the table's keys and what its measures are computed from."""
    src = lineitem.select(
        F.col("l_shipdate").cast("date").alias("d"),
        F.col("l_partkey").cast("bigint").alias("pk"),
        (F.col("l_orderkey") % STORES).cast("int").alias("w"),
        F.col("l_quantity").cast("int").alias("q"),
        F.col("l_suppkey").cast("bigint").alias("sk"),
        F.when(F.col("l_discount") >= 0.08, 1).otherwise(0).alias("promo"),
    )
    grain = (
        src.groupBy("d", "pk", "w")
        .agg(
            F.sum("q").cast("int").alias("q"),
            F.min("sk").alias("sk"),
            F.max("promo").alias("promo"),
        )
    )
    # grain -> supplier -> nation -> region: every join has the aggregate on
    # the probe side, so the planner's size checks broadcast the dimension
    # whenever it is small and fall back to sort-merge join when it is not.
    pk, w = F.col("pk"), F.col("w")
    return (
        grain.join(supplier, grain.sk == supplier.s_suppkey, "left")
        .join(nation, F.col("s_nationkey") == nation.n_nationkey, "left")
        .join(region, F.col("n_regionkey") == region.r_regionkey, "left")
    ).select(
        F.col("d").alias("Date"),
        F.concat(F.lit("SKU_"), (1000 + pk).cast("string")).alias("SKU_ID"),
        F.concat(F.lit("WH_"), (1 + w + STORES * F.expr(f"pk div {SITE_PARTS}")).cast("string")).alias("Warehouse_ID"),
        F.col("r_name").alias("Region"),
        (pk % 200).cast("int").alias("p"),
        "w",
        "q",
        "sk",
        "promo",
    )


def with_measures(days: DataFrame) -> DataFrame:
    """The fact table from ``keyed_days``, row by row."""
    days = days.withColumn("t", (F.year("Date") * 372 + F.month("Date") * 31 + F.dayofmonth("Date")).cast("int"))
    p, w, t, q = F.col("p"), F.col("w"), F.col("t"), F.col("q")
    keyed = days.select(
        "*",
        (F.col("sk") % 10).cast("int").alias("sup"),
        F.when(p == 199, 0)
        .when(((p % 20) == 3) & ((t % 5) == 0), 0)
        .otherwise(p % 10 + q)
        .alias("units"),
        (20 + (p * 13 + w * 29) % 400).alias("rop"),
    )
    stocked = keyed.withColumn(
        "inv",
        F.when(((p % 4) == 1) & (w < 3) & ((t % 11) == 0), 0).otherwise(
            (p * 37 + w * 61) % 700 + t % 40 + F.when(w == 4, 800).otherwise(0)
        ),
    )
    sup, units = F.col("sup"), F.col("units")
    base_cost = (500 + p * 37 + w * 11) * F.expr("0.01")
    order_mult = (
        F.when(sup < 3, 2).when(sup < 7, 3).otherwise(4)
        + F.when((p % 10) == 0, 1).when((p % 10) == 1, -1).otherwise(0)
    )
    out = stocked.select(
        "Date",
        "SKU_ID",
        "Warehouse_ID",
        F.concat(F.lit("SUP_"), (10 + F.col("sk")).cast("string")).alias("Supplier_ID"),
        "Region",
        units.cast("int").alias("Units_Sold"),
        F.col("inv").cast("int").alias("Inventory_Level"),
        (2 + sup + t % 3).cast("int").alias("Supplier_Lead_Time_Days"),
        F.col("rop").cast("int").alias("Reorder_Point"),
        F.when(((t + p) % 3) == 0, units * order_mult)
        .otherwise(0)
        .cast("int")
        .alias("Order_Quantity"),
        base_cost.cast("decimal(10,2)").alias("Unit_Cost"),
        (base_cost * F.when(p == 7, F.expr("0.95")).otherwise(F.expr("1.40")))
        .cast("decimal(10,2)")
        .alias("Unit_Price"),
        F.col("promo").cast("int").alias("Promotion_Flag"),
        F.when(F.col("inv") == 0, 1).otherwise(0).alias("Stockout_Flag"),
        (
            units
            + F.when(units < 5, F.expr("0.25")).otherwise((t % 9 - 4) * F.expr("0.75"))
        )
        .cast("decimal(10,2)")
        .alias("Demand_Forecast"),
    )
    return out.select(*COLUMNS)


# The same derivation as SQL text; it runs unchanged in Spark SQL and DuckDB
# (FIXTURES.md section 2).  Used as ``WITH inventory_raw AS (...)`` by the
# oracle queries.
FIXTURE_SQL = """
WITH src AS (
  SELECT CAST(l_shipdate AS DATE) AS d, CAST(l_partkey AS BIGINT) AS pk, CAST(l_orderkey % 5 AS INT) AS w,
         CAST(l_quantity AS INT) AS q, CAST(l_suppkey AS BIGINT) AS sk,
         CASE WHEN l_discount >= 0.08 THEN 1 ELSE 0 END AS promo
  FROM lineitem
), grain AS (
  SELECT d, pk, CAST(pk % 200 AS INT) AS p, w, CAST(SUM(q) AS INT) AS q, MIN(sk) AS sk, MAX(promo) AS promo,
         CAST(YEAR(d) * 372 + MONTH(d) * 31 + DAY(d) AS INT) AS t
  FROM src GROUP BY d, pk, w
), keyed AS (
  SELECT g.*, CAST(g.sk % 10 AS INT) AS sup, r.r_name AS reg,
         CASE WHEN g.p = 199 THEN 0
              WHEN g.p % 20 = 3 AND g.t % 5 = 0 THEN 0
              ELSE g.p % 10 + g.q END AS units,
         20 + (g.p * 13 + g.w * 29) % 400 AS rop
  FROM grain g
  LEFT JOIN supplier s ON s.s_suppkey = g.sk
  LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey
  LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
), stocked AS (
  SELECT k.*,
         CASE WHEN p % 4 = 1 AND w < 3 AND t % 11 = 0 THEN 0
              ELSE (p * 37 + w * 61) % 700 + t % 40 + (CASE WHEN w = 4 THEN 800 ELSE 0 END) END AS inv
  FROM keyed k
)
SELECT d AS Date,
       CONCAT('SKU_', CAST(1000 + pk AS VARCHAR(20))) AS SKU_ID,
       CONCAT('WH_', CAST(CAST(1 + w + 5 * ((pk - pk % 500) / 500) AS BIGINT) AS VARCHAR(20))) AS Warehouse_ID,
       CONCAT('SUP_', CAST(10 + sk AS VARCHAR(20))) AS Supplier_ID,
       reg AS Region,
       units AS Units_Sold,
       inv AS Inventory_Level,
       CAST(2 + sup + t % 3 AS INT) AS Supplier_Lead_Time_Days,
       rop AS Reorder_Point,
       CASE WHEN (t + p) % 3 = 0
            THEN units * ((CASE WHEN sup < 3 THEN 2 WHEN sup < 7 THEN 3 ELSE 4 END)
                        + (CASE p % 10 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END))
            ELSE 0 END AS Order_Quantity,
       CAST((500 + p * 37 + w * 11) * 0.01 AS DECIMAL(10,2)) AS Unit_Cost,
       CAST((500 + p * 37 + w * 11) * 0.01 * (CASE WHEN p = 7 THEN 0.95 ELSE 1.40 END) AS DECIMAL(10,2)) AS Unit_Price,
       promo AS Promotion_Flag,
       CASE WHEN inv = 0 THEN 1 ELSE 0 END AS Stockout_Flag,
       CAST(units + (CASE WHEN units < 5 THEN 0.25 ELSE (t % 9 - 4) * 0.75 END) AS DECIMAL(10,2)) AS Demand_Forecast
FROM stocked
"""
