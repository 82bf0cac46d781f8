"""Variants of the derived fact table that exercise the ingest rules on every row.

* ``dirty_inventory``: a deterministic share of rows breaks each kind of rule
  (NULLs, over-long keys, negative and zero measures, bad flags) and another is
  repeated, as a whole or by business key only;
* ``mixed_case_inventory``: keys that differ in case and accents only;
* ``typed_copy``: the table written as CSV and read back with the fixed schema.

Which rows change follows from their own values, so any engine can derive the
same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.schema import COLUMNS
from shelfwise.sources import store
from shelfwise.sources.loader import read_inventory


def _mark():
    return F.col("Units_Sold") + F.col("Inventory_Level") + F.col("Reorder_Point")


def dirty_inventory(fact: DataFrame) -> DataFrame:
    x = _mark()
    change = {
        "SKU_ID": F.when(x % 101 == 3, F.lit(None)).when(x % 103 == 5, F.concat("SKU_ID", F.lit("_LONGER_THAN_TWENTY"))),
        "Region": F.when(x % 107 == 7, F.lit(None)),
        "Units_Sold": F.when(x % 109 == 11, F.lit(-1)),
        "Unit_Cost": F.when(x % 113 == 2, F.lit(0)),
        "Promotion_Flag": F.when(x % 127 == 9, F.lit(2)).when(x % 131 == 4, F.lit(None)),
        "Supplier_Lead_Time_Days": F.when(x % 137 == 6, F.lit(0)),
        "Demand_Forecast": F.when(x % 139 == 8, F.lit(None)),
    }
    # a branch of its own for the unchanged value, since a changed one may be NULL
    broken = fact.select(
        *[change[c].otherwise(F.col(c)).cast(fact.schema[c].dataType).alias(c) if c in change else F.col(c) for c in COLUMNS]
    )
    again = fact.filter(x % 89 == 1)
    other = fact.filter(x % 97 == 2).withColumn("Order_Quantity", F.col("Order_Quantity") + 1)
    return broken.unionByName(again).unionByName(other).select(*COLUMNS)


def mixed_case_inventory(fact: DataFrame) -> DataFrame:
    x = _mark()
    return fact.withColumn("SKU_ID", F.when(x % 2 == 1, F.lower("SKU_ID")).otherwise(F.col("SKU_ID"))).withColumn(
        "Warehouse_ID", F.when(x % 3 == 1, F.concat(F.lit("wĤ"), F.substring("Warehouse_ID", 3, 20))).otherwise(F.col("Warehouse_ID"))
    )


def typed_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table by way of a CSV copy whose columns are bound by its header."""
    path = store.derived_path(spark, sf_dir, "typed_csv", lambda: store.inventory_table(spark, sf_dir), fmt="csv")
    return read_inventory(spark, path, fmt="csv")


def stored_dirty_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.derived_path(spark, sf_dir, "dirty", lambda: dirty_inventory(store.sized_table(spark, sf_dir)))
    return read_inventory(store.work_session(spark, sf_dir), path)
