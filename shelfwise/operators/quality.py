"""Data-quality and validation reports (Q201-Q214)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.labels import COVERAGE_CHECK
from shelfwise.labels import DIMENSIONS as DIMENSION_LABELS
from shelfwise.operators.common import first_match, ordered, r2, round_half_up
from shelfwise.operators.metrics import DIMENSIONS, as_inventory, group_metrics
from shelfwise.operators.quality_rules import COMMERCIAL_CHECKS, NULL_COUNT_NAMES, RULE_VIOLATIONS
from shelfwise.params import DEFAULT, Params
from shelfwise.schema import COLUMNS, GRAIN

#: Words of the map of repeated hashes: 64 M bits, whatever the input.
MAP_WORDS = 1 << 20


def _summed(df, params: Params, names: list[tuple[str, str]]) -> DataFrame:
    """One row of row counts held by the total grain: (column, output name)."""
    m = group_metrics(df, [], *[c for c, _ in names], params=params)
    return m.select(*[F.col(c).alias(n) for c, n in names])


def row_count(df: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Q201: number of rows."""
    return _summed(df, params, [("records", "total_rows")])


def span_cardinality(df: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Q202: date span and exact distinct counts, held by the total grain (one row)."""
    m = group_metrics(df, [], "start_date", "end_date", params=params, distinct=DIMENSIONS)
    return m.select(
        "start_date",
        "end_date",
        F.col("distinct_Date").alias("unique_dates"),
        F.col("distinct_SKU_ID").alias("unique_skus"),
        F.col("distinct_Warehouse_ID").alias("unique_warehouses"),
        F.col("distinct_Supplier_ID").alias("unique_suppliers"),
        F.col("distinct_Region").alias("unique_regions"),
    )


def null_counts(df: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Q203: NULLs per column (counted with the total grain)."""
    return _summed(df, params, [(f"qc_{n}", n) for _, n in NULL_COUNT_NAMES])


def duplicate_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups of ``keys`` occurring more than once, with their row count.

    Exact, but shuffles 16 bytes per row instead of the whole key: a 64-bit
    hash of the key is counted first (partial aggregation folds repeated
    hashes per task), and the exact GROUP BY runs on the rows whose hash may repeat.
    Those are told by a map of MAP_WORDS x 64 bits, in which the repeated hashes are marked and
    which every task gets, so no row is moved to find them, whatever the number of repeats; a
    full map or hash collisions only add candidates, and the final GROUP BY removes them.
    A 64-bit hash does not follow a collation, so collated keys go to the GROUP BY directly.
    """
    if any(_collated(df, c) for c in keys):
        return _repeated_groups(df, keys)
    h = F.xxhash64(*[F.col(c) for c in keys])
    repeated = df.select(h.alias("_h")).groupBy("_h").count().filter(F.col("count") > 1)
    marks = repeated.groupBy(_word(F.col("_h")).alias("_word")).agg(F.bit_or(_bit(F.col("_h"))).alias("_bits"))
    marked = (_word(h) == F.col("_word")) & (F.col("_bits").bitwiseAND(_bit(h)) != 0)
    return _repeated_groups(df.join(F.broadcast(marks), marked, "left_semi"), keys)


def _word(h: Column) -> Column:
    return F.pmod(h, F.lit(MAP_WORDS))


def _bit(h: Column) -> Column:
    """One of 64 bits, from the hash's bits above those of the word."""
    return F.call_function("shiftleft", F.expr("1L"), F.pmod(F.shiftright(h, 20), F.lit(64)).cast("int"))


def _collated(df: DataFrame, column: str) -> bool:
    kind = df.schema[column].dataType
    return isinstance(kind, T.StringType) and kind.simpleString() != "string"


def _repeated_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("record_count"))
        .filter(F.col("record_count") > 1)
    )


def full_row_duplicates(df: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Q204: number of distinct full rows that occur more than once (of a stored inventory, found when it was stored)."""
    inv = as_inventory(df)
    groups = inv.table("repeated_rows") if inv.stored("repeated_rows") else duplicate_groups(inv.fact, COLUMNS)
    return groups.agg(F.count(F.lit(1)).alias("duplicate_full_rows"))


def business_key_duplicates(df: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Q205: Date x SKU x Warehouse keys with more than one row (of a stored inventory, found when it was stored)."""
    inv = as_inventory(df)
    groups = inv.table("repeated_keys") if inv.stored("repeated_keys") else duplicate_groups(inv.fact, GRAIN)
    return groups.select(*GRAIN, "record_count")


def rule_violations(df: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Q206: rows breaking each domain rule (NULL input is not counted)."""
    return _summed(df, params, [(f"qc_{n}", n) for n, _ in RULE_VIOLATIONS])


def commercial_logic(df: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Q207: rows priced at or below cost; orders placed at zero stock."""
    return _summed(df, params, [(f"qc_{n}", n) for n, _ in COMMERCIAL_CHECKS])


def coverage(df: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Q208: is the Date x SKU x Warehouse cube dense?"""
    d = "decimal(38,0)"
    m = group_metrics(df, [], "records", params=params, distinct=GRAIN)
    expected = F.col("distinct_Date").cast(d) * F.col("distinct_SKU_ID").cast(d) * F.col("distinct_Warehouse_ID").cast(d)
    return m.select(expected.alias("expected_rows"), F.col("records").alias("actual_rows")).withColumn(
        "coverage_status",
        first_match([F.col("expected_rows") == F.col("actual_rows")], COVERAGE_CHECK),
    )


def _flag_distribution(data, flag: str, params: Params = DEFAULT) -> DataFrame:
    """Rows and share of all rows per flag value, from the flags grain."""
    inv = as_inventory(data, params)
    counts = group_metrics(inv, [flag], "records", params=params)
    total = group_metrics(inv, [], "records", params=params).scalar()
    share = (F.col("records") * 100).cast("double") / F.nullif(total, F.lit(0)).cast("double")
    out = counts.select(flag, "records", round_half_up(share, 2).alias("percentage"))
    return ordered(out, [F.col(flag).asc_nulls_first()])


def promotion_distribution(df: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Q209: rows and share of all rows per promotion flag."""
    return _flag_distribution(df, "Promotion_Flag", params)


def stockout_distribution(df: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Q210: rows and share of all rows per stockout flag."""
    return _flag_distribution(df, "Stockout_Flag", params)


def dimension_cardinality(df: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Q211: distinct values per dimension, unpivoted."""
    keys = DIMENSIONS[1:]
    m = group_metrics(df, [], params=params, distinct=keys)
    wide = m.select(*[F.col(f"distinct_{k}").alias(name) for k, name in zip(keys, DIMENSION_LABELS)])
    return wide.unpivot([], list(DIMENSION_LABELS), "dimension", "unique_values")


def warehouse_profile(df: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Q212: per-warehouse observations, footprint and daily means."""
    m = group_metrics(
        df, ["Warehouse_ID"], "records", "demand", "inventory", "reorder_point", "avg_order_all",
        "avg_row_value", params=params, distinct=["SKU_ID", "Supplier_ID"],
    ).select(
        "Warehouse_ID",
        F.col("records").alias("observations"),
        F.col("distinct_SKU_ID").alias("active_skus"),
        F.col("distinct_Supplier_ID").alias("suppliers"),
        r2("demand").alias("avg_daily_demand"),
        r2("inventory").alias("avg_inventory"),
        r2("reorder_point").alias("avg_reorder_point"),
        r2("avg_order_all").alias("avg_order_quantity"),
        r2("avg_row_value").alias("avg_inventory_value"),
    )
    return ordered(m, [F.col("avg_inventory_value").desc_nulls_last(), "Warehouse_ID"])


def sku_profile(df: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Q213: top SKUs by mean daily inventory value."""
    m = group_metrics(
        df, ["SKU_ID"], "total_demand", "demand", "inventory", "avg_row_value", "unit_margin",
        params=params, distinct=["Warehouse_ID"],
    ).select(
        "SKU_ID",
        F.col("distinct_Warehouse_ID").alias("warehouse_count"),
        F.col("total_demand").alias("total_units_sold"),
        r2("demand").alias("avg_daily_demand"),
        r2("inventory").alias("avg_inventory"),
        r2("avg_row_value").alias("avg_inventory_value"),
        r2("unit_margin").alias("unit_margin"),
    )
    return m.orderBy(F.col("avg_inventory_value").desc_nulls_last(), "SKU_ID").limit(
        params.sku_profile_top
    )


def summary(df: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Q214: validation summary counts."""
    held = ["records", "qc_stockout_records", "qc_promotion_records", "replenishment_events"]
    m = group_metrics(df, [], *held, params=params, distinct=DIMENSIONS)
    return m.select(
        F.col("records").alias("total_records"),
        F.col("distinct_Date").alias("dates"),
        F.col("distinct_SKU_ID").alias("skus"),
        F.col("distinct_Warehouse_ID").alias("warehouses"),
        F.col("distinct_Supplier_ID").alias("suppliers"),
        F.col("distinct_Region").alias("regions"),
        F.col("qc_stockout_records").alias("stockout_records"),
        F.col("qc_promotion_records").alias("promotion_records"),
        F.col("replenishment_events").alias("replenishment_records"),
    )


__all__ = [
    "business_key_duplicates",
    "commercial_logic",
    "coverage",
    "dimension_cardinality",
    "duplicate_groups",
    "full_row_duplicates",
    "group_metrics",
    "null_counts",
    "promotion_distribution",
    "row_count",
    "rule_violations",
    "sku_profile",
    "span_cardinality",
    "stockout_distribution",
    "summary",
    "warehouse_profile",
]
