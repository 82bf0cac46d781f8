"""Inventory efficiency and working-capital reports (Q301-Q308)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import ratio
from shelfwise.labels import (
    BUFFER_STATUS,
    COVERAGE_STATUS,
    INVENTORY_PRIORITY,
    PAIR_REPLENISHMENT_STATUS,
    VALUE_SEGMENT,
)
from shelfwise.operators.common import first_match, money, ordered, pair_tiebreak, r2, r3, top
from shelfwise.operators.metrics import as_inventory, group_metrics
from shelfwise.operators.ranking import By, range_sums, with_running_sum
from shelfwise.params import DEFAULT, Params
from shelfwise.schema import PAIR
from shelfwise.sources.store import ensure_checkpoint_dir


def overall(df, params: Params = DEFAULT) -> DataFrame:
    """Q301: whole-table demand, stock, value, cover and turnover."""
    m = group_metrics(
        df, [], "records", "demand", "inventory", "inventory_value", "cover", "total_demand",
        params=params, distinct=["SKU_ID", "Warehouse_ID"],
    )
    return m.select(
        F.col("records").alias("total_records"),
        F.col("distinct_SKU_ID").alias("total_skus"),
        F.col("distinct_Warehouse_ID").alias("total_warehouses"),
        r2("demand").alias("avg_daily_demand"),
        r2("inventory").alias("avg_inventory"),
        money("inventory_value").alias("estimated_inventory_value"),
        r2("cover").alias("avg_days_of_cover"),
        # "annualized" turnover is SUM(units) / AVG(inventory), no annual factor
        r2(ratio("total_demand", "inventory")).alias("annualized_inventory_turnover"),
    )


def warehouse_efficiency(df, params: Params = DEFAULT) -> DataFrame:
    """Q302: demand, stock, cover, value and turnover per warehouse."""
    m = group_metrics(
        df, ["Warehouse_ID"], "demand", "inventory", "reorder_point", "cover",
        "inventory_value", "total_demand", params=params, distinct=["SKU_ID"],
    ).select(
        "Warehouse_ID",
        F.col("distinct_SKU_ID").alias("active_skus"),
        r2("demand").alias("avg_daily_demand"),
        r2("inventory").alias("avg_inventory"),
        r2("reorder_point").alias("avg_reorder_point"),
        r2("cover").alias("days_of_cover"),
        money("inventory_value").alias("inventory_value"),
        r2(ratio("total_demand", "inventory")).alias("inventory_turnover"),
    )
    return ordered(m, [F.col("inventory_value").desc(), "Warehouse_ID"])


def pair_profile(df, params: Params = DEFAULT) -> DataFrame:
    """Q303: SKU x warehouse profile, top by inventory value."""
    m = group_metrics(
        df, PAIR, "demand", "inventory", "reorder_point", "cover", "inventory_value",
        "total_demand", params=params,
    ).select(
        *PAIR,
        r2("demand").alias("avg_daily_demand"),
        r2("inventory").alias("avg_inventory"),
        r2("reorder_point").alias("avg_reorder_point"),
        r2("cover").alias("days_of_cover"),
        money("inventory_value").alias("inventory_value"),
        r2(ratio("total_demand", "inventory")).alias("inventory_turnover"),
    )
    return top(m, [F.col("inventory_value").desc(), *pair_tiebreak()], params.pair_profile_top)


def coverage_risk(df, params: Params = DEFAULT) -> DataFrame:
    """Q304: days of cover against supplier lead time."""
    m = group_metrics(df, PAIR, "demand", "inventory", "lead_time", "cover", params=params)
    c, lt = F.col("cover"), F.col("lead_time")
    status = first_match([c < lt, c <= lt * params.high_cover_lead_multiple], COVERAGE_STATUS)
    out = m.select(
        *PAIR,
        r2("demand").alias("avg_daily_demand"),
        r2("inventory").alias("avg_inventory"),
        r2(lt).alias("avg_lead_time"),
        r2(c).alias("days_of_cover"),
        r2(F.col("demand") * lt).alias("lead_time_demand"),
        r2(c - lt).alias("cover_above_lead_time"),
        status.alias("coverage_status"),
    )
    return ordered(out, [F.col("days_of_cover").desc_nulls_last(), *pair_tiebreak()])


def reorder_buffer(df, params: Params = DEFAULT) -> DataFrame:
    """Q305: stock above the reorder point, in units and value."""
    m = group_metrics(df, PAIR, "inventory", "reorder_point", "unit_cost", params=params)
    inv, rop = F.col("inventory"), F.col("reorder_point")
    status = first_match(
        [inv < rop, inv <= rop * params.buffer_tight, inv <= rop * params.buffer_healthy],
        BUFFER_STATUS,
    )
    out = m.select(
        *PAIR,
        r2(inv).alias("avg_inventory"),
        r2(rop).alias("avg_reorder_point"),
        r2(inv - rop).alias("inventory_buffer_units"),
        r2((inv - rop) * F.col("unit_cost")).alias("buffer_value"),
        status.alias("buffer_status"),
    )
    return ordered(out, [F.col("buffer_value").desc_nulls_last(), *pair_tiebreak()])


_VALUE_ORDER = [By("value", desc=True, nulls_last=True), By("SKU_ID")]


def _sku_values(inv, params: Params) -> DataFrame:
    sku = group_metrics(inv, ["SKU_ID"], "inventory_value", params=params).withColumnRenamed("inventory_value", "value")
    if inv.stored("sku"):
        return sku
    # an aggregate of plain rows, read for its ranges and again for the sums
    ensure_checkpoint_dir(sku.sparkSession)
    return sku.checkpoint()


def value_ranges(df, ranges: int) -> dict:
    """The histogram of value over all SKUs, most valuable first (stored with a lattice)."""
    inv = as_inventory(df)
    return range_sums(_sku_values(inv, DEFAULT), "value", _VALUE_ORDER, ranges)


def abc_concentration(df, params: Params = DEFAULT) -> DataFrame:
    """Q306: ABC (Pareto) classes of SKUs by running share of inventory value.

    The SKU that crosses a line falls in the lower class; a zero total gives C.
    """
    inv = as_inventory(df, params)
    known = inv.marks.get("value_ranges")
    ranked = with_running_sum(_sku_values(inv, params), "value", _VALUE_ORDER, "cumulative", params, "total", known)
    total = F.nullif(F.col("total"), F.lit(0)).cast("double")
    share = F.col("cumulative").cast("double") / total
    segment = first_match([share <= params.abc_a_share, share <= params.abc_b_share], VALUE_SEGMENT)
    out = ranked.select(
        "SKU_ID",
        money("value").alias("inventory_value"),
        r2((F.col("value") * 100).cast("double") / total).alias("inventory_value_percentage"),
        r2((F.col("cumulative") * 100).cast("double") / total).alias(
            "cumulative_value_percentage"
        ),
        segment.alias("value_segment"),
    )
    return ordered(out, [F.col("inventory_value").desc_nulls_last(), "SKU_ID"])


def replenishment_efficiency(df, params: Params = DEFAULT) -> DataFrame:
    """Q307: ordered / sold per pair."""
    m = group_metrics(
        df, PAIR, "total_demand", "total_replenished", "replenishment_events", "lead_time",
        params=params,
    )
    rr = ratio("total_replenished", "total_demand")
    status = first_match([rr < params.repl_low, rr <= params.repl_high], PAIR_REPLENISHMENT_STATUS)
    out = m.select(
        *PAIR,
        "total_demand",
        "total_replenished",
        "replenishment_events",
        r2("lead_time").alias("avg_lead_time"),
        r3(rr).alias("replenishment_to_demand_ratio"),
        status.alias("replenishment_status"),
    )
    return ordered(
        out,
        [F.col("replenishment_to_demand_ratio").desc_nulls_last(), *pair_tiebreak()],
    )


def priority_ranking(df, params: Params = DEFAULT) -> DataFrame:
    """Q308: cover score + buffer score -> management priority."""
    m = group_metrics(
        df, PAIR, "demand", "inventory", "cover", "lead_time", "reorder_point",
        "inventory_value", params=params,
    )
    c, lt = F.col("cover"), F.col("lead_time")
    inv, rop = F.col("inventory"), F.col("reorder_point")
    cover_score = (
        F.when(c > lt * params.high_cover_lead_multiple, 2).when(c > lt, 1).otherwise(0)
    )
    buffer_score = (
        F.when(inv > rop * params.overstock_rop_multiple, 2).when(inv > rop, 1).otherwise(0)
    )
    score = cover_score + buffer_score
    out = m.select(
        *PAIR,
        r2("demand").alias("avg_daily_demand"),
        r2(inv).alias("avg_inventory"),
        r2(c).alias("days_of_cover"),
        r2(lt).alias("avg_lead_time"),
        r2(rop).alias("avg_reorder_point"),
        money("inventory_value").alias("inventory_value"),
        score.alias("inventory_priority_score"),
        first_match([score >= 3, score == 2], INVENTORY_PRIORITY).alias("management_priority"),
    )
    return ordered(out, [F.col("inventory_priority_score").desc(),
        F.col("inventory_value").desc(),
        *pair_tiebreak()])
