"""Supplier performance and replenishment reports (Q501-Q506)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import ratio
from shelfwise.labels import LEAD_TIME_RISK, SUPPLIER_REPLENISHMENT_STATUS, SUPPLY_RISK
from shelfwise.operators.common import first_match, ordered, pair_tiebreak, r2, r3
from shelfwise.operators.metrics import group_metrics
from shelfwise.params import DEFAULT, Params
from shelfwise.schema import PAIR


def overall(df, params: Params = DEFAULT) -> DataFrame:
    """Q501: replenishment events, their rate and mean size (zero orders skipped)."""
    return group_metrics(
        df, [], "records", "replenishment_events", "replenishment_share",
        "avg_order_nonzero", "lead_time", params=params,
    ).select(
        F.col("records").alias("total_records"),
        "replenishment_events",
        r2(F.lit(100) * F.col("replenishment_share")).alias("replenishment_rate"),
        r2("avg_order_nonzero").alias("avg_order_quantity"),
        r2("lead_time").alias("avg_lead_time"),
    )


def profile(df, params: Params = DEFAULT) -> DataFrame:
    """Q502: per-supplier footprint, lead time, order size and unit cost."""
    m = group_metrics(
        df, ["Supplier_ID"], "lead_time", "avg_order_nonzero", "replenishment_events",
        "unit_cost", params=params, distinct=["SKU_ID", "Warehouse_ID"],
    ).select(
        "Supplier_ID",
        F.col("distinct_SKU_ID").alias("sku_count"),
        F.col("distinct_Warehouse_ID").alias("warehouse_count"),
        r2("lead_time").alias("avg_lead_time"),
        r2("avg_order_nonzero").alias("avg_order_quantity"),
        "replenishment_events",
        r2("unit_cost").alias("avg_unit_cost"),
    )
    return ordered(m, [F.col("avg_lead_time").desc_nulls_last(), "Supplier_ID"])


def replenishment_efficiency(df, params: Params = DEFAULT) -> DataFrame:
    """Q503: ordered / sold per supplier."""
    m = group_metrics(
        df, ["Supplier_ID"], "total_demand", "total_replenished", "replenishment_events",
        params=params,
    )
    rr = ratio("total_replenished", "total_demand")
    status = first_match(
        [rr < params.repl_low, rr <= params.repl_high], SUPPLIER_REPLENISHMENT_STATUS
    )
    out = m.select(
        "Supplier_ID",
        "total_demand",
        "total_replenished",
        "replenishment_events",
        r3(rr).alias("replenishment_ratio"),
        status.alias("replenishment_status"),
    )
    return ordered(out, [F.col("replenishment_ratio").desc_nulls_last(), "Supplier_ID"])


def lead_time_risk(df, params: Params = DEFAULT) -> DataFrame:
    """Q504: lead-time level and (population) spread per supplier."""
    m = group_metrics(
        df, ["Supplier_ID"], "lead_time", "lead_time_std", "min_lead_time", "max_lead_time",
        params=params,
    )
    a = F.col("lead_time")
    risk = first_match([a >= params.lead_high_days, a >= params.lead_medium_days], LEAD_TIME_RISK)
    out = m.select(
        "Supplier_ID",
        r2(a).alias("avg_lead_time"),
        r2("lead_time_std").alias("lead_time_std"),
        "min_lead_time",
        "max_lead_time",
        risk.alias("lead_time_risk"),
    )
    return ordered(out, [F.col("avg_lead_time").desc_nulls_last(), "Supplier_ID"])


def replenishment_gaps(df, params: Params = DEFAULT) -> DataFrame:
    """Q505: pairs whose ordered / sold ratio lies outside the balanced band."""
    m = group_metrics(
        df, PAIR, "demand", "total_demand", "total_replenished", "replenishment_events",
        params=params,
    )
    rr = ratio("total_replenished", "total_demand")
    out = m.filter((rr < params.repl_low) | (rr > params.repl_high)).select(
        *PAIR,
        r2("demand").alias("avg_daily_demand"),
        "total_replenished",
        "replenishment_events",
        r3(rr).alias("replenishment_ratio"),
    )
    return ordered(out, [F.col("replenishment_ratio").asc_nulls_first(), *pair_tiebreak()])


def high_risk_combinations(df, params: Params = DEFAULT) -> DataFrame:
    """Q506: supplier x SKU x warehouse with cover below 1.5 x lead time."""
    keys = ["Supplier_ID", *PAIR]
    m = group_metrics(df, keys, "lead_time", "demand", "inventory", "cover", params=params)
    c, lt = F.col("cover"), F.col("lead_time")
    risk = first_match([c < lt, c < lt * params.supply_monitor_multiple], SUPPLY_RISK)
    out = m.filter(c < lt * params.supply_monitor_multiple).select(
        *keys,
        r2(lt).alias("avg_lead_time"),
        r2("demand").alias("avg_daily_demand"),
        r2("inventory").alias("avg_inventory"),
        r2(c).alias("days_of_cover"),
        risk.alias("supply_risk"),
    )
    return ordered(out, [F.col("days_of_cover").asc_nulls_first(), *keys])
