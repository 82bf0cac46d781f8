"""Demand variability and forecast accuracy reports (Q401-Q407)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import ratio
from shelfwise.labels import RISK_STATUS, VOLATILITY_SEGMENT
from shelfwise.operators.common import first_match, ordered, pair_tiebreak, r2, r3, top
from shelfwise.operators.metrics import group_metrics
from shelfwise.params import DEFAULT, Params
from shelfwise.schema import PAIR


def overall(df, params: Params = DEFAULT) -> DataFrame:
    """Q401: demand level, population std-dev and forecast error."""
    m = group_metrics(
        df, [], "records", "demand", "demand_std", "forecast", "forecast_error", params=params
    )
    return m.select(
        F.col("records").alias("total_records"),
        r2("demand").alias("avg_daily_demand"),
        r2("demand_std").alias("demand_std_dev"),
        r2("forecast").alias("avg_forecast"),
        r2("forecast_error").alias("forecast_mae"),
        r2(ratio(F.lit(100) * F.col("forecast_error"), "demand")).alias("forecast_error_pct"),
    )


def sku_volatility(df, params: Params = DEFAULT) -> DataFrame:
    """Q402: per-SKU mean, population std-dev, CV and total demand."""
    m = group_metrics(
        df, ["SKU_ID"], "demand", "demand_std", "demand_cv", "total_demand", params=params
    ).select(
        "SKU_ID",
        r2("demand").alias("avg_daily_demand"),
        r2("demand_std").alias("demand_std_dev"),
        r3("demand_cv").alias("demand_cv"),
        "total_demand",
    )
    return ordered(m, [F.col("demand_cv").desc_nulls_last(), "SKU_ID"])


def pair_forecast_accuracy(df, params: Params = DEFAULT) -> DataFrame:
    """Q403: worst forecast error per pair."""
    m = group_metrics(df, PAIR, "demand", "forecast", "forecast_error", params=params).select(
        *PAIR,
        r2("demand").alias("avg_demand"),
        r2("forecast").alias("avg_forecast"),
        r2("forecast_error").alias("forecast_mae"),
        r2(ratio(F.lit(100) * F.col("forecast_error"), "demand")).alias("forecast_error_pct"),
    )
    return top(
        m,
        [F.col("forecast_error_pct").desc_nulls_last(), *pair_tiebreak()],
        params.forecast_accuracy_top,
    )


def volatility_segments(df, params: Params = DEFAULT) -> DataFrame:
    """Q404: SKU class by coefficient of variation."""
    m = group_metrics(df, ["SKU_ID"], "demand", "demand_std", "demand_cv", params=params)
    cv = F.col("demand_cv")
    seg = first_match([cv >= params.cv_high, cv >= params.cv_medium], VOLATILITY_SEGMENT)
    out = m.select(
        "SKU_ID",
        r2("demand").alias("avg_demand"),
        r2("demand_std").alias("demand_std"),
        r3(cv).alias("demand_cv"),
        seg.alias("volatility_segment"),
    )
    return ordered(out, [F.col("demand_cv").desc_nulls_last(), "SKU_ID"])


def promotion_impact(df, params: Params = DEFAULT) -> DataFrame:
    """Q405: demand and forecast bias per promotion flag (from the flag profile)."""
    m = group_metrics(
        df, ["Promotion_Flag"], "records", "demand", "forecast", "forecast_bias", params=params
    ).select(
        "Promotion_Flag",
        "records",
        r2("demand").alias("avg_demand"),
        r2("forecast").alias("avg_forecast"),
        r2("forecast_bias").alias("avg_forecast_bias"),
    )
    return ordered(m, [F.col("Promotion_Flag").asc_nulls_first()])


def stockout_risk(df, params: Params = DEFAULT) -> DataFrame:
    """Q406: profile per stockout flag (from the flag profile)."""
    m = group_metrics(
        df, ["Stockout_Flag"], "records", "demand", "inventory", "forecast", "forecast_error",
        "avg_buffer", params=params,
    ).select(
        "Stockout_Flag",
        "records",
        r2("demand").alias("avg_demand"),
        r2("inventory").alias("avg_inventory"),
        r2("forecast").alias("avg_forecast"),
        r2("forecast_error").alias("forecast_mae"),
        r2("avg_buffer").alias("avg_inventory_buffer"),
    )
    return ordered(m, [F.col("Stockout_Flag").asc_nulls_first()])


def risk_matrix(df, params: Params = DEFAULT) -> DataFrame:
    """Q407: (below reorder point) x (volatile demand), most severe first."""
    m = group_metrics(
        df, PAIR, "demand", "demand_cv", "forecast", "inventory", "reorder_point", params=params
    )
    below = F.col("inventory") < F.col("reorder_point")
    volatile = F.col("demand_cv") >= params.cv_high
    # severity from unrounded metrics; label and sort rank from one rule chain
    rules = [below & volatile, below, volatile]
    rank = first_match(rules, [1, 2, 3, 4])
    label = first_match(rules, RISK_STATUS)
    out = m.select(
        *PAIR,
        r2("demand").alias("avg_demand"),
        r3("demand_cv").alias("demand_cv"),
        r2(F.abs(F.col("demand") - F.col("forecast"))).alias("forecast_gap"),
        r2("inventory").alias("avg_inventory"),
        r2("reorder_point").alias("avg_reorder_point"),
        label.alias("risk_status"),
        rank.alias("_severity"),
    )
    return ordered(
        out,
        ["_severity", F.col("demand_cv").desc_nulls_last(), *pair_tiebreak()],
    ).drop("_severity")
