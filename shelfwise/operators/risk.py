"""Inventory risk scoring and optimisation reports (Q601-Q606)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.labels import INVENTORY_STATUS, OPPORTUNITY_STATUS, RISK_PRIORITY
from shelfwise.operators.common import first_match, money, ordered, pair_tiebreak, pct, r2
from shelfwise.operators.metrics import group_metrics
from shelfwise.params import DEFAULT, Params
from shelfwise.schema import PAIR


def pair_profile(df, params: Params = DEFAULT) -> DataFrame:
    """Q601: four-way stock status per pair (classes from unrounded means)."""
    m = group_metrics(
        df, PAIR, "demand", "inventory", "reorder_point", "lead_time", "cover",
        "inventory_value", params=params,
    )
    inv, rop, lt, c = F.col("inventory"), F.col("reorder_point"), F.col("lead_time"), F.col("cover")
    status = first_match(
        [inv < rop, c < lt, c > lt * params.high_cover_lead_multiple], INVENTORY_STATUS
    )
    out = m.select(
        *PAIR,
        r2("demand").alias("avg_demand"),
        r2(inv).alias("avg_inventory"),
        r2(rop).alias("reorder_point"),
        r2(lt).alias("lead_time"),
        r2(c).alias("days_of_cover"),
        money("inventory_value").alias("inventory_value"),
        status.alias("inventory_status"),
    )
    return ordered(out, [F.col("inventory_value").desc(), *pair_tiebreak()])


def understock_exposure(df, params: Params = DEFAULT) -> DataFrame:
    """Q602: pairs below their reorder point on average, with the mean daily gap value."""
    m = group_metrics(df, PAIR, "inventory", "reorder_point", "avg_gap", "gap_value", params=params)
    out = m.filter(F.col("inventory") < F.col("reorder_point")).select(
        *PAIR,
        r2("inventory").alias("avg_inventory"),
        r2("reorder_point").alias("reorder_point"),
        r2("avg_gap").alias("inventory_gap"),
        r2("gap_value").alias("estimated_gap_value"),
    )
    return ordered(out, [F.col("estimated_gap_value").desc_nulls_last(), *pair_tiebreak()])


def overstock_exposure(df, params: Params = DEFAULT) -> DataFrame:
    """Q603: pairs above 1.5 x reorder point on average, with mean daily excess value."""
    m = group_metrics(
        df, PAIR, "inventory", "reorder_point", "demand", "cover", "excess_value", params=params
    )
    keep = F.col("inventory") > F.col("reorder_point") * params.overstock_rop_multiple
    out = m.filter(keep).select(
        *PAIR,
        r2("inventory").alias("avg_inventory"),
        r2("demand").alias("avg_demand"),
        r2("cover").alias("days_of_cover"),
        r2("excess_value").alias("excess_inventory_value"),
    )
    return ordered(out, [F.col("excess_inventory_value").desc_nulls_last(), *pair_tiebreak()])


def stockout(df, params: Params = DEFAULT) -> DataFrame:
    """Q604: pairs with at least one stockout day."""
    m = group_metrics(
        df, PAIR, "stockout_days", "records", "stockout_rate", "demand", "inventory",
        params=params,
    )
    out = m.filter(F.col("stockout_days") > 0).select(
        *PAIR,
        "stockout_days",
        F.col("records").alias("total_days"),
        pct("stockout_rate").alias("stockout_rate"),
        r2("demand").alias("avg_demand"),
        r2("inventory").alias("avg_inventory"),
    )
    return ordered(
        out,
        [F.col("stockout_rate").desc(), F.col("stockout_days").desc(), *pair_tiebreak()],
    )


def composite_score(df, params: Params = DEFAULT) -> DataFrame:
    """Q605: sum of four 0/1 risks; a NULL risk (no demand) makes the score NULL."""
    m = group_metrics(
        df, PAIR, "inventory", "reorder_point", "lead_time", "cover", "stockout_rate",
        "inventory_value", params=params,
    )
    inv, rop, lt, c = F.col("inventory"), F.col("reorder_point"), F.col("lead_time"), F.col("cover")
    score = (
        (inv < rop).cast("int")
        + (c < lt).cast("int")
        + (c > lt * params.high_cover_lead_multiple).cast("int")
        + (F.col("stockout_rate") > 0).cast("int")
    )
    out = m.select(
        *PAIR,
        money("inventory_value").alias("inventory_value"),
        r2(c).alias("days_of_cover"),
        pct("stockout_rate").alias("stockout_rate"),
        score.alias("risk_score"),
        first_match([score >= 2, score == 1], RISK_PRIORITY).alias("management_priority"),
    )
    return ordered(
        out,
        [F.col("risk_score").desc_nulls_last(), F.col("inventory_value").desc(), *pair_tiebreak()],
    )


def opportunity_classes(df, params: Params, labels: tuple[str, str, str]) -> DataFrame:
    """(label, opportunity value) per pair for under / over / neither."""
    m = group_metrics(
        df, PAIR, "inventory", "reorder_point", "unit_cost", "cover", "lead_time", params=params
    )
    inv, rop, uc = F.col("inventory"), F.col("reorder_point"), F.col("unit_cost")
    over = F.col("cover") > F.col("lead_time") * params.high_cover_lead_multiple
    under = inv < rop
    label = first_match([under, over], labels)
    value = (
        F.when(under, (rop - inv) * uc).when(over, (inv - rop) * uc).otherwise(F.lit(0.0))
    )
    return m.select(label.alias("_class"), value.alias("_value"))


def opportunity_summary(df, params: Params = DEFAULT) -> DataFrame:
    """Q606: pairs and opportunity value per stock status (aggregate of aggregates)."""
    classes = opportunity_classes(df, params, OPPORTUNITY_STATUS)
    out = classes.groupBy(F.col("_class").alias("inventory_status")).agg(
        F.count(F.lit(1)).alias("sku_warehouse_pairs"),
        r2(F.sum("_value")).alias("estimated_opportunity_value"),
    )
    return ordered(
        out,
        [F.col("estimated_opportunity_value").desc_nulls_last(), "inventory_status"],
    )
