"""Management decision reports on fixed thresholds (Q701-Q707)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import flag_sum
from shelfwise.labels import (
    ACTION_TYPE,
    ATTENTION_STATUS,
    PRIORITY_ACTION,
    RECOMMENDED_ACTION,
    WAREHOUSE_PRIORITY,
)
from shelfwise.operators.common import first_match, money, ordered, pair_tiebreak, pct, r2, top
from shelfwise.operators.metrics import group_metrics
from shelfwise.operators.risk import opportunity_classes
from shelfwise.params import DEFAULT, Params
from shelfwise.schema import PAIR

_PAIR_MEASURES = (
    "inventory",
    "reorder_point",
    "lead_time",
    "cover",
    "stockout_rate",
    "inventory_value",
)


def executive_kpis(df, params: Params = DEFAULT) -> DataFrame:
    """Q701: executive KPI row."""
    m = group_metrics(
        df, [], "demand", "inventory", "inventory_value", "stockout_days",
        "replenishment_events", "promotion_rate", params=params,
        distinct=["SKU_ID", "Warehouse_ID"],
    )
    return m.select(
        F.col("distinct_SKU_ID").alias("total_skus"),
        F.col("distinct_Warehouse_ID").alias("total_warehouses"),
        r2("demand").alias("avg_daily_demand"),
        r2("inventory").alias("avg_inventory"),
        money("inventory_value").alias("inventory_value"),
        "stockout_days",
        "replenishment_events",
        pct("promotion_rate").alias("promotion_rate"),
    )


def _conditions(params: Params):
    inv, rop, lt, c = F.col("inventory"), F.col("reorder_point"), F.col("lead_time"), F.col("cover")
    under = inv < rop
    short = c < lt
    high = c > lt * params.high_cover_lead_multiple
    stockouts = F.col("stockout_rate") > 0
    return under, short, high, stockouts


def action_matrix(df, params: Params = DEFAULT) -> DataFrame:
    """Q702: one recommended action per pair, most urgent first."""
    m = group_metrics(df, PAIR, *_PAIR_MEASURES, params=params)
    under, short, high, stockouts = _conditions(params)
    rules = [under | short, high, stockouts]
    rank = first_match(rules, [1, 2, 3, 4])
    action = first_match(rules, RECOMMENDED_ACTION)
    out = m.select(
        *PAIR,
        money("inventory_value").alias("inventory_value"),
        r2("cover").alias("days_of_cover"),
        pct("stockout_rate").alias("stockout_rate"),
        action.alias("recommended_action"),
        rank.alias("_rank"),
    )
    return ordered(
        out,
        ["_rank", F.col("inventory_value").desc(), *pair_tiebreak()],
    ).drop("_rank")


def top_value_attention(df, params: Params = DEFAULT) -> DataFrame:
    """Q703: highest-value pairs that are under- or overstocked."""
    m = group_metrics(df, PAIR, *_PAIR_MEASURES, params=params)
    under, _, high, _ = _conditions(params)
    status = first_match([under, high], ATTENTION_STATUS)
    out = m.filter(under | high).select(
        *PAIR,
        money("inventory_value").alias("inventory_value"),
        r2("cover").alias("days_of_cover"),
        r2("reorder_point").alias("reorder_point"),
        r2("lead_time").alias("lead_time"),
        status.alias("inventory_status"),
    )
    return top(out, [F.col("inventory_value").desc(), *pair_tiebreak()], params.attention_top)


def warehouse_priorities(df, params: Params = DEFAULT) -> DataFrame:
    """Q704: per-warehouse service / inventory priority."""
    m = group_metrics(
        df, ["Warehouse_ID"], "demand", "inventory", "inventory_value", "stockout_rate", "cover",
        params=params,
    )
    priority = first_match(
        [
            F.col("stockout_rate") > params.service_stockout_rate,
            F.col("cover") > params.warehouse_cover_days,
        ],
        WAREHOUSE_PRIORITY,
    )
    out = m.select(
        "Warehouse_ID",
        r2("demand").alias("avg_daily_demand"),
        r2("inventory").alias("avg_inventory"),
        money("inventory_value").alias("inventory_value"),
        pct("stockout_rate").alias("stockout_rate"),
        priority.alias("warehouse_priority"),
    )
    return ordered(out, [F.col("inventory_value").desc(), "Warehouse_ID"])


def opportunity_by_action(df, params: Params = DEFAULT) -> DataFrame:
    """Q705: pairs and value per action type."""
    classes = opportunity_classes(df, params, ACTION_TYPE)
    out = classes.groupBy(F.col("_class").alias("action_type")).agg(
        F.count(F.lit(1)).alias("sku_warehouse_pairs"),
        r2(F.sum("_value")).alias("estimated_inventory_value"),
    )
    return ordered(
        out,
        [F.col("estimated_inventory_value").desc_nulls_last(), "action_type"],
    )


def prioritized_list(df, params: Params = DEFAULT) -> DataFrame:
    """Q706 (flagship): five-level action, LOW dropped, top by level then value."""
    m = group_metrics(df, PAIR, *_PAIR_MEASURES, params=params)
    under, short, high, stockouts = _conditions(params)
    level = first_match([under & stockouts, under | short, high, stockouts], [1, 2, 3, 4, 5])
    out = m.select(
        *PAIR,
        money("inventory_value").alias("inventory_value"),
        r2("cover").alias("days_of_cover"),
        pct("stockout_rate").alias("stockout_rate"),
        level.alias("_level"),
    ).filter(F.col("_level") < 5)
    lv = F.col("_level")
    action = first_match([lv == 1, lv == 2, lv == 3, lv == 4], PRIORITY_ACTION)
    # sort rank: CRITICAL 1, both HIGH 2, MEDIUM 3 (LOW is filtered out)
    rank = F.when(lv == 1, 1).when(lv <= 3, 2).otherwise(3)
    out = out.select(*PAIR, "inventory_value", "days_of_cover", "stockout_rate",
                     action.alias("priority_action"), rank.alias("_rank"))
    return top(
        out,
        [F.col("_rank").asc(), F.col("inventory_value").desc(), *pair_tiebreak()],
        params.priority_list_top,
    ).drop("_rank")


def condition_counts(df, params: Params = DEFAULT) -> DataFrame:
    """Q707: pairs meeting each condition (a NULL cover counts in none)."""
    m = group_metrics(df, PAIR, *_PAIR_MEASURES, params=params)
    under, short, high, stockouts = _conditions(params)
    return m.agg(
        F.count(F.lit(1)).alias("total_sku_warehouse_pairs"),
        flag_sum(under).alias("below_reorder_point"),
        flag_sum(short).alias("below_lead_time_cover"),
        flag_sum(high).alias("high_cover"),
        flag_sum(stockouts).alias("with_stockouts"),
    )
