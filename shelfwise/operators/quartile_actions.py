"""Management decision reports on cover quartiles (Q751-Q756).

The quartile is NTILE(4) over all SKU x warehouse pairs ordered by days of
cover (zero demand = NULL cover sorts first), ties broken by SKU, warehouse.
Boundary rows are found by exact selection and pairs classified by comparison
(``ranking``); the reports on the top quartile need one boundary only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.labels import EXCESS_ACTION, MANAGEMENT_ACTION, QUARTILE_PRIORITY_ACTION
from shelfwise.operators.common import (
    first_match,
    money,
    ordered,
    pair_tiebreak,
    pct,
    r2,
    round_half_up,
    top,
)
from shelfwise.operators.metrics import as_inventory, group_metrics
from shelfwise.operators.ranking import By, above, tile_keys, with_ntile
from shelfwise.params import DEFAULT, Params
from shelfwise.schema import PAIR
from shelfwise.sources.store import ensure_checkpoint_dir


_ORDER = [By("cover"), *[By(c) for c in PAIR]]


def _pairs(df, params: Params, *extra: str) -> DataFrame:
    """Pair measures that are read more than once: of stored grains as they are, of plain rows by way of a checkpoint."""
    inv = as_inventory(df, params)
    m = group_metrics(inv, PAIR, "cover", "inventory", "reorder_point", "inventory_value", *extra, params=params)
    if inv.stored("pair"):
        return m
    ensure_checkpoint_dir(m.sparkSession)
    return m.checkpoint()


def cover_tiles(df, k: int) -> list:
    """The boundary keys of the tiles of cover over all pairs (stored with a lattice)."""
    return tile_keys(_pairs(df, DEFAULT), k, _ORDER)


def with_cover_quartile(df, params: Params = DEFAULT, *extra: str) -> DataFrame:
    k = params.cover_quantiles
    known = as_inventory(df).marks.get("cover_tiles", {}).get(str(k))
    return with_ntile(_pairs(df, params, *extra), k, _ORDER, "cover_quartile", params, known)


def _with_top_quartile(df, params: Params, *extra: str) -> DataFrame:
    """Pair measures + top_quartile: whether the pair is in the highest tile of cover."""
    k = params.cover_quantiles
    if params.global_window == "builtin" or k < 2:
        return with_cover_quartile(df, params, *extra).withColumn("top_quartile", F.col("cover_quartile") == k)
    pairs = _pairs(df, params, *extra)
    known = as_inventory(df).marks.get("cover_tiles", {}).get(str(k))
    last = known[-1] if known else tile_keys(pairs, k, _ORDER, [k - 1])[0]
    return pairs.withColumn("top_quartile", above(pairs, _ORDER, last))


def executive_summary(df, params: Params = DEFAULT) -> DataFrame:
    """Q751: KPI row; cover is the mean of daily ratios (zero-demand days drop out)."""
    m = group_metrics(
        df, [], "inventory_value", "row_cover", "stockout_days", "promotion_rate",
        params=params, distinct=["SKU_ID", "Warehouse_ID"],
    )
    return m.select(
        F.col("distinct_SKU_ID").alias("skus"),
        F.col("distinct_Warehouse_ID").alias("warehouses"),
        money("inventory_value").alias("inventory_value"),
        r2("row_cover").alias("avg_days_cover"),
        "stockout_days",
        pct("promotion_rate").alias("promotion_rate"),
    )


def decision_profile(df, params: Params = DEFAULT) -> DataFrame:
    """Q752: top pairs by value with forecast error and promotion rate."""
    m = group_metrics(
        df, PAIR, "inventory_value", "cover", "reorder_point", "lead_time", "forecast_error",
        "promotion_rate", params=params,
    ).select(
        *PAIR,
        money("inventory_value").alias("inventory_value"),
        r2("cover").alias("days_cover"),
        r2("reorder_point").alias("reorder_point"),
        r2("lead_time").alias("lead_time"),
        r2("forecast_error").alias("forecast_error"),
        round_half_up(F.lit(100) * F.col("promotion_rate"), 1).alias("promotion_rate"),
    )
    return top(m, [F.col("inventory_value").desc(), *pair_tiebreak()], params.decision_profile_top)


def warehouse_concentration(df, params: Params = DEFAULT) -> DataFrame:
    """Q753: per-warehouse value, mean daily cover, lead time and stockout days."""
    m = group_metrics(
        df, ["Warehouse_ID"], "inventory_value", "row_cover", "reorder_point", "lead_time",
        "stockout_days", params=params,
    ).select(
        "Warehouse_ID",
        money("inventory_value").alias("inventory_value"),
        r2("row_cover").alias("avg_days_cover"),
        r2("reorder_point").alias("avg_reorder_point"),
        r2("lead_time").alias("avg_lead_time"),
        "stockout_days",
    )
    return ordered(m, [F.col("inventory_value").desc(), "Warehouse_ID"])


def excess_inventory(df, params: Params = DEFAULT) -> DataFrame:
    """Q754: top cover quartile; REVIEW EXCESS when also above the reorder point."""
    q = _with_top_quartile(df, params, "forecast")
    top_q = F.col("top_quartile")
    action = first_match([top_q & (F.col("inventory") > F.col("reorder_point"))], EXCESS_ACTION)
    out = q.filter(top_q).select(
        *PAIR,
        money("inventory_value").alias("inventory_value"),
        r2("cover").alias("days_cover"),
        r2("reorder_point").alias("reorder_point"),
        r2("forecast").alias("forecast"),
        action.alias("action"),
    )
    return ordered(out, [F.col("inventory_value").desc(), *pair_tiebreak()])


def action_summary(df, params: Params = DEFAULT) -> DataFrame:
    """Q755: pairs and value per management action."""
    q = _with_top_quartile(df, params, "stockout_rate")
    inv, rop = F.col("inventory"), F.col("reorder_point")
    top_q = F.col("top_quartile")
    action = first_match(
        [inv < rop, F.col("stockout_rate") > 0, top_q & (inv > rop)], MANAGEMENT_ACTION
    )
    out = q.groupBy(action.alias("management_action")).agg(
        F.count(F.lit(1)).alias("sku_warehouse_pairs"),
        money(F.sum("inventory_value")).alias("inventory_value"),
    )
    return ordered(
        out,
        [F.col("inventory_value").desc_nulls_last(), "management_action"],
    )


def priority_list(df, params: Params = DEFAULT) -> DataFrame:
    """Q756: flagged pairs (under reorder point, stockouts or top quartile), top by value."""
    q = _with_top_quartile(df, params, "stockout_rate")
    inv, rop = F.col("inventory"), F.col("reorder_point")
    top_q = F.col("top_quartile")
    keep = (inv < rop) | (F.col("stockout_rate") > 0) | top_q
    action = first_match([inv < rop, F.col("stockout_rate") > 0, top_q], QUARTILE_PRIORITY_ACTION)
    out = q.filter(keep).select(
        *PAIR,
        money("inventory_value").alias("inventory_value"),
        r2("cover").alias("days_cover"),
        action.alias("priority_action"),
    )
    return top(
        out, [F.col("inventory_value").desc(), *pair_tiebreak()], params.quartile_priority_top
    )
