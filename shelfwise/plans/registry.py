"""

Every report takes the inventory fact table DataFrame; ``run(spark, key,
sf_dir)`` derives that table from the source tables in ``sf_dir`` (once per
application, see ``sources.store``) and applies the operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.operators import actions, demand, inventory, quality, quartile_actions, risk, supplier
from shelfwise.params import DEFAULT, Params
from shelfwise.sources import contract, variants
from shelfwise.sources.catalog import footer_inventory
from shelfwise.sources.loader import with_key_numbers
from shelfwise.sources.store import inventory_data, inventory_path, inventory_table, sized_table

Operator = Callable[[DataFrame, Params], DataFrame]

REPORTS: dict[str, tuple[str, Operator]] = {
    "dq_row_count": ("Q201", quality.row_count),
    "dq_span_cardinality": ("Q202", quality.span_cardinality),
    "dq_null_counts": ("Q203", quality.null_counts),
    "dq_full_row_duplicates": ("Q204", quality.full_row_duplicates),
    "dq_business_key_duplicates": ("Q205", quality.business_key_duplicates),
    "dq_rule_violations": ("Q206", quality.rule_violations),
    "dq_commercial_logic": ("Q207", quality.commercial_logic),
    "dq_coverage": ("Q208", quality.coverage),
    "dq_promotion_distribution": ("Q209", quality.promotion_distribution),
    "dq_stockout_distribution": ("Q210", quality.stockout_distribution),
    "dq_dimension_cardinality": ("Q211", quality.dimension_cardinality),
    "dq_warehouse_profile": ("Q212", quality.warehouse_profile),
    "dq_sku_profile": ("Q213", quality.sku_profile),
    "dq_summary": ("Q214", quality.summary),
    "inv_overall": ("Q301", inventory.overall),
    "inv_warehouse_efficiency": ("Q302", inventory.warehouse_efficiency),
    "inv_pair_profile": ("Q303", inventory.pair_profile),
    "inv_coverage_risk": ("Q304", inventory.coverage_risk),
    "inv_reorder_buffer": ("Q305", inventory.reorder_buffer),
    "inv_abc_concentration": ("Q306", inventory.abc_concentration),
    "inv_replenishment_efficiency": ("Q307", inventory.replenishment_efficiency),
    "inv_priority_ranking": ("Q308", inventory.priority_ranking),
    "dem_overall": ("Q401", demand.overall),
    "dem_sku_volatility": ("Q402", demand.sku_volatility),
    "dem_pair_forecast_accuracy": ("Q403", demand.pair_forecast_accuracy),
    "dem_volatility_segments": ("Q404", demand.volatility_segments),
    "dem_promotion_impact": ("Q405", demand.promotion_impact),
    "dem_stockout_risk": ("Q406", demand.stockout_risk),
    "dem_risk_matrix": ("Q407", demand.risk_matrix),
    "sup_overall": ("Q501", supplier.overall),
    "sup_profile": ("Q502", supplier.profile),
    "sup_replenishment_efficiency": ("Q503", supplier.replenishment_efficiency),
    "sup_lead_time_risk": ("Q504", supplier.lead_time_risk),
    "sup_replenishment_gaps": ("Q505", supplier.replenishment_gaps),
    "sup_high_risk_combinations": ("Q506", supplier.high_risk_combinations),
    "risk_pair_profile": ("Q601", risk.pair_profile),
    "risk_understock_exposure": ("Q602", risk.understock_exposure),
    "risk_overstock_exposure": ("Q603", risk.overstock_exposure),
    "risk_stockout": ("Q604", risk.stockout),
    "risk_composite_score": ("Q605", risk.composite_score),
    "risk_opportunity_summary": ("Q606", risk.opportunity_summary),
    "act_executive_kpis": ("Q701", actions.executive_kpis),
    "act_action_matrix": ("Q702", actions.action_matrix),
    "act_top_value_attention": ("Q703", actions.top_value_attention),
    "act_warehouse_priorities": ("Q704", actions.warehouse_priorities),
    "act_opportunity_by_action": ("Q705", actions.opportunity_by_action),
    "act_prioritized_list": ("Q706", actions.prioritized_list),
    "act_condition_counts": ("Q707", actions.condition_counts),
    "actq_executive_summary": ("Q751", quartile_actions.executive_summary),
    "actq_decision_profile": ("Q752", quartile_actions.decision_profile),
    "actq_warehouse_concentration": ("Q753", quartile_actions.warehouse_concentration),
    "actq_excess_inventory": ("Q754", quartile_actions.excess_inventory),
    "actq_action_summary": ("Q755", quartile_actions.action_summary),
    "actq_priority_list": ("Q756", quartile_actions.priority_list),
}

# Source tables in a scale-factor folder (for the table inventory, I3).
SOURCE_TABLES = [
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
]


def run(spark: SparkSession, key: str, sf_dir: str, params: Params = DEFAULT) -> DataFrame:
    _, op = REPORTS[key]
    return op(inventory_data(spark, sf_dir), params)


def ingest_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I2: rows of the fact table that break the row contract, with rule names."""
    return contract.quarantine_report(inventory_table(spark, sf_dir))


def _dirty(key: str) -> Callable[[SparkSession, str], DataFrame]:
    """A quality report over the table with broken and repeated rows."""
    return lambda spark, sf_dir: REPORTS[key][1](variants.stored_dirty_inventory(spark, sf_dir), DEFAULT)


def dirty_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I2 over the table with broken rows."""
    return contract.quarantine_report(variants.stored_dirty_inventory(spark, sf_dir))


def ingest_typed_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I1: the fact table read back from CSV with its fixed schema, checked by its sums per warehouse."""
    return (
        variants.typed_copy(spark, sf_dir)
        .groupBy("Warehouse_ID")
        .agg(
            F.count("*").alias("records"),
            F.min("Date").alias("first_date"),
            F.max("Date").alias("last_date"),
            F.sum("Units_Sold").alias("units"),
            F.sum(F.col("Unit_Cost") * F.col("Inventory_Level")).cast("decimal(38,2)").alias("inventory_value"),
        )
    )


def ingest_collated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4: keys that differ in case and accents only, grouped under a collation by way of key dictionaries."""
    return collated_units(variants.mixed_case_inventory(sized_table(spark, sf_dir)))


def collated_units(fact: DataFrame) -> DataFrame:
    """Rows and units per SKU and warehouse, keys compared without case and accents."""
    keys = ["SKU_ID", "Warehouse_ID"]
    numbered = with_key_numbers(fact, keys)
    by = [f"{k}_{part}" for k in keys for part in ("number", "label")]
    out = numbered.groupBy(*by).agg(F.count("*").alias("records"), F.sum("Units_Sold").alias("units"))
    return out.select(*[F.col(f"{k}_label").alias(k) for k in keys], "records", "units")


def catalog_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I3: exact row count of every table (source tables + derived fact table), from Parquet footers."""
    folder = sf_dir.rstrip("/")
    inventory_table(spark, sf_dir)
    paths = {name: f"{folder}/{name}.parquet" for name in SOURCE_TABLES}
    return footer_inventory(spark, paths | {"inventory_raw": inventory_path(spark, sf_dir)})


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {
        "ingest_quarantine": ingest_quarantine,
        "catalog_table_rows": catalog_table_rows,
        "ingest_typed_csv": ingest_typed_csv,
        "ingest_collated_keys": ingest_collated_keys,
        "dirty_quarantine": dirty_quarantine,
        "dirty_null_counts": _dirty("dq_null_counts"),
        "dirty_full_row_duplicates": _dirty("dq_full_row_duplicates"),
        "dirty_business_key_duplicates": _dirty("dq_business_key_duplicates"),
        "dirty_rule_violations": _dirty("dq_rule_violations"),
        "dirty_commercial_logic": _dirty("dq_commercial_logic"),
    }
    for key in REPORTS:
        out[key] = lambda spark, sf_dir, _k=key: run(spark, _k, sf_dir)
    return out
