"""Row-level quality predicates counted by the validation reports.

Each one is a sum of a row predicate, so it is kept in the mergeable summary
(``metrics.summary_aggs``, column ``qc_<name>``) and the reports read the
summary instead of rescanning the fact table.
"""

# Output names of the per-column NULL counts, in column order.
NULL_COUNT_NAMES = [
    ("Date", "missing_date"),
    ("SKU_ID", "missing_sku"),
    ("Warehouse_ID", "missing_warehouse"),
    ("Supplier_ID", "missing_supplier"),
    ("Region", "missing_region"),
    ("Units_Sold", "missing_units_sold"),
    ("Inventory_Level", "missing_inventory"),
    ("Supplier_Lead_Time_Days", "missing_lead_time"),
    ("Reorder_Point", "missing_reorder_point"),
    ("Order_Quantity", "missing_order_quantity"),
    ("Unit_Cost", "missing_unit_cost"),
    ("Unit_Price", "missing_unit_price"),
    ("Promotion_Flag", "missing_promotion_flag"),
    ("Stockout_Flag", "missing_stockout_flag"),
    ("Demand_Forecast", "missing_forecast"),
]

# Domain rules counted by the rule-violation report.
RULE_VIOLATIONS = [
    ("negative_demand", "Units_Sold < 0"),
    ("negative_inventory", "Inventory_Level < 0"),
    ("invalid_lead_time", "Supplier_Lead_Time_Days <= 0"),
    ("negative_reorder_point", "Reorder_Point < 0"),
    ("negative_order_quantity", "Order_Quantity < 0"),
    ("invalid_unit_cost", "Unit_Cost <= 0"),
    ("invalid_unit_price", "Unit_Price <= 0"),
    ("invalid_promotion_flag", "Promotion_Flag NOT IN (0, 1)"),
    ("invalid_stockout_flag", "Stockout_Flag NOT IN (0, 1)"),
    ("negative_forecast", "Demand_Forecast < 0"),
]

# Commercial-logic checks and flag counts, by output name.
COMMERCIAL_CHECKS = [
    ("non_positive_margin", "Unit_Price <= Unit_Cost"),
    ("replenishment_at_zero_inventory", "Order_Quantity > 0 AND Inventory_Level = 0"),
]
FLAG_COUNTS = [
    ("stockout_records", "Stockout_Flag = 1"),
    ("promotion_records", "Promotion_Flag = 1"),
]


def row_predicates() -> list[tuple[str, str]]:
    """(summary column name, SQL predicate) for every counted row check."""
    out = [(f"qc_{name}", f"{col} IS NULL") for col, name in NULL_COUNT_NAMES]
    out += [(f"qc_{name}", cond) for name, cond in RULE_VIOLATIONS + COMMERCIAL_CHECKS + FLAG_COUNTS]
    return out
