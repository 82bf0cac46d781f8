"""Labels printed by the reports.

Fixed values: every class label and dimension name below must read exactly as
in the analysis being reproduced.  Each tuple lists a report's labels in rule
order (first matching rule first, the fallback last); reports appear in the
order of the analysis scripts.
"""

# --- fixed values ---
COVERAGE_CHECK = ("COMPLETE", "INCOMPLETE")  # dq_coverage
DIMENSIONS = ("SKU", "Warehouse", "Supplier", "Region")  # dq_dimension_cardinality
# inv_coverage_risk
COVERAGE_STATUS = ("Below Lead-Time Coverage", "Balanced Coverage", "High Coverage")
# inv_reorder_buffer
BUFFER_STATUS = ("Below Reorder Point", "Tight Buffer", "Healthy Buffer", "High Buffer")
VALUE_SEGMENT = ("A - High Value", "B - Medium Value", "C - Low Value")  # inv_abc_concentration
PAIR_REPLENISHMENT_STATUS = (
    "Potential Under-Replenishment",
    "Balanced",
    "Potential Over-Replenishment",
)  # inv_replenishment_efficiency
INVENTORY_PRIORITY = ("High Priority", "Medium Priority", "Low Priority")  # inv_priority_ranking
# dem_volatility_segments
VOLATILITY_SEGMENT = ("High Volatility", "Medium Volatility", "Low Volatility")
RISK_STATUS = ("Critical", "Replenishment Risk", "Demand Risk", "Normal")  # dem_risk_matrix
# sup_replenishment_efficiency
SUPPLIER_REPLENISHMENT_STATUS = ("Under-Replenishment", "Balanced", "Over-Replenishment")
LEAD_TIME_RISK = ("High Risk", "Medium Risk", "Low Risk")  # sup_lead_time_risk
SUPPLY_RISK = ("Immediate Attention", "Monitor", "Stable")  # sup_high_risk_combinations
INVENTORY_STATUS = ("Understock", "Lead-Time Risk", "Overstock", "Balanced")  # risk_pair_profile
RISK_PRIORITY = ("High Priority", "Medium Priority", "Low Priority")  # risk_composite_score
OPPORTUNITY_STATUS = ("Understock", "Overstock", "Balanced")  # risk_opportunity_summary
RECOMMENDED_ACTION = (
    "EXPEDITE REPLENISHMENT",
    "REDUCE / HOLD ORDERS",
    "REVIEW SERVICE LEVEL",
    "MONITOR",
)  # act_action_matrix
ATTENTION_STATUS = ("UNDERSTOCK", "OVERSTOCK", "BALANCED")  # act_top_value_attention
WAREHOUSE_PRIORITY = ("HIGH SERVICE RISK", "HIGH INVENTORY", "STABLE")  # act_warehouse_priorities
ACTION_TYPE = (
    "Replenishment Opportunity",
    "Excess Inventory Opportunity",
    "No Immediate Action",
)  # act_opportunity_by_action
PRIORITY_ACTION = (
    "CRITICAL - REPLENISH",
    "HIGH - REPLENISH",
    "HIGH - REDUCE INVENTORY",
    "MEDIUM - REVIEW SERVICE",
    "LOW - MONITOR",
)  # act_prioritized_list
EXCESS_ACTION = ("REVIEW EXCESS", "NORMAL")  # actq_excess_inventory
# actq_action_summary
MANAGEMENT_ACTION = ("REPLENISH", "SERVICE REVIEW", "EXCESS INVENTORY REVIEW", "MONITOR")
QUARTILE_PRIORITY_ACTION = (
    "HIGH - REPLENISH",
    "MEDIUM - SERVICE REVIEW",
    "MEDIUM - EXCESS REVIEW",
    "LOW - MONITOR",
)  # actq_priority_list
