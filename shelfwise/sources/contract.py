"""I2: the row contract of the fact table.

The table definition declares every column NOT NULL, the four string keys
VARCHAR(20) and ten CHECK rules.  Spark does not enforce those on file
tables, so the contract is an operator: ``check_schema`` compares column
names and types with ``INVENTORY_SCHEMA``; ``masked`` evaluates every rule
once into one bit mask per row (narrow projection, no shuffle);
``split`` returns (accepted, quarantined), and decodes rule names from the mask.  A CHECK rule whose input is NULL
passes, as in SQL; the NOT NULL rule of that column reports it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.schema import COLUMNS, INVENTORY_SCHEMA, KEY_COLUMNS, STRING_KEY_MAX_LEN

# The ten CHECK rules of the table definition, by name.
CHECK_RULES: dict[str, str] = {
    "chk_units_sold": "Units_Sold >= 0",
    "chk_inventory_level": "Inventory_Level >= 0",
    "chk_lead_time": "Supplier_Lead_Time_Days > 0",
    "chk_reorder_point": "Reorder_Point >= 0",
    "chk_order_quantity": "Order_Quantity >= 0",
    "chk_unit_cost": "Unit_Cost > 0",
    "chk_unit_price": "Unit_Price > 0",
    "chk_promotion_flag": "Promotion_Flag IN (0, 1)",
    "chk_stockout_flag": "Stockout_Flag IN (0, 1)",
    "chk_demand_forecast": "Demand_Forecast >= 0",
}


def check_schema(df: DataFrame) -> list[str]:
    """Differences between df's columns/types and the fixed schema (empty = ok)."""
    problems = []
    have = {f.name: f.dataType for f in df.schema.fields}
    for f in INVENTORY_SCHEMA.fields:
        if f.name not in have:
            problems.append(f"missing column {f.name}")
        elif have[f.name].simpleString().split(" collate")[0] != f.dataType.simpleString():
            problems.append(
                f"{f.name}: {have[f.name].simpleString()} != {f.dataType.simpleString()}"
            )
    for name in have:
        if name not in COLUMNS:
            problems.append(f"unexpected column {name}")
    return problems


def rule_checks() -> list[tuple[str, str]]:
    """(rule name, SQL predicate that is TRUE when the row breaks the rule)."""
    rules = [(f"not_null_{c}", f"{c} IS NULL") for c in COLUMNS]
    rules += [(f"max_length_{c}", f"length({c}) > {STRING_KEY_MAX_LEN}") for c in KEY_COLUMNS]
    rules += [(name, f"NOT ({cond})") for name, cond in CHECK_RULES.items()]
    return rules


def _checked(df: DataFrame) -> None:
    problems = check_schema(df)
    if problems:
        raise ValueError("inventory schema mismatch: " + "; ".join(problems))


def broken_mask() -> Column:
    """A long with bit i set when the row breaks rule i (a NULL predicate passes, as a CHECK does)."""
    bits = [f"CASE WHEN {cond} THEN {1 << i}L ELSE 0L END" for i, (_, cond) in enumerate(rule_checks())]
    return F.expr(" | ".join(bits))  # one call for the whole plan text


def violation_names(mask: str) -> Column:
    """The names of the rules whose bits are set, as an array in rule order."""
    names = [f"CASE WHEN {mask} & {1 << i}L <> 0 THEN '{name}' END" for i, (name, _) in enumerate(rule_checks())]
    return F.expr(f"array_compact(array({', '.join(names)}))")


def masked(df: DataFrame, column: str = "broken") -> DataFrame:
    """Every row with its mask of broken rules (0 when the row is fine): each rule is evaluated once."""
    _checked(df)
    return df.withColumn(column, broken_mask())


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, quarantined rows with a ``violations`` array), both from one mask per row.

    The names are decoded from the mask, for the rows that break something."""
    rows = masked(df, "_broken")
    good = rows.filter("_broken = 0").drop("_broken")
    bad = rows.filter("_broken <> 0").withColumn("violations", violation_names("_broken")).drop("_broken")
    return good, bad


def quarantine_report(df: DataFrame) -> DataFrame:
    """Quarantined rows with the broken rules joined into one string."""
    _, bad = split(df)
    return bad.withColumn("violations", F.concat_ws(",", "violations"))
