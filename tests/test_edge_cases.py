"""Hand-sized edge tables (FIXTURES.md section 3); expected values computed by hand."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from shelfwise.operators import actions, demand, inventory, quality, quartile_actions, risk, supplier
from shelfwise.sources import contract
from shelfwise.sources.loader import with_collation
from tests.conftest import NULLABLE_SCHEMA

D1, D2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def by_key(df, *keys):
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}


# ---------------------------------------------------------------- empty
def test_empty_table(spark):
    empty = spark.createDataFrame([], NULLABLE_SCHEMA)
    assert one(quality.row_count(empty)) == {"total_rows": 0}
    assert set(one(quality.null_counts(empty)).values()) == {None}
    assert set(one(quality.rule_violations(empty)).values()) == {None}
    cov = one(quality.coverage(empty))
    assert cov["actual_rows"] == 0 and cov["expected_rows"] == 0
    assert cov["coverage_status"] == "COMPLETE"
    o = one(inventory.overall(empty))
    assert o["total_records"] == 0 and o["total_skus"] == 0
    assert o["avg_daily_demand"] is None and o["estimated_inventory_value"] is None
    assert o["avg_days_of_cover"] is None
    assert inventory.coverage_risk(empty).count() == 0
    assert quality.promotion_distribution(empty).count() == 0
    c = one(actions.condition_counts(empty))
    assert c["total_sku_warehouse_pairs"] == 0 and c["below_reorder_point"] is None
    assert one(supplier.overall(empty))["total_records"] == 0


# ---------------------------------------------------------------- dense cube
def test_dense_cube_and_missing_cell(make_inventory):
    rows = [
        dict(Date=d, SKU_ID=s, Warehouse_ID=w)
        for d in (D1, D2)
        for s in ("A", "B")
        for w in ("W1", "W2")
    ]
    full = one(quality.coverage(make_inventory(rows)))
    assert (full["expected_rows"], full["actual_rows"], full["coverage_status"]) == (8, 8, "COMPLETE")
    part = one(quality.coverage(make_inventory(rows[:-1])))
    assert (part["expected_rows"], part["actual_rows"], part["coverage_status"]) == (8, 7, "INCOMPLETE")


# ---------------------------------------------------------------- duplicates
def test_duplicates(make_inventory):
    rows = [dict(SKU_ID="A")] * 3 + [
        dict(SKU_ID="B", Units_Sold=1),
        dict(SKU_ID="B", Units_Sold=2),
    ]
    df = make_inventory(rows)
    assert one(quality.full_row_duplicates(df)) == {"duplicate_full_rows": 1}
    keys = by_key(quality.business_key_duplicates(df), "SKU_ID")
    assert {k[0]: v["record_count"] for k, v in keys.items()} == {"A": 3, "B": 2}


# ---------------------------------------------------------------- NULLs
def test_null_counts_and_quarantine(make_inventory):
    rows = [{f.name: None} for f in NULLABLE_SCHEMA.fields]
    df = make_inventory(rows)
    assert set(one(quality.null_counts(df)).values()) == {1}
    accepted, bad = contract.split(df)
    assert accepted.count() == 0 and bad.count() == 15
    names = {r["violations"] for r in contract.quarantine_report(df).collect()}
    assert names == {f"not_null_{f.name}" for f in NULLABLE_SCHEMA.fields}


# ---------------------------------------------------------------- broken rules
BROKEN = [
    ("negative_demand", "chk_units_sold", dict(Units_Sold=-1)),
    ("negative_inventory", "chk_inventory_level", dict(Inventory_Level=-1)),
    ("invalid_lead_time", "chk_lead_time", dict(Supplier_Lead_Time_Days=0)),
    ("negative_reorder_point", "chk_reorder_point", dict(Reorder_Point=-1)),
    ("negative_order_quantity", "chk_order_quantity", dict(Order_Quantity=-1)),
    ("invalid_unit_cost", "chk_unit_cost", dict(Unit_Cost=Decimal("0.00"))),
    ("invalid_unit_price", "chk_unit_price", dict(Unit_Price=Decimal("0.00"))),
    ("invalid_promotion_flag", "chk_promotion_flag", dict(Promotion_Flag=2)),
    ("invalid_stockout_flag", "chk_stockout_flag", dict(Stockout_Flag=2)),
    ("negative_forecast", "chk_demand_forecast", dict(Demand_Forecast=Decimal("-1.00"))),
]


def test_rule_violations_and_contract(make_inventory):
    df = make_inventory([dict(SKU_ID=f"S{i}", **kw) for i, (_, _, kw) in enumerate(BROKEN)])
    assert one(quality.rule_violations(df)) == {q: 1 for q, _, _ in BROKEN}
    report = {r["SKU_ID"]: r["violations"] for r in contract.quarantine_report(df).collect()}
    assert report == {f"S{i}": rule for i, (_, rule, _) in enumerate(BROKEN)}
    long_key = make_inventory([dict(SKU_ID="X" * 21)])
    assert contract.quarantine_report(long_key).first()["violations"] == "max_length_SKU_ID"
    good = make_inventory([dict()])
    accepted, bad = contract.split(good)
    assert accepted.count() == 1 and bad.count() == 0


def test_schema_check_rejects_wrong_types(spark):
    df = spark.createDataFrame([(1,)], "Units_Sold string")
    assert contract.check_schema(df)
    try:
        contract.masked(df)
        raise AssertionError("expected a schema error")
    except ValueError as e:
        assert "schema mismatch" in str(e)


def test_commercial_logic(make_inventory):
    df = make_inventory(
        [
            dict(Unit_Price=Decimal("2.00")),  # price == cost
            dict(Order_Quantity=5, Inventory_Level=0),
            dict(),
        ]
    )
    assert one(quality.commercial_logic(df)) == {
        "non_positive_margin": 1,
        "replenishment_at_zero_inventory": 1,
    }


# ---------------------------------------------------------------- zero demand
def test_zero_demand_null_outcomes(make_inventory):
    # one pair, no demand on any day, inventory below reorder point
    rows = [
        dict(Date=d, Units_Sold=0, Inventory_Level=20, Reorder_Point=50, Order_Quantity=q,
             Stockout_Flag=0)
        for d, q in ((D1, 0), (D2, 10), (dt.date(2024, 1, 3), 0), (dt.date(2024, 1, 4), 0))
    ]
    df = make_inventory(rows)
    assert one(inventory.coverage_risk(df))["coverage_status"] == "High Coverage"
    assert one(inventory.coverage_risk(df))["days_of_cover"] is None
    assert one(inventory.replenishment_efficiency(df))["replenishment_status"] == (
        "Potential Over-Replenishment"
    )
    comp = one(risk.composite_score(df))
    assert comp["risk_score"] is None and comp["management_priority"] == "Low Priority"
    assert one(demand.volatility_segments(df))["volatility_segment"] == "Low Volatility"
    assert one(risk.pair_profile(df))["inventory_status"] == "Understock"
    assert one(inventory.priority_ranking(df))["inventory_priority_score"] == 0
    assert supplier.replenishment_gaps(df).count() == 0  # NULL ratio is dropped
    cc = one(actions.condition_counts(df))
    # the only pair has a NULL cover: SUM over NULL conditions is NULL, as in SQL
    assert (cc["below_reorder_point"], cc["below_lead_time_cover"], cc["high_cover"]) == (1, None, None)
    # mean of daily ratios skips zero-demand days entirely
    assert one(quartile_actions.executive_summary(df))["avg_days_cover"] is None


# ---------------------------------------------------------------- thresholds
def _pair(sku, n=1, **kw):
    return [dict(SKU_ID=sku, Date=D1 + dt.timedelta(days=i), **kw) for i in range(n)]


def test_threshold_boundaries(make_inventory):
    rows = (
        _pair("COVER_EQ_LEAD", Units_Sold=10, Inventory_Level=50, Supplier_Lead_Time_Days=5, Reorder_Point=10)
        + _pair("COVER_EQ_2LEAD", Units_Sold=10, Inventory_Level=100, Supplier_Lead_Time_Days=5, Reorder_Point=10)
        + _pair("COVER_EQ_15LEAD", Units_Sold=10, Inventory_Level=75, Supplier_Lead_Time_Days=5, Reorder_Point=10)
        + _pair("INV_EQ_ROP", Inventory_Level=40, Reorder_Point=40)
        + _pair("INV_125", Inventory_Level=50, Reorder_Point=40)
        + _pair("INV_150", Inventory_Level=60, Reorder_Point=40)
        + _pair("REPL_090", Units_Sold=100, Order_Quantity=90)
        + _pair("REPL_105", Units_Sold=100, Order_Quantity=105)
    )
    df = make_inventory(rows)
    cov = {k[0]: v["coverage_status"] for k, v in by_key(inventory.coverage_risk(df), "SKU_ID").items()}
    assert cov["COVER_EQ_LEAD"] == "Balanced Coverage"
    assert cov["COVER_EQ_2LEAD"] == "Balanced Coverage"
    status = {k[0]: v["inventory_status"] for k, v in by_key(risk.pair_profile(df), "SKU_ID").items()}
    assert status["COVER_EQ_LEAD"] == "Balanced" and status["COVER_EQ_2LEAD"] == "Balanced"
    buf = {k[0]: v["buffer_status"] for k, v in by_key(inventory.reorder_buffer(df), "SKU_ID").items()}
    assert (buf["INV_EQ_ROP"], buf["INV_125"], buf["INV_150"]) == (
        "Tight Buffer", "Tight Buffer", "Healthy Buffer"
    )
    rep = {
        k[0]: v["replenishment_status"]
        for k, v in by_key(inventory.replenishment_efficiency(df), "SKU_ID").items()
    }
    assert rep["REPL_090"] == "Balanced" and rep["REPL_105"] == "Balanced"
    risky = {r["SKU_ID"] for r in supplier.high_risk_combinations(df).collect()}
    assert "COVER_EQ_15LEAD" not in risky and "COVER_EQ_LEAD" in risky


def test_lead_time_and_service_thresholds(make_inventory):
    rows = (
        [dict(Supplier_ID="S6", Supplier_Lead_Time_Days=6, SKU_ID="a")]
        + [dict(Supplier_ID="S10", Supplier_Lead_Time_Days=10, SKU_ID="b")]
        + [dict(Supplier_ID="S5", Supplier_Lead_Time_Days=5, SKU_ID="c")]
    )
    risk_by = {k[0]: v["lead_time_risk"] for k, v in by_key(supplier.lead_time_risk(make_inventory(rows)), "Supplier_ID").items()}
    assert risk_by == {"S6": "Medium Risk", "S10": "High Risk", "S5": "Low Risk"}
    # warehouse: stockout rate exactly 1 % and cover exactly 25 days -> STABLE
    wh = [
        dict(Warehouse_ID="W", Date=D1 + dt.timedelta(days=i), Stockout_Flag=1 if i == 0 else 0,
             Units_Sold=4, Inventory_Level=100)
        for i in range(100)
    ]
    assert one(actions.warehouse_priorities(make_inventory(wh)))["warehouse_priority"] == "STABLE"


# ---------------------------------------------------------------- ABC
def _abc(make_inventory, values):
    return make_inventory(
        [dict(SKU_ID=f"S{i}", Unit_Cost=Decimal("1.00"), Inventory_Level=v) for i, v in enumerate(values)]
    )


def test_abc_exact_lines(make_inventory):
    out = by_key(inventory.abc_concentration(_abc(make_inventory, [80, 15, 5])), "SKU_ID")
    assert [out[(f"S{i}",)]["value_segment"] for i in range(3)] == [
        "A - High Value", "B - Medium Value", "C - Low Value"
    ]
    assert [out[(f"S{i}",)]["cumulative_value_percentage"] for i in range(3)] == [80.0, 95.0, 100.0]


def test_abc_dominant_item_is_c(make_inventory):
    out = by_key(inventory.abc_concentration(_abc(make_inventory, [96, 4])), "SKU_ID")
    assert out[("S0",)]["value_segment"] == "C - Low Value"
    assert out[("S1",)]["value_segment"] == "C - Low Value"
    assert out[("S0",)]["inventory_value_percentage"] == 96.0


# ---------------------------------------------------------------- ties / NTILE
def test_ntile_ties_nine_pairs(make_inventory):
    # nine pairs with identical cover: quartiles follow SKU order, sizes 3,2,2,2
    rows = [dict(SKU_ID=f"S{i}", Units_Sold=10, Inventory_Level=100, Reorder_Point=10) for i in range(9)]
    q = quartile_actions.with_cover_quartile(make_inventory(rows))
    got = {r["SKU_ID"]: r["cover_quartile"] for r in q.collect()}
    assert [got[f"S{i}"] for i in range(9)] == [1, 1, 1, 2, 2, 3, 3, 4, 4]
    excess = quartile_actions.excess_inventory(make_inventory(rows))
    assert sorted(r["SKU_ID"] for r in excess.collect()) == ["S7", "S8"]


def test_ntile_fewer_rows_than_tiles(make_inventory):
    rows = [dict(SKU_ID=f"S{i}", Units_Sold=10, Inventory_Level=10 * (i + 1)) for i in range(3)]
    got = {r["SKU_ID"]: r["cover_quartile"] for r in quartile_actions.with_cover_quartile(make_inventory(rows)).collect()}
    assert got == {"S0": 1, "S1": 2, "S2": 3}


# ---------------------------------------------------------------- collation (I4)
def test_case_and_accent_insensitive_keys(make_inventory):
    df = make_inventory([dict(SKU_ID=s) for s in ("ab", "AB", "áb", "ab ")])
    assert df.select(F.count_distinct("SKU_ID")).first()[0] == 4
    ci = with_collation(df, "UNICODE_CI_AI")
    assert ci.select(F.count_distinct("SKU_ID")).first()[0] == 2
    assert with_collation(df, "UTF8_LCASE").select(F.count_distinct("SKU_ID")).first()[0] == 3


# ---------------------------------------------------------------- rounding ties
def test_round_half_away_from_zero(make_inventory):
    df = make_inventory(
        [
            dict(Supplier_ID="S", Unit_Cost=Decimal("1.00"), Units_Sold=1, Demand_Forecast=Decimal("1.01")),
            dict(Supplier_ID="S", Unit_Cost=Decimal("1.01"), Units_Sold=1, Demand_Forecast=Decimal("1.00")),
        ]
    )
    assert one(supplier.profile(df))["avg_unit_cost"] == 1.01  # mean 1.005
    neg = make_inventory(
        [
            dict(Units_Sold=1, Demand_Forecast=Decimal("1.01")),
            dict(Units_Sold=1, Demand_Forecast=Decimal("1.00")),
        ]
    )
    # mean bias -0.005 -> -0.01
    assert {r["avg_forecast_bias"] for r in demand.promotion_impact(neg).collect()} == {-0.01}


def test_population_std_dev(make_inventory):
    rows = [dict(Supplier_ID="S", Supplier_Lead_Time_Days=v, SKU_ID=f"s{v}") for v in (2, 4, 4, 4, 5, 5, 7, 9)]
    assert one(supplier.lead_time_risk(make_inventory(rows)))["lead_time_std"] == 2.0


def test_reports_group_case_insensitively_with_collation(make_inventory):
    df = make_inventory(
        [dict(SKU_ID=s, Date=D1 + dt.timedelta(days=i)) for i, s in enumerate(("ab", "AB", "áb", "ab "))]
    )
    binary = inventory.coverage_risk(df).count()
    ci = inventory.coverage_risk(with_collation(df, "UNICODE_CI_AI"))
    assert binary == 4 and ci.count() == 2
    prof = {r["warehouse_count"] for r in quality.sku_profile(with_collation(df, "UNICODE_CI_AI")).collect()}
    assert prof == {1}


def test_catalog_inventory_counts_views(spark, make_inventory):
    from shelfwise.sources.catalog import catalog_inventory

    make_inventory([dict(), dict(SKU_ID="B")]).createOrReplaceTempView("inv_two_rows")
    spark.createDataFrame([], "x int").createOrReplaceTempView("inv_empty")
    got = {r["table_name"]: r["table_rows"] for r in catalog_inventory(spark).collect()}
    assert got["inv_two_rows"] == 2 and got["inv_empty"] == 0
    spark.catalog.dropTempView("inv_two_rows")
    spark.catalog.dropTempView("inv_empty")
