"""Physical-plan assertions: pruning, top-k, pushdown, no full sort for LIMIT."""

import re

import pytest

from pyspark.sql import functions as F

from shelfwise.operators import actions, demand, inventory, quality, quartile_actions, risk, supplier
from shelfwise.operators.metrics import group_metrics
from shelfwise.sources.derive import derive_inventory
from shelfwise.plans import all_queries
from shelfwise.sources import contract
from shelfwise.sources.store import inventory_data, inventory_table, open_inventory, store_inventory
from tests.conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def data(spark):
    return inventory_data(spark, SF_SMALL)


def test_pair_report_reads_only_needed_columns(data):
    p = plan(inventory.coverage_risk(data))
    cols = re.search(r"FileScan parquet [^\[]*\[([^\]]*)\]", p).group(1)
    assert "s_units" in cols and "s_lead" in cols
    for unused in ("s_margin", "s_value", "q_units", "s_forecast"):
        assert unused not in cols


def test_pair_reports_project_the_pair_grain(data):
    """No aggregate and no shuffle but the report's own order."""
    for op in (inventory.coverage_risk, actions.prioritized_list, risk.composite_score):
        df = op(data)
        assert "Aggregate" not in plan(df) and "hashpartitioning" not in plan(df)
        assert all("/pair/" in f for f in df.inputFiles())


def test_each_report_reads_the_smallest_grain_that_answers_it(data):
    reads = {
        "total": [quality.row_count, quality.span_cardinality, quality.null_counts, quality.coverage, quality.dimension_cardinality,
                  quality.summary, inventory.overall, demand.overall, supplier.overall, actions.executive_kpis, quartile_actions.executive_summary],
        "warehouse": [quality.warehouse_profile, inventory.warehouse_efficiency, actions.warehouse_priorities, quartile_actions.warehouse_concentration],
        "sku": [quality.sku_profile, demand.sku_volatility, demand.volatility_segments],
        "supplier": [supplier.profile, supplier.replenishment_efficiency, supplier.lead_time_risk],
        "supplier_pair": [supplier.high_risk_combinations],
        "flags": [demand.promotion_impact, demand.stockout_risk],
    }
    for name, ops in reads.items():
        for op in ops:
            df = op(data)
            assert {f.rsplit("/", 2)[1] for f in df.inputFiles()} == {name}, op.__name__
            assert name == "flags" or "Aggregate" not in plan(df)  # so neither an Expand per distinct count
    sizes = {n: data.grain(n).count() for n in ("total", "warehouse", "supplier", "sku", "pair", "supplier_pair")}
    assert list(sizes.values()) == sorted(sizes.values()) and sizes["pair"] == data.fact.select("SKU_ID", "Warehouse_ID").distinct().count()


def test_stored_distinct_counts(data):
    for key, others in (("SKU_ID", ["Warehouse_ID"]), ("Warehouse_ID", ["SKU_ID", "Supplier_ID"]), ("Supplier_ID", ["SKU_ID", "Warehouse_ID"])):
        aggs = [F.count_distinct(o).alias(f"distinct_{o}") for o in others]
        want = sorted(map(tuple, data.fact.groupBy(key).agg(*aggs).collect()))
        assert sorted(map(tuple, group_metrics(data, [key], distinct=others).collect())) == want


def test_top_quartile_needs_no_sort_and_no_checkpoint(data):
    for op in (quartile_actions.action_summary, quartile_actions.priority_list):
        df = op(data)
        assert "ExistingRDD" not in plan(df) and all("/pair/" in f for f in df.inputFiles())
    assert "Sort" not in plan(quartile_actions.priority_list(data)).replace("TakeOrderedAndProject", "")
    assert "SinglePartition" not in plan(inventory.abc_concentration(data))


def test_keyless_reports_of_plain_rows_aggregate_them_directly(data):
    p = plan(quality.null_counts(data.fact))
    assert "hashpartitioning" not in p and p.count("SinglePartition") == 1


def test_limit_reports_use_take_ordered(data):
    for op in (actions.prioritized_list, inventory.pair_profile, actions.top_value_attention):
        assert "TakeOrderedAndProject" in plan(op(data))


def _scan_cols(p):
    m = re.search(r"FileScan parquet [^\[]*\[([^\]]*)\]", p)
    return {c.split("#")[0] for c in m.group(1).split(",")}


def test_row_checks_read_two_columns(data):
    assert _scan_cols(plan(quality.commercial_logic(data))) == {
        "qc_non_positive_margin",
        "qc_replenishment_at_zero_inventory",
    }


def test_flag_reports_read_the_flags_grain(data):
    cols = _scan_cols(plan(demand.stockout_risk(data)))
    assert "Stockout_Flag" in cols and "s_units" in cols
    assert "SKU_ID" not in cols and "s_margin" not in cols


def test_derivation_prunes_lineitem(spark):
    p = plan(derive_inventory(spark, SF_SMALL))
    li = [m for m in re.findall(r"FileScan parquet \[([^\]]*)\]", p) if "l_partkey" in m][0]
    cols = {c.split("#")[0] for c in li.split(",")}
    assert cols == {"l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_shipdate"}


def test_duplicate_check_hashes_unsorted_rows_before_the_exact_group(data):
    p = plan(quality.full_row_duplicates(data.fact))
    assert "xxhash64" in p and "LeftSemi" in p


def test_duplicates_of_a_stored_fact_need_no_exchange(data):
    assert "Exchange" not in plan(quality.business_key_duplicates(data))
    p = plan(quality.full_row_duplicates(data))
    assert "hashpartitioning" not in p and not any("/fact/" in f for f in quality.full_row_duplicates(data).inputFiles())


def test_stored_duplicates_are_those_of_the_rows(spark, make_inventory, tmp_path):
    """One row copied many times, business keys that repeat with other values, NULL keys."""
    rows = [dict(SKU_ID="HOT")] * 2000 + [dict(SKU_ID=f"S{i}", Units_Sold=i) for i in range(40)]
    rows += [dict(SKU_ID="S3", Units_Sold=99), dict(SKU_ID=None), dict(SKU_ID=None), dict(SKU_ID=None, Units_Sold=1)]
    fact = make_inventory(rows)
    store_inventory(fact, str(tmp_path / "kept"))
    data = open_inventory(spark, str(tmp_path / "kept"))
    want = {(r.SKU_ID, r.record_count) for r in quality.business_key_duplicates(fact).collect()}
    assert {(r.SKU_ID, r.record_count) for r in quality.business_key_duplicates(data).collect()} == want == {("HOT", 2000), ("S3", 2), (None, 3)}
    assert quality.full_row_duplicates(data).first()[0] == quality.full_row_duplicates(fact).first()[0] == 2


def test_table_counts_come_from_footers(spark):
    df = all_queries()["catalog_table_rows"](spark, SF_SMALL)
    assert plan(df).count("PushedAggregation: [COUNT(*)]") == 15 or plan(df).count("COUNT(*)") >= 15
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"  # the caller's settings stay


def test_contract_evaluates_each_rule_once_per_row(data):
    good, bad = contract.split(data.fact)
    p = plan(bad)
    assert p.count("(length(SKU_ID") <= 2 and "violations" in p  # the filter's mask, and the mask of the rows that it keeps


def test_warehouses_grow_with_the_input(spark):
    small, large = (inventory_table(spark, f"/root/testdata/{sf}").select("Warehouse_ID").distinct().count() for sf in ("sf0.001", "sf0.01"))
    assert (small, large) == (5, 20)
