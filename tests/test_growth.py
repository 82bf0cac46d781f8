"""Work that a report shares with others grows no faster than the input: narrow rows are moved, tables of the lattice
are stored when a report reads them, repeated rows are found without moving rows, partitions follow the rows."""

import datetime as dt
import os

import pytest

from pyspark.sql import functions as F

from shelfwise.operators import demand, inventory, quality
from shelfwise.plans import all_queries
from shelfwise.schema import COLUMNS
from shelfwise.sources import store
from shelfwise.sources.derive import derive_inventory, keyed_days, source_frames


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def sf(spark, tmp_path):
    """A few lines of its own, with a NULL part, a supplier that is unknown and lines that come twice."""
    day = dt.datetime(2020, 1, 1)
    lines = [(i % 7, i % 40, i % 6, float(1 + i % 9), (i % 11) / 100, day + dt.timedelta(days=i % 5)) for i in range(300)]
    lines += lines[:20] + [(1, None, 3, 2.0, 0.0, day), (None, 4, None, 1.0, 0.09, day)]
    tables = {
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_shipdate timestamp"),
        "supplier": ([(i, i % 3) for i in range(5)], "s_suppkey long, s_nationkey long"),
        "nation": ([(i, i % 2) for i in range(3)], "n_nationkey long, n_regionkey long"),
        "region": ([(0, "ASIA"), (1, "EUROPE")], "r_regionkey long, r_name string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def _stored(spark, sf_dir) -> set[str]:
    path = store.scratch_path(spark, store._label(sf_dir)[1], "aggregates").removeprefix("file:")
    return {os.path.relpath(d, path) for d, _, files in os.walk(path) if "_SUCCESS" in files}


def test_a_report_stores_the_tables_that_it_reads(spark, sf):
    data = store.inventory_data(spark, sf)
    assert _stored(spark, sf) == set()
    demand.promotion_impact(data).collect()
    assert _stored(spark, sf) == {"flags"}
    assert inventory.overall(data).collect() == inventory.overall(data.fact).collect()
    kept = _stored(spark, sf)
    assert {"total", "parts/sku"} <= kept and not {"supplier_pair", "repeated_keys", "repeated_rows"} & kept


def test_fact_rows_are_moved_before_their_measures(spark, sf):
    narrow = keyed_days(*source_frames(spark, sf))
    assert len(narrow.columns) < len(COLUMNS) and not {"Unit_Cost", "Demand_Forecast"} & set(narrow.columns)
    got, want = store.inventory_table(spark, sf), derive_inventory(spark, sf)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_partitions_follow_the_rows(spark, sf, monkeypatch):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert store.sized_session(spark, 10).conf.get("spark.sql.shuffle.partitions") == before
    monkeypatch.setattr(store, "ROWS_PER_PARTITION", 10)
    want = all_queries()["ingest_collated_keys"](spark, sf)
    assert int(want.sparkSession.conf.get("spark.sql.shuffle.partitions")) == 33  # 322 lines
    assert want.agg(F.sum("records")).first()[0] == store.inventory_table(spark, sf).count()
    dirty = all_queries()["dirty_full_row_duplicates"](spark, sf)
    assert int(dirty.sparkSession.conf.get("spark.sql.shuffle.partitions")) == 33
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


@pytest.mark.parametrize("words", [1, 1 << 20])
def test_repeated_rows_are_found_without_moving_rows(spark, make_inventory, monkeypatch, words):
    """Whether the map of hashes is sparse or full; with NULL keys, a hot row and keys that repeat with other values."""
    monkeypatch.setattr(quality, "MAP_WORDS", words)
    rows = [dict(SKU_ID=f"S{i % 150}", Units_Sold=i // 300) for i in range(400)] + [dict(SKU_ID=None)] * 3 + [dict(SKU_ID="HOT")] * 50
    fact = make_inventory(rows)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        groups = quality.duplicate_groups(fact, COLUMNS)
        assert "SortMergeJoin" not in plan(groups)
        got = sorted((r.SKU_ID or "", r.Units_Sold, r.record_count) for r in groups.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = fact.groupBy(*COLUMNS).count().filter("count > 1").collect()
    assert got == sorted((r.SKU_ID or "", r.Units_Sold, r["count"]) for r in want)
