"""A key holding a third of all rows must not land in one task."""

import datetime as dt
from pyspark.sql import functions as F

from shelfwise.operators import actions
from shelfwise.operators.ranking import By, _ranged, range_sums
from shelfwise.sources.store import fact_layout


def _hot_fact(make_inventory, n_rows=600):
    rows = []
    for i in range(n_rows):
        hot = i % 3 == 0  # a third of the rows belong to one pair
        rows.append(
            dict(
                Date=dt.date(2020, 1, 1) + dt.timedelta(days=i),
                SKU_ID="HOT" if hot else f"S{i % 97:02d}",
                Warehouse_ID="W1" if hot else f"W{i % 5}",
                Units_Sold=i % 13,
            )
        )
    return make_inventory(rows)


def _partition_sizes(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]


def test_fact_layout_spreads_a_hot_pair(make_inventory):
    fact = _hot_fact(make_inventory)
    laid = fact_layout(fact, 8)
    sizes = _partition_sizes(laid)
    assert max(sizes) < 0.25 * sum(sizes)  # the hot third is spread over several files
    hot_parts = laid.filter(F.col("SKU_ID") == "HOT").select(F.spark_partition_id()).distinct().count()
    assert hot_parts >= 2


def test_distributed_ranking_splits_a_hot_value(spark):
    rows = [(f"k{i:04d}", 7.0 if i % 3 == 0 else float(i)) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, cover double")
    by = [By("cover"), By("k")]
    tagged = _ranged(df, by, range_sums(df, "cover", by, 6)["bounds"])
    sizes = [r["count"] for r in tagged.groupBy("_range").count().collect()]
    assert max(sizes) < 0.25 * sum(sizes)


def test_reports_on_hot_pair_are_whole(make_inventory):
    fact = _hot_fact(make_inventory)
    pairs = fact.select("SKU_ID", "Warehouse_ID").distinct().count()
    assert actions.action_matrix(fact).count() == pairs
    hot = [r for r in actions.action_matrix(fact).collect() if r["SKU_ID"] == "HOT"]
    assert len(hot) == 1


def test_hot_warehouse_is_folded_before_the_exchange(make_inventory):
    """A warehouse with most rows: partial sums per task cross the exchange, not its rows."""
    from shelfwise.operators import inventory, quality
    from shelfwise.operators.metrics import GRAINS, from_rows

    fact = make_inventory([dict(SKU_ID=f"S{i % 50}", Warehouse_ID="HOT" if i % 10 else f"W{i % 7}", Units_Sold=i % 5) for i in range(3000)]).repartition(6)
    plan = from_rows(fact, GRAINS["warehouse"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and "partial_sum" in plan
    rows = {r["Warehouse_ID"]: r for r in quality.warehouse_profile(fact).collect()}
    assert rows["HOT"]["observations"] == 2700 and rows["HOT"]["active_skus"] == 45
    assert sum(r["observations"] for r in rows.values()) == 3000 and inventory.warehouse_efficiency(fact).count() == len(rows)
