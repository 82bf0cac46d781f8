"""Streaming ingest of daily snapshot files equals the batch reports."""

import tempfile
from decimal import Decimal

from pyspark.sql import functions as F

from shelfwise.operators import actions, inventory, quality, quartile_actions, supplier
from shelfwise.operators.metrics import GRAINS, Inventory
from shelfwise.sources.derive import derive_inventory
from shelfwise.streaming import compact_grains, read_ingested, read_quarantine, start_ingest
from tests.conftest import SF_SMALL


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stream_ingest_matches_batch(spark):
    fact = derive_inventory(spark, SF_SMALL).cache()
    src = tempfile.mkdtemp(prefix="run-src-")
    out = tempfile.mkdtemp(prefix="run-out-")
    ckpt = tempfile.mkdtemp(prefix="run-ckpt-")
    years = sorted(r[0] for r in fact.select(F.year("Date")).distinct().collect())
    half = years[len(years) // 2]
    fact.filter(F.year("Date") < half).write.parquet(f"{src}/part1")
    # one broken row arrives with the second file
    bad = fact.limit(1).withColumn("Unit_Cost", F.lit(Decimal("0.00")).cast("decimal(10,2)"))
    # the second file repeats one day of the first, so a date spans two batches
    first_day = fact.filter(F.year("Date") < half).agg(F.min("Date")).first()[0]
    overlap = (
        fact.filter(F.col("Date") == first_day)
        .orderBy("SKU_ID", "Warehouse_ID")
        .limit(1)
        .withColumn("Warehouse_ID", F.lit("WH_9"))
    )
    fact.filter(F.year("Date") >= half).unionByName(bad).unionByName(overlap).write.parquet(
        f"{src}/part2"
    )
    fact = fact.unionByName(overlap)

    q = start_ingest(spark, f"{src}/*", out, ckpt)
    q.awaitTermination(300)
    got = read_ingested(spark, out)

    assert got.fact.count() == fact.count()
    quarantined = read_quarantine(spark, out).collect()
    assert len(quarantined) == 1 and quarantined[0]["violations"] == "chk_unit_cost"

    batch = Inventory(fact)
    for op in (
        inventory.coverage_risk,
        inventory.abc_concentration,
        actions.prioritized_list,
        quartile_actions.action_summary,
        quality.warehouse_profile,
        quality.span_cardinality,
        quality.promotion_distribution,
        quality.null_counts,
        quality.coverage,
        quality.summary,
    ):
        assert _rows(op(got)) == _rows(op(batch)), op.__name__

    # merged grains give the same reports
    compacted = compact_grains(spark, out, tempfile.mkdtemp(prefix="run-merged-") + "/s")
    for op in (actions.condition_counts, inventory.warehouse_efficiency, quality.promotion_distribution, quality.summary, supplier.profile):
        assert _rows(op(compacted)) == _rows(op(batch)), op.__name__
    for name in GRAINS:
        keys = compacted.grain(name).select(*GRAINS[name].keys)
        assert keys.count() == keys.distinct().count() <= spark.read.parquet(f"{out}/{name}").count()

    # a batch that is not published yet is not read, whatever it has written so far
    got.fact.limit(3).write.parquet(f"{out}/fact/batch=99")
    assert read_ingested(spark, out).fact.count() == fact.count()

    # a second run finds nothing new (exactly-once via the checkpoint)
    q2 = start_ingest(spark, f"{src}/*", out, ckpt)
    q2.awaitTermination(300)
    assert read_ingested(spark, out).fact.count() == fact.count()
    fact.unpersist()
