"""Continuous ingest of daily inventory snapshots (I1 + I2 on a stream).

Snapshot files (one or more days each) land in a folder.  A Structured
Streaming file source reads them with the fixed schema, the row contract
splits accepted from quarantined rows, and ``foreachBatch`` writes per
micro-batch:

* ``<out>/fact/batch=<id>``: accepted rows (the fact table, appended);
* ``<out>/quarantine/batch=<id>``: broken rows with the names of the rules;
* ``<out>/<grain>/batch=<id>``: the batch's partial rows of every grain of the lattice
  (``operators.metrics.GRAINS``);
* ``<out>/published/batch=<id>``: written last; a batch without it is not read, so a
  reader sees a batch's rows with all of its grains or not at all.

Each batch overwrites only its own ``batch=<id>`` folders, so a batch replayed
after a failure (same id, from the checkpoint) replaces its earlier partial
output instead of duplicating it.  Grains are append-only partial rows: every
column is a sum / min / max over them, so reports merge the partials as they read them;
``compact_grains`` merges them into one row per key when the folders get long.  No event-time
window or watermark is needed: every report covers all snapshot days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfwise.operators.metrics import GRAINS, Inventory, from_rows, merged
from shelfwise.schema import COLUMNS, INVENTORY_SCHEMA
from shelfwise.sources import contract
from shelfwise.sources.store import open_inventory, store_grains


def snapshot_stream(
    spark: SparkSession, source_dir: str, fmt: str = "parquet", max_files_per_trigger: int | None = None
) -> DataFrame:
    """Streaming DataFrame of snapshot rows (fixed schema, checked)."""
    reader = spark.readStream.schema(INVENTORY_SCHEMA).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("dateFormat", "yyyy-MM-dd").option("enforceSchema", False)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(source_dir)
    problems = contract.check_schema(stream)
    if problems:
        raise ValueError("inventory schema mismatch: " + "; ".join(problems))
    return stream


def _write_batch(out_dir: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            accepted, bad = contract.split(batch)
            accepted = accepted.select(*COLUMNS)
            bad = bad.withColumn("violations", F.concat_ws(",", "violations"))
            accepted.write.mode("overwrite").parquet(f"{out_dir}/fact/batch={batch_id}")
            bad.write.mode("overwrite").parquet(f"{out_dir}/quarantine/batch={batch_id}")
            for name, grain in GRAINS.items():
                from_rows(accepted, grain).write.mode("overwrite").parquet(f"{out_dir}/{name}/batch={batch_id}")
            batch.sparkSession.range(1).write.mode("overwrite").parquet(f"{out_dir}/published/batch={batch_id}")
        finally:
            batch.unpersist()

    return write


def start_ingest(
    spark: SparkSession,
    source_dir: str,
    out_dir: str,
    checkpoint_dir: str,
    fmt: str = "parquet",
    available_now: bool = True,
    processing_time: str | None = None,
) -> StreamingQuery:
    """Start the ingest query (``availableNow`` by default: process what is there, stop)."""
    writer = (
        snapshot_stream(spark, source_dir, fmt)
        .writeStream.foreachBatch(_write_batch(out_dir))
        .option("checkpointLocation", checkpoint_dir)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def _published(spark: SparkSession, out_dir: str, name: str) -> DataFrame:
    """The rows of one folder that belong to published batches."""
    batches = spark.read.parquet(f"{out_dir}/published").select("batch").distinct()
    return spark.read.parquet(f"{out_dir}/{name}").join(F.broadcast(batches), "batch", "left_semi").drop("batch")


def read_ingested(spark: SparkSession, out_dir: str) -> Inventory:
    """The ingested fact table with the partial grains of its batches."""
    grains = {name: _published(spark, out_dir, name) for name in GRAINS}
    return Inventory(_published(spark, out_dir, "fact"), grains, partial=True)


def read_quarantine(spark: SparkSession, out_dir: str) -> DataFrame:
    return _published(spark, out_dir, "quarantine")


def compact_grains(spark: SparkSession, out_dir: str, target_dir: str) -> Inventory:
    """Merge the partial rows of all published batches into a stored lattice under target_dir, one row per key."""
    bases = {name: merged(_published(spark, out_dir, name), grain) for name, grain in GRAINS.items() if not grain.finer}
    store_grains(bases, target_dir)
    return open_inventory(spark, target_dir, _published(spark, out_dir, "fact"))
