"""Helpers shared by the operators: inputs, tables in the shared folder, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch handed to a Python task, so that a batch of long texts stays small.
BATCH_ROWS = 2000
#: Bits of a map of repeated keys (8 MB, whatever the input): a hint for a scan, which then exchanges little more than those keys.
MAP_BITS = 1 << 26


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a source table, read whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def give_back() -> None:
    """Hands free memory of this process back to the system: Arrow's and, where the C library can, that of arrays and strings."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def giving_back(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` for ``mapInArrow``, whose tasks give back at their end what they no longer use.

    Spark's Python workers go on to other tasks; what one step's tasks needed would else stay with them beside the next step's.
    """

    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of this process only where it is unset (tests)."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster
    folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def written(df: DataFrame, *partitioned_by: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.partitionBy(*partitioned_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_bit_map(bits, keys):
    """Which of ``keys`` (int64) have their bit set in a map made by ``bit_map`` (as an array of bytes)."""
    at = keys & (MAP_BITS - 1)
    return (bits[at >> 3] >> (at & 7) & 1).astype(bool)


#: Bits of the map of marked rows (2 MB, whatever the input).
MARK_BITS = 1 << 24


def with_mark(df: DataFrame, key, marked: DataFrame) -> DataFrame:
    """``df`` with column mark: true where ``key`` (long) is among the values of ``marked`` (one column), and for a few others.

    The marks are a bit map in rows of 4 KB, MARK_BITS in all, which every task gets.
    """
    value = F.pmod(F.col(marked.columns[0]), F.lit(MARK_BITS))
    bits = marked.select((value / 32768).cast("int").alias("word"), (value % 32768).alias("place")).groupBy("word").agg(F.bitmap_construct_agg("place").alias("bits"))
    own = F.pmod(key, F.lit(MARK_BITS))
    placed = df.withColumn("_word", (own / 32768).cast("int")).withColumn("_place", (own % 32768).cast("int"))
    joined = placed.join(F.broadcast(bits.withColumnRenamed("word", "_word")), "_word", "left")
    byte = F.conv(F.hex(F.expr("substring(bits, _place div 8 + 1, 1)")), 16, 10).cast("int")
    mark = F.coalesce(F.expr("pmod(_place, 8)").cast("int"), F.lit(0))
    on = F.coalesce(F.call_function("shiftright", byte, mark).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return joined.withColumn("mark", on).select(*df.columns, "mark")


def free_name(columns: list[str], name: str) -> str:
    """``name``, with underscores before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def bit_map(keys: DataFrame) -> bytes:
    """MAP_BITS bits; bit (key mod MAP_BITS, key unsigned) is set for every key given. Its size never grows."""
    bit = F.col("key").bitwiseAND(F.lit(MAP_BITS - 1))
    word = keys.select((bit / 32768).cast("int").alias("word"), (bit % 32768).alias("place")).groupBy("word").agg(F.bitmap_construct_agg("place").alias("bits"))
    rows = word.collect()  # at most MAP_BITS / 32768 rows of 4 KB
    out = bytearray(MAP_BITS // 8)
    for r in rows:
        out[r.word * 4096 : r.word * 4096 + len(r.bits)] = r.bits
    return bytes(out)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: long): (id, component), component = smallest id reachable.

    Alternates large-star and small-star steps until the edge set no longer
    changes; every step is one aggregate over the edges and one join, written to
    the shared folder. Self loops and repeated edges are harmless; an empty edge
    table gives an empty result.
    """
    e = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: each larger neighbour is linked to the smallest vertex around u
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        # small star: u and its smaller neighbours are linked to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .filter("u <> v")
            .distinct()
        )
        e = written(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = e.groupBy("u").agg(F.min("v").alias("component"))
    return stars.select(F.col("u").alias("id"), "component").unionAll(
        stars.select(F.col("component").alias("id"), "component").distinct()
    )
