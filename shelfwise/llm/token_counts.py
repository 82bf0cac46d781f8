"""Exact length histogram of token counts.

Documents are aggregated by encoded length; suffix sums over the histogram then
answer, for every context limit, how many documents and tokens reach it, the
quantiles of length and the total after truncation.

Defined cases: a null or empty text has length 0; repeated rows count each time;
an empty table gives an empty histogram (and zero totals).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import bound_batches, table, written
from shelfwise.llm.encoding import ChunkEncoder, word_bpe_path

#: Lengths per block of the two-level suffix sums: no window spans the whole table.
BLOCK = 256


def lengths(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """(n_tokens: long), one row per document of ``docs`` (column text)."""
    path = tokenizer_path or word_bpe_path()
    bound_batches(docs.sparkSession)

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = ChunkEncoder(path)
        for batch in batches:
            n = [len(ids) // 4 for ids in encoder.encode(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], names=["n_tokens"])

    return docs.select(F.col("text").cast("string")).mapInArrow(count, "n_tokens long")


def histogram(counted: DataFrame) -> DataFrame:
    """One row per distinct length, with suffix sums.

    n_tokens, n_docs; docs_at_least, tokens_at_least: of documents of this length
    or more; truncated_total: tokens left when every document is cut to n_tokens;
    docs_up_to_share: share of documents of at most this length (its quantile).
    """
    # stored, since three branches read it and each would count all texts anew
    per = written(counted.groupBy("n_tokens").agg(F.count("*").alias("n_docs")))
    per = per.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("own", F.col("n_tokens") * F.col("n_docs"))
    blocks = per.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("own").alias("t"))
    # blocks of blocks, so that the one-partition window sees few rows whatever the lengths
    blocks = blocks.withColumn("top", F.floor(F.col("block") / BLOCK))
    tops = blocks.groupBy("top").agg(F.sum("d").alias("d"), F.sum("t").alias("t"))
    after = lambda w: w.rowsBetween(1, Window.unboundedFollowing)
    zero = lambda c: F.coalesce(c, F.lit(0))
    w = after(Window.orderBy("top"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = tops.select(
        "top", zero(F.sum("d").over(w)).alias("top_d"), zero(F.sum("t").over(w)).alias("top_t"), F.sum("d").over(whole).alias("all_docs"), F.sum("t").over(whole).alias("all_tokens")
    )
    w = after(Window.partitionBy("top").orderBy("block"))
    blocks = blocks.select("block", "top", zero(F.sum("d").over(w)).alias("d"), zero(F.sum("t").over(w)).alias("t"))
    blocks = blocks.join(tops, "top").select("block", (F.col("d") + F.col("top_d")).alias("d"), (F.col("t") + F.col("top_t")).alias("t"), "all_docs", "all_tokens")
    w = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(0, Window.unboundedFollowing)
    out = per.withColumn("docs_in", F.sum("n_docs").over(w)).withColumn("tokens_in", F.sum("own").over(w)).join(blocks, "block")
    out = out.withColumn("docs_at_least", F.col("docs_in") + F.col("d")).withColumn("tokens_at_least", F.col("tokens_in") + F.col("t"))
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
        ((F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_docs")).alias("docs_up_to_share"),
    )


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents longer than it, total and truncated total of tokens."""
    spark = hist.sparkSession
    wanted = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    cut = hist.select("n_tokens", "n_docs").join(F.broadcast(wanted))  # a stated list of limits
    return cut.groupBy("context_limit").agg(
        F.sum(F.when(F.col("n_tokens") > F.col("context_limit"), F.col("n_docs")).otherwise(0)).alias("docs_cut"),
        F.sum(F.col("n_tokens") * F.col("n_docs")).alias("tokens"),
        F.sum(F.least("n_tokens", "context_limit") * F.col("n_docs")).alias("tokens_kept"),
    )


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """For each share in 0..1: the smallest length that at least this share of documents does not exceed."""
    spark = hist.sparkSession
    wanted = spark.createDataFrame([(float(x),) for x in shares], "share double")
    return (
        hist.join(F.broadcast(wanted), F.col("docs_up_to_share") >= F.col("share")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
    )


def op2(spark, sf_dir: str) -> DataFrame:
    return histogram(lengths(table(spark, sf_dir, "documents", "text")))
