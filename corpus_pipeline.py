"""The corpus pipeline: each stage works on the documents its predecessor kept.

1. quality classifier: documents that it rejects go;
2. n-gram Jaccard join: one document of each near-duplicate group stays (five-word shingles, similarity 0.8);
3. substring dedup: passages that repeat an earlier document's go (five-word shingles, 50 words, similarity 0.8);
4. packing: the remaining texts as token sequences of power-of-two lengths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm import jaccard_join, packing, passages, quality
from shelfwise.llm.common import written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.without_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def unrepeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return passages.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("n-gram Jaccard join", one_of_each_group),
    ("substring dedup", unrepeated_passages),
    ("packing", packed),
]

#: A trained network, hashed shingles and a tokenizer have no SQL; tests hold each stage against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
