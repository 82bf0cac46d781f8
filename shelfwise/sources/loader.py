"""I1 / I4: read the inventory fact table with its fixed schema.

Files are read with the explicit ``INVENTORY_SCHEMA`` (never inferred).
``collation="UNICODE_CI_AI"`` makes the key columns case- and
accent-insensitive for grouping, distinct counts and comparisons, like an
accent- and case-insensitive database collation; the default keeps binary
strings.

``key_dictionary`` collates each distinct key once instead of every row: raw key
-> the group's number and folded label; rows are then grouped by numbers.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.schema import COLUMNS, INVENTORY_SCHEMA, KEY_COLUMNS


def read_inventory(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    *,
    header: bool = True,
    collation: str | None = None,
) -> DataFrame:
    reader = spark.read.schema(INVENTORY_SCHEMA)
    if fmt == "csv":
        # columns are bound by the header's names, and a header that differs is an error
        reader = reader.option("header", header).option("dateFormat", "yyyy-MM-dd").option("enforceSchema", not header)
    df = reader.format(fmt).load(path)
    return with_collation(df, collation) if collation else df.select(*COLUMNS)


def with_collation(df: DataFrame, collation: str = "UNICODE_CI_AI") -> DataFrame:
    """Re-type the string key columns with ``collation`` (I4)."""
    return df.select(
        *[
            F.collate(F.col(c), collation).alias(c) if c in KEY_COLUMNS else F.col(c)
            for c in df.columns
        ]
    )


def _folding() -> tuple[str, str]:
    """(characters, replacements) that strip accents: precomposed letters to their base, combining marks to nothing.

    By the rule of Unicode's canonical decomposition, over the Basic Multilingual Plane."""
    composed, bases, marks = [], [], []
    for code in range(0x80, 0xD800):
        c = chr(code)
        if unicodedata.combining(c):
            marks.append(c)
        else:
            base = [x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x)]
            if len(base) == 1 and base[0] != c:
                composed.append(c)
                bases.append(base[0])
    return "".join(composed + marks), "".join(bases)


def folded(text: Column) -> Column:
    """Lower case, without accents, sharp s written out: the label of keys that a case- and accent-insensitive collation holds equal."""
    old, new = _folding()
    return F.replace(F.translate(F.lower(text), old, new), F.lit("\u00df"), F.lit("ss"))


def key_dictionary(values: DataFrame, collation: str = "UNICODE_CI_AI") -> DataFrame:
    """(raw, number, label) of the distinct keys in ``values`` (one column).

    Keys that are equal under ``collation`` share a number, the hash of the group's least
    raw key, and its folded label.  NULL is a key of its own."""
    raw = values.toDF("raw").distinct()
    alike = Window.partitionBy(F.collate("raw", collation))
    first = F.min("raw").over(alike)
    return raw.select("raw", F.xxhash64(first).alias("number"), folded(first).alias("label"))


def with_key_numbers(df: DataFrame, keys: Sequence[str], collation: str = "UNICODE_CI_AI") -> DataFrame:
    """``df`` with ``<key>_number`` and ``<key>_label`` for each key, from its dictionary (the planner broadcasts a small one)."""
    for key in keys:
        words = key_dictionary(df.select(key), collation)
        words = words.toDF("_raw", f"{key}_number", f"{key}_label")
        df = df.join(words, F.col(key).eqNullSafe(F.col("_raw")), "left").drop("_raw")
    return df
