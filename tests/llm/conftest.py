import random

import pytest

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that the operators use themselves
        T.StructField("score", T.StringType()),
        T.StructField("mark", T.IntegerType()),
        T.StructField("cut_words", T.StringType()),
    ]
)


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n))


def doc(doc_id, text):
    return (doc_id, text, "en", None, None if text is None else len(text), "own", 7, None)


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with columns whose names clash with the operators' own."""

    def build(rows):
        return spark.createDataFrame([doc(*r) for r in rows], DOCS).repartition(3)

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank, very long, repeated and non-Latin rows."""
    long = words(1, 30_000)
    return [(None, "no id here"), (1, None), (2, ""), (3, " \n\t "), (4, long), (5, words(2, 80)), (5, words(2, 80)), (6, words(2, 80)), (7, "été 你好 😀 É"), (8, "one"), (-3, "below zero"), (9, "x" * 5000)]
