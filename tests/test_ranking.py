"""Distributed global ranking equals Spark's single-partition Window."""

from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfwise.operators import ranking
from shelfwise.operators.ranking import By, above, keys_at, order_key, tile_keys, with_ntile, with_running_sum
from shelfwise.params import DEFAULT

DIST = replace(DEFAULT, global_window="distributed", window_partitions=3)
BUILTIN = replace(DEFAULT, global_window="builtin")


def _frame(spark, values):
    rows = [(f"k{i:03d}", v, None if v is None else int(v * 10)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, cover double, value long")


def order():
    return [By("cover"), By("k")]


@pytest.fixture(autouse=True)
def small_leaves(monkeypatch):
    monkeypatch.setattr(ranking, "LEAF", 5)
    monkeypatch.setattr(ranking, "FAN", 4)
    monkeypatch.setattr(ranking, "OVERSAMPLE", 2)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(0, 5).map(float)), min_size=0, max_size=40))
def test_ntile_distributed_equals_builtin(spark, values):
    df = _frame(spark, values)
    for k in (4, 3):
        a = {r["k"]: r["q"] for r in with_ntile(df, k, order(), "q", DIST).collect()}
        b = {r["k"]: r["q"] for r in with_ntile(df, k, order(), "q", BUILTIN).collect()}
        assert a == b


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(0, 5).map(float)), min_size=0, max_size=40))
def test_running_sum_distributed_equals_builtin(spark, values):
    df = _frame(spark, values)
    for o in (order(), [By("value", desc=True, nulls_last=True), By("k")]):
        a = {r["k"]: r["s"] for r in with_running_sum(df, "value", o, "s", DIST).collect()}
        b = {r["k"]: r["s"] for r in with_running_sum(df, "value", o, "s", BUILTIN).collect()}
        assert a == b


def test_distributed_plan_compares_rows_with_constants(spark):
    df = _frame(spark, [float(i % 7) for i in range(200)])
    out = with_ntile(df, 4, order(), "q", DIST)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "ExistingRDD" in plan  # the local rows themselves
    builtin_plan = with_ntile(df, 4, order(), "q", BUILTIN)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" in builtin_plan
    got = sorted(r["q"] for r in out.collect())
    want = df.withColumn("q", F.ntile(4).over(Window.orderBy(F.col("cover").asc_nulls_first(), F.col("k").asc())))
    assert got == sorted(r["q"] for r in want.collect())
    sums = with_running_sum(df, "value", order(), "s", DIST)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in sums


def test_selection_with_odd_keys(spark):
    """Quotes, backslashes, non-Latin keys and NULLs as boundary keys; every rank."""
    keys = ["it's", 'a"b', "back\\slash", "\\'", "été", "你好", "", None, "x\ny", "%s", "{0}"] * 3
    rows = [(None if i % 5 == 0 else i % 3 / 7, k, i) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "cover double, k string, i long")
    by = [By("cover"), By("k"), By("i")]
    frame = df.select(order_key(by).alias("key"))
    ranked = [tuple(r.key) for r in frame.orderBy("key").collect()]
    assert [tuple(k) for k in keys_at(frame, len(rows), range(1, len(rows) + 1))] == ranked
    for tile, key in enumerate(tile_keys(df, 4, by), 1):
        assert {r.i for r in df.filter(above(df, by, key)).collect()} == {r.i for r in with_ntile(df, 4, by, "q", BUILTIN).collect() if r.q > tile}


def test_selection_among_repeated_keys(spark):
    frame = spark.createDataFrame([((7.0,),)] * 50 + [((9.0,),)], "key struct<v0: double>")
    assert [k.v0 for k in keys_at(frame, 51, [1, 25, 50, 51])] == [7.0, 7.0, 7.0, 9.0]
    assert keys_at(frame, 51, [0]) == [None]


@pytest.mark.parametrize("mode", ["distributed", "builtin"])
def test_ntile_hot_value(spark, mode):
    # a third of the rows share one cover value: the range bounds split them by key
    values = [7.0] * 30 + [float(i) for i in range(60)]
    df = _frame(spark, values)
    p = replace(DEFAULT, global_window=mode, window_partitions=4)
    counts = {r["q"]: r["count"] for r in with_ntile(df, 4, order(), "q", p).groupBy("q").count().collect()}
    assert counts == {1: 23, 2: 23, 3: 22, 4: 22}
