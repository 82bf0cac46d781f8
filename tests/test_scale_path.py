"""Every report against the oracle on tables read back from a stored inventory,
as partial grains (each row's batch apart), with more ranges than cores."""

import tempfile
from dataclasses import replace
from functools import reduce

import pytest

import __spark_entry__ as E
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from shelfwise.operators.metrics import GRAINS, Inventory, from_rows
from shelfwise.params import DEFAULT
from shelfwise.plans.registry import REPORTS
from shelfwise.sources.store import inventory_data
from tests.conftest import SF_SMALL
from tests.test_oracle import TABLES, _norm

LARGE = replace(DEFAULT, window_partitions=4)


@pytest.fixture(scope="module")
def large_path_data(spark):
    stored = inventory_data(spark, SF_SMALL)
    half = F.pmod(F.xxhash64(*stored.fact.columns), F.lit(2))
    parts = [stored.fact.filter(half == i) for i in (0, 1)]
    grains = {name: reduce(DataFrame.unionAll, [from_rows(p, g) for p in parts]) for name, g in GRAINS.items()}
    path = tempfile.mkdtemp(prefix="run-")
    for name, df in grains.items():
        df.write.parquet(f"{path}/{name}")
    return Inventory(stored.fact, {name: spark.read.parquet(f"{path}/{name}") for name in grains}, LARGE, partial=True)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", sorted(REPORTS))
def test_large_path_matches_oracle(large_path_data, duck, key):
    df = REPORTS[key][1](large_path_data, LARGE)
    cols = df.columns
    got = sorted(tuple(_norm(r[i]) for i in sorted(range(len(cols)), key=lambda i: cols[i])) for r in df.collect())
    res = duck.execute(E.oracle_sql()[key])
    dcols = [d[0] for d in res.description]
    want = sorted(
        tuple(_norm(r[i]) for i in sorted(range(len(dcols)), key=lambda i: dcols[i])) for r in res.fetchall()
    )
    assert got == want
