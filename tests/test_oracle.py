"""Every registered report against its DuckDB oracle on the driver's data (sf0.001)."""

import datetime as dt
import decimal

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _norm(v):
    if isinstance(v, float):
        return ("f", repr(v))
    if isinstance(v, decimal.Decimal):
        return ("d", str(v))
    if isinstance(v, (dt.date, dt.datetime)):
        return ("t", v.isoformat())
    return (type(v).__name__, "" if v is None else str(v))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_keys_align():
    from shelfwise.plans import all_queries, oracle_queries

    assert set(oracle_queries()) == set(all_queries())
    assert len(all_queries()) == 64
    assert set(oracle_queries()) <= set(E.oracle_sql()) and set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 30
    assert df.columns == [
        "SKU_ID", "Warehouse_ID", "inventory_value", "days_of_cover", "stockout_rate", "priority_action",
    ]


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE"}


@pytest.mark.parametrize("key", sorted(E.oracle_sql()))
def test_report_matches_oracle(spark, duck, key):
    sdf = E.queries()[key](spark, SF_SMALL)
    scols = sdf.columns
    srows = sdf.collect()
    rel = duck.sql(E.oracle_sql()[key])
    dtypes = dict(zip(rel.columns, [str(t) for t in rel.types]))
    res = duck.execute(E.oracle_sql()[key])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(scols) == sorted(dcols)
    for f in sdf.schema.fields:  # same column types in both engines
        t = f.dataType.simpleString()
        assert dtypes[f.name] == SPARK_TO_DUCK.get(t, t.upper()), (f.name, t, dtypes[f.name])
    si = sorted(range(len(scols)), key=lambda i: scols[i])
    di = sorted(range(len(dcols)), key=lambda i: dcols[i])
    got = sorted(tuple(_norm(r[i]) for i in si) for r in srows)
    want = sorted(tuple(_norm(r[i]) for i in di) for r in drows)
    assert got == want
