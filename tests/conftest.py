import datetime as dt
import os
import sys
import tempfile
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from shelfwise.schema import INVENTORY_SCHEMA  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"

NULLABLE_SCHEMA = T.StructType(
    [T.StructField(f.name, f.dataType, True) for f in INVENTORY_SCHEMA.fields]
)


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[*]")
        .appName("shelfwise-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    if not s.sparkContext.getCheckpointDir() and not s.conf.get("spark.checkpoint.dir", None):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
    s.sparkContext.setLogLevel("ERROR")
    yield s


BASE = dict(
    Date=dt.date(2024, 1, 1),
    SKU_ID="SKU_1",
    Warehouse_ID="WH_1",
    Supplier_ID="SUP_1",
    Region="North",
    Units_Sold=10,
    Inventory_Level=100,
    Supplier_Lead_Time_Days=5,
    Reorder_Point=50,
    Order_Quantity=0,
    Unit_Cost=Decimal("2.00"),
    Unit_Price=Decimal("3.00"),
    Promotion_Flag=0,
    Stockout_Flag=0,
    Demand_Forecast=Decimal("10.00"),
)


def row(**kw):
    r = dict(BASE)
    r.update(kw)
    return tuple(r[f.name] for f in NULLABLE_SCHEMA.fields)


@pytest.fixture
def make_inventory(spark):
    def build(rows):
        return spark.createDataFrame([row(**r) if isinstance(r, dict) else r for r in rows], NULLABLE_SCHEMA)

    return build
