"""Schema of the inventory fact table and the column groups the operators use."""

from pyspark.sql import types as T

# One row per Date x SKU x Warehouse (daily snapshot).
INVENTORY_SCHEMA = T.StructType(
    [
        T.StructField("Date", T.DateType(), False),
        T.StructField("SKU_ID", T.StringType(), False),
        T.StructField("Warehouse_ID", T.StringType(), False),
        T.StructField("Supplier_ID", T.StringType(), False),
        T.StructField("Region", T.StringType(), False),
        T.StructField("Units_Sold", T.IntegerType(), False),
        T.StructField("Inventory_Level", T.IntegerType(), False),
        T.StructField("Supplier_Lead_Time_Days", T.IntegerType(), False),
        T.StructField("Reorder_Point", T.IntegerType(), False),
        T.StructField("Order_Quantity", T.IntegerType(), False),
        T.StructField("Unit_Cost", T.DecimalType(10, 2), False),
        T.StructField("Unit_Price", T.DecimalType(10, 2), False),
        T.StructField("Promotion_Flag", T.IntegerType(), False),
        T.StructField("Stockout_Flag", T.IntegerType(), False),
        T.StructField("Demand_Forecast", T.DecimalType(10, 2), False),
    ]
)

COLUMNS = [f.name for f in INVENTORY_SCHEMA.fields]
KEY_COLUMNS = ["SKU_ID", "Warehouse_ID", "Supplier_ID", "Region"]
STRING_KEY_MAX_LEN = 20
PAIR = ["SKU_ID", "Warehouse_ID"]
GRAIN = ["Date", "SKU_ID", "Warehouse_ID"]
