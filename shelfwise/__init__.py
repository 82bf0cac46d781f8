"""shelfwise: supply-chain inventory analytics as Spark DataFrame operators.

Every operator takes the daily inventory fact table (one row per
Date x SKU x Warehouse) - as a DataFrame or as an ``Inventory`` (fact table
plus stored grains) - and returns a DataFrame; nothing is collected to the
driver.  See README.md for the operator list.
"""

from shelfwise.operators.metrics import GRAINS, Inventory
from shelfwise.params import Params
from shelfwise.schema import INVENTORY_SCHEMA
from shelfwise.sources.loader import read_inventory
from shelfwise.sources.store import inventory_data

__all__ = ["INVENTORY_SCHEMA", "Inventory", "Params", "inventory_data", "read_inventory", "GRAINS"]
