from shelfwise.sources.derive import FIXTURE_SQL, derive_inventory
from shelfwise.sources.loader import read_inventory, with_collation
from shelfwise.sources.store import checkpoint_root, inventory_table

__all__ = [
    "FIXTURE_SQL",
    "checkpoint_root",
    "derive_inventory",
    "inventory_table",
    "read_inventory",
    "with_collation",
]
