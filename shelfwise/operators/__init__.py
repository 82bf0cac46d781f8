"""Report operators: (inventory DataFrame, Params) -> DataFrame."""
