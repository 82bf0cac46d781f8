"""Lattice of mergeable grains of the fact table and the grouped measures built on it.

Most reports are means, sums and ratios per SKU x warehouse, SKU, warehouse,
supplier, flag or the whole table.  All of them are functions of *mergeable*
columns (counts, sums, sums of squares, min / max) per group.  The fact table
is aggregated once into a lattice of grains (``GRAINS``), each with only the
columns its reports read, and a grain is rolled up from a finer one where that
is the smaller input.  ``group_metrics`` reads the smallest grain that has the
group's keys and columns: where its keys are the group's, the report is a
projection without any aggregate.  Without stored grains (a plain DataFrame) the same
measures come from one aggregate of the rows by the report's own keys.

Partial aggregation happens map-side, so a hot key (one SKU with a third of
all rows) is folded to one row per task before the shuffle.

Distinct counts of one key per other key are counts of rows of the grain that
has both, taken when the lattice is stored (columns ``d_<key>``), so reports
neither expand nor shuffle distinct values.

Exactness: integer sums stay integral (BIGINT / DECIMAL(38,0)), money and
other DECIMAL sums stay decimal, and each mean is SUM / COUNT of the column's
non-NULL values, which is what AVG computes.  A mean of DECIMAL values is the
exact decimal sum cast to double over the count; the population standard
deviation comes from exact integer moments.  Only the mean of the per-row
cover ratio is a sum of doubles.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import distinct_count, ratio
from shelfwise.operators.quality_rules import row_predicates
from shelfwise.params import DEFAULT, Params
from shelfwise.schema import PAIR

DIMENSIONS = ("Date", "SKU_ID", "Warehouse_ID", "Supplier_ID", "Region")
_DEC0 = "decimal(38,0)"


def _row_measures(params: Params) -> dict[str, Column]:
    """Row-level expressions whose sum (s_) and non-NULL count (c_) grains keep."""
    units, inv, rop, oq, cost, forecast = (
        F.col("Units_Sold"),
        F.col("Inventory_Level"),
        F.col("Reorder_Point"),
        F.col("Order_Quantity"),
        F.col("Unit_Cost"),
        F.col("Demand_Forecast"),
    )
    over = inv > rop * F.lit(params.overstock_rop_multiple)
    return {
        "units": units,
        "inv": inv,
        "rop": rop,
        "lead": F.col("Supplier_Lead_Time_Days"),
        "stockout": F.col("Stockout_Flag"),
        "promo": F.col("Promotion_Flag"),
        "order": oq,
        "order_nz": F.nullif(oq, F.lit(0)),
        "order_pos": (oq > 0).cast("int"),
        "buffer": inv - rop,
        "row_cover": ratio(inv, units),
        "cost": cost,
        "forecast": forecast,
        "abs_err": F.abs(units - forecast),
        "bias": units - forecast,
        "value": cost * inv,  # of one daily snapshot, exact decimal
        "margin": F.col("Unit_Price") - cost,
        "gap_value": F.when(inv < rop, (rop - inv) * cost).otherwise(F.lit(0)),
        "excess_value": F.when(over, (inv - rop) * cost).otherwise(F.lit(0)),
    }


def row_aggs(columns: Iterable[str], params: Params = DEFAULT) -> list[Column]:
    """Aggregates over fact rows that give the named grain columns."""
    rows = _row_measures(params)
    checks = dict(row_predicates())
    square = lambda c: F.sum(F.col(c).cast(_DEC0) * F.col(c).cast(_DEC0))
    single = {
        "n": lambda: F.count(F.lit(1)),
        "q_units": lambda: square("Units_Sold"),
        "q_lead": lambda: square("Supplier_Lead_Time_Days"),
        "min_lead": lambda: F.min("Supplier_Lead_Time_Days"),
        "max_lead": lambda: F.max("Supplier_Lead_Time_Days"),
        "min_date": lambda: F.min("Date"),
        "max_date": lambda: F.max("Date"),
    }
    out = []
    for name in columns:
        if name in single:
            agg = single[name]()
        elif name in checks:  # rows that meet a check (a NULL predicate does not count)
            agg = F.sum(F.expr(checks[name]).cast("bigint"))
        else:
            agg = (F.sum if name[0] == "s" else F.count)(rows[name[2:]])
        out.append(agg.alias(name))
    return out


def merge_aggs(columns: Iterable[str]) -> list[Column]:
    """Aggregates over rows of a finer grain that give the same columns."""
    kinds = {"min": F.min, "max": F.max}
    return [kinds.get(name.split("_")[0], F.sum)(name).alias(name) for name in columns]


def _sums(*names: str) -> tuple[str, ...]:
    return tuple(f"{kind}_{name}" for name in names for kind in "sc")


@dataclass(frozen=True)
class Grain:
    """One row per ``keys``: mergeable ``columns``, counts of ``distinct`` other keys, and the grain it is rolled up from."""

    name: str
    keys: tuple[str, ...]
    columns: tuple[str, ...]
    distinct: tuple[str, ...] = ()
    finer: str | None = None


_PAIR_COLUMNS = ("n", "q_units") + _sums(
    "units", "inv", "rop", "lead", "stockout", "promo", "order", "order_pos", "buffer", "row_cover",
    "cost", "forecast", "abs_err", "value", "margin", "gap_value", "excess_value",
)
_CHECKS = tuple(name for name, _ in row_predicates())
_GRAINS = [
    Grain(
        "total", (),
        _PAIR_COLUMNS + _sums("order_nz", "bias") + ("q_lead", "min_lead", "max_lead", "min_date", "max_date") + _CHECKS,
        DIMENSIONS,
    ),
    Grain("flags", ("Promotion_Flag", "Stockout_Flag"), ("n",) + _sums("units", "forecast", "bias", "inv", "abs_err", "buffer")),
    Grain("region", ("Region",), ("n",)),
    Grain("dates", ("Date",), ("n",)),
    Grain(
        "warehouse", ("Warehouse_ID",),
        ("n",) + _sums("units", "inv", "rop", "order", "value", "lead", "stockout", "row_cover"),
        ("SKU_ID", "Supplier_ID"), "pair",
    ),
    Grain(
        "supplier", ("Supplier_ID",),
        ("n", "q_lead", "min_lead", "max_lead") + _sums("lead", "order_nz", "order_pos", "cost", "units", "order"),
        ("SKU_ID", "Warehouse_ID"),
    ),
    Grain("sku", ("SKU_ID",), ("n", "q_units") + _sums("units", "inv", "value", "margin"), ("Warehouse_ID",), "pair"),
    Grain("pair", tuple(PAIR), _PAIR_COLUMNS),
    Grain("supplier_pair", ("Supplier_ID", *PAIR), ("n",) + _sums("units", "inv", "lead")),
]
#: The lattice, in the order in which ``group_metrics`` looks for a grain: those of fewest rows first.
GRAINS: dict[str, Grain] = {g.name: g for g in _GRAINS}
#: The grain of each single key, whose rows are the key's distinct values.
KEY_GRAINS = {g.keys[0]: g.name for g in _GRAINS if len(g.keys) == 1}


def from_rows(fact: DataFrame, grain: Grain, params: Params = DEFAULT) -> DataFrame:
    """A grain's keys and columns from the fact table's rows (one partial and one final aggregate)."""
    return fact.groupBy(*grain.keys).agg(*row_aggs(grain.columns, params))


def merged(parts: DataFrame, grain: Grain) -> DataFrame:
    """A grain from rows of its own or of a finer grain."""
    return parts.groupBy(*grain.keys).agg(*merge_aggs(grain.columns))


def key_counts(parts: DataFrame, keys: Sequence[str], counted: str, unique: bool = False) -> DataFrame:
    """Distinct non-NULL values of one key per ``keys``, from a table that has both (``unique``: each pair of them once)."""
    pairs = parts.select(*keys, counted)
    return (pairs if unique else pairs.distinct()).groupBy(*keys).agg(F.count(counted).alias(f"d_{counted}"))


class Inventory:
    """The inventory fact table and those grains of it that are stored.

    ``partial`` names the stored grains that may have several rows per key (of
    several batches); they are merged when they are read.  Of all
    ``Params`` only ``overstock_rop_multiple`` enters a grain (row-level excess
    value); a report asked for with another value reads rows for it."""

    def __init__(
        self,
        fact: DataFrame,
        grains: Mapping[str, DataFrame] | None = None,
        params: Params = DEFAULT,
        partial: bool = False,
        marks: Mapping | None = None,
    ):
        self.fact = fact
        self.params = params
        self._grains = {} if grains is None else grains  # a table is read, or made, when it is asked for
        self._partial = partial
        self.marks = marks or {}  # boundary keys and histograms of whole rankings

    def stored(self, name: str) -> bool:
        return name in self._grains

    def table(self, name: str) -> DataFrame:
        """A stored table that is no grain."""
        return self._grains[name]

    def grain(self, name: str, counted: bool = True) -> DataFrame:
        """The grain, one row per key, as stored or from the fact table (``counted``: with its distinct counts)."""
        held = self._grains.get(name if counted or f"parts/{name}" not in self._grains else f"parts/{name}")
        if held is None:
            return from_rows(self.fact, GRAINS[name], self.params)
        return merged(held, GRAINS[name]) if self._partial else held

    def source(self, keys: Sequence[str], columns: set[str], params: Params) -> Grain | None:
        """The smallest stored grain with these keys and columns; None: the rows."""
        if "s_excess_value" in columns and params.overstock_rop_multiple != self.params.overstock_rop_multiple:
            return None
        for g in GRAINS.values():
            if g.name in self._grains and set(keys) <= set(g.keys) and columns <= set(g.columns):
                return g
        return None

    def holds(self, grain: Grain, distinct: Sequence[str], params: Params) -> bool:
        """Whether the stored grain has the exact counts of these other keys."""
        return not distinct or not (self._partial or params.approx_distinct) and set(distinct) <= set(grain.distinct)


def as_inventory(data, params: Params | None = None) -> Inventory:
    return data if isinstance(data, Inventory) else Inventory(data, params=params or DEFAULT)


def _mean(name: str) -> str:
    return f"s_{name} / nullif(c_{name}, 0)"


def _dec_mean(name: str) -> str:
    return f"CAST(s_{name} AS DOUBLE) / nullif(c_{name}, 0)"


def _std(name: str, square: str) -> str:
    n, s = f"CAST(c_{name} AS DECIMAL(38,0))", f"CAST(s_{name} AS DECIMAL(38,0))"
    return f"sqrt(CAST({n} * {square} - {s} * {s} AS DOUBLE)) / nullif(c_{name}, 0)"


# Every named measure as an expression over grain columns (SQL text: one JVM call per measure).
MEASURES: dict[str, str] = {
    # COUNT(*) is 0, not NULL, on an empty input
    "records": "coalesce(n, CAST(0 AS BIGINT))",
    "demand": _mean("units"),
    "inventory": _mean("inv"),
    "reorder_point": _mean("rop"),
    "lead_time": _mean("lead"),
    "stockout_rate": _mean("stockout"),
    "promotion_rate": _mean("promo"),
    "avg_order_all": _mean("order"),
    "avg_order_nonzero": _mean("order_nz"),
    "replenishment_share": _mean("order_pos"),
    "avg_buffer": _mean("buffer"),
    "avg_gap": f"-({_mean('buffer')})",
    "row_cover": _mean("row_cover"),
    "unit_cost": _dec_mean("cost"),
    "forecast": _dec_mean("forecast"),
    "forecast_error": _dec_mean("abs_err"),
    "forecast_bias": _dec_mean("bias"),
    "avg_row_value": _dec_mean("value"),
    "unit_margin": _dec_mean("margin"),
    "gap_value": _dec_mean("gap_value"),
    "excess_value": _dec_mean("excess_value"),
    "inventory_value": "s_value",
    "total_demand": "s_units",
    "total_replenished": "s_order",
    "replenishment_events": "s_order_pos",
    "stockout_days": "s_stockout",
    "min_lead_time": "min_lead",
    "max_lead_time": "max_lead",
    "start_date": "min_date",
    "end_date": "max_date",
    "demand_std": _std("units", "q_units"),
    "lead_time_std": _std("lead", "q_lead"),
    "cover": f"({_mean('inv')}) / nullif({_mean('units')}, 0)",
    "demand_cv": f"({_std('units', 'q_units')}) / nullif({_mean('units')}, 0)",
}
MEASURES.update({name: name for name in _CHECKS})
_COLUMN_NAMES = re.compile(r"\b(?:[scq]_\w+|qc_\w+|min_\w+|max_\w+|n)\b")


def measure_columns(names: Iterable[str]) -> list[str]:
    """The grain columns that the named measures read, each once."""
    return list(dict.fromkeys(c for name in names for c in _COLUMN_NAMES.findall(MEASURES[name])))


def group_metrics(
    data,
    keys: Sequence[str],
    *names: str,
    params: Params = DEFAULT,
    distinct: Sequence[str] = (),
) -> DataFrame:
    """One row per ``keys`` group with the requested named measures.

    ``distinct`` adds distinct counts (``distinct_<col>``) of other dimensions per
    group.  The plan is a projection of the smallest stored grain where its
    keys are the group's, else one aggregate over it or, without one, over the rows.
    """
    inv = as_inventory(data, params)
    columns = measure_columns(names)
    counted = [f"d_{k}" for k in distinct]
    source = inv.source(keys, set(columns), params)
    exact = source is not None and set(source.keys) == set(keys)
    if exact and inv.holds(source, distinct, params):
        grouped = inv.grain(source.name, counted=bool(distinct))
    elif exact and not keys and not params.approx_distinct and all(inv.stored(KEY_GRAINS[k]) for k in distinct):
        # grains of several batches: a key's distinct values are the rows of its own grain
        counts = {f"d_{k}": inv.grain(KEY_GRAINS[k]).agg(F.count(k)).scalar() for k in distinct}
        grouped = inv.grain(source.name).withColumns(counts)
    elif source is None or distinct:
        # distinct counts that no grain holds: from the rows, or the rows of a grain that has all the keys
        wide = inv.source([*keys, *distinct], set(columns), params)
        aggs = row_aggs(columns, params) if wide is None else merge_aggs(columns)
        aggs += [distinct_count(k, params.approx_distinct).alias(f"d_{k}") for k in distinct]
        rows = inv.fact if wide is None else inv.grain(wide.name, counted=False)
        grouped = rows.groupBy(*keys).agg(*aggs)
    else:
        grouped = inv.grain(source.name, counted=False).groupBy(*keys).agg(*merge_aggs(columns))
    measures = [F.expr(MEASURES[n]).alias(n) for n in names]
    return grouped.select(*keys, *measures, *[F.col(d).alias(f"distinct_{k}") for d, k in zip(counted, distinct)])
