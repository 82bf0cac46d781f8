"""Small shared pieces of the report operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import money, ratio, round_half_up
from shelfwise.schema import PAIR


def r2(x) -> Column:
    return round_half_up(x, 2)


def r3(x) -> Column:
    return round_half_up(x, 3)


def pct(x) -> Column:
    """100 * x rounded to 2 decimals."""
    return round_half_up(F.lit(100) * (F.col(x) if isinstance(x, str) else x), 2)


def ordered(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """ORDER BY for a report: range-partitioned whatever its size (AQE merges small ranges)."""
    return df.orderBy(*order)


def first_match(conditions: Sequence[Column], labels: Sequence[str]) -> Column:
    """CASE WHEN c1 THEN l1 WHEN c2 THEN l2 ... ELSE last label END."""
    out = F.when(conditions[0], labels[0])
    for cond, label in zip(conditions[1:], labels[1:]):
        out = out.when(cond, label)
    return out.otherwise(labels[len(conditions)])


def top(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """ORDER BY ... LIMIT k: TakeOrderedAndProject (per-partition top-k, one merge)."""
    return df.orderBy(*order).limit(k)


def pair_tiebreak() -> list[Column]:
    return [F.col(c).asc() for c in PAIR]


__all__ = [
    "first_match",
    "money",
    "ordered",
    "pair_tiebreak",
    "pct",
    "r2",
    "r3",
    "ratio",
    "round_half_up",
    "top",
]
