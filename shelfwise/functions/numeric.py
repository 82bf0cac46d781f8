"""Column helpers that pin down numeric semantics.

All helpers return built-in Column expressions, so they stay inside
whole-stage code generation.

* ``ratio``: ``a / NULLIF(b, 0)``; a zero denominator gives NULL instead of
  an ANSI division error.
* ``round_half_up``: rounds through ``DECIMAL(28,8)`` so ties (x.xx5) go away
  from zero the same way in every engine; the result is DOUBLE.
* ``money``: exact decimal sums rounded to cents as ``DECIMAL(38,2)``.
* ``flag_sum``: SUM of a boolean as BIGINT (NULL stays NULL, empty input
  gives NULL like SQL SUM).
* ``stddev_pop_exact``: population standard deviation of an integer column
  from exact integer moments, so it does not depend on the order in which
  partial aggregates are merged.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DEC_ROUND = "decimal(28,8)"
_DEC_INT = "decimal(38,0)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(num, den) -> Column:
    return _c(num) / F.nullif(_c(den), F.lit(0))


def round_half_up(x, digits: int = 2) -> Column:
    return F.round(_c(x).cast(_DEC_ROUND), digits).cast("double")


def money(x) -> Column:
    return F.round(_c(x), 2).cast("decimal(38,2)")


def distinct_count(x, approx: bool = False) -> Column:
    """COUNT(DISTINCT x), or its HyperLogLog++ estimate (1 % relative
    standard deviation) when ``approx``."""
    return F.approx_count_distinct(_c(x), rsd=0.01) if approx else F.count_distinct(_c(x))


def flag_sum(cond) -> Column:
    return F.sum(_c(cond).cast("bigint"))


def stddev_pop_exact(x) -> Column:
    """sqrt(n * sum(x^2) - sum(x)^2) / n with the integer part in DECIMAL(38,0)."""
    v = _c(x).cast(_DEC_INT)
    n = F.count(_c(x)).cast(_DEC_INT)
    s1 = F.sum(v)
    s2 = F.sum(v * v)
    return F.sqrt((n * s2 - s1 * s1).cast("double")) / F.count(_c(x))
