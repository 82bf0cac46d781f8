from shelfwise.functions.numeric import (
    distinct_count,
    flag_sum,
    money,
    ratio,
    round_half_up,
    stddev_pop_exact,
)

__all__ = [
    "distinct_count",
    "flag_sum",
    "money",
    "ratio",
    "round_half_up",
    "stddev_pop_exact",
]
