"""Thresholds and limits used by the classification rules.

Fixed values: these numbers must equal the ones the reported analysis uses,
so that classes and top-k lists agree with it.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # --- fixed values (classification thresholds) ---
    abc_a_share: float = 0.80            # running value share for class A
    abc_b_share: float = 0.95            # running value share for class B
    cv_high: float = 0.47                # coefficient of variation: high volatility
    cv_medium: float = 0.44              # coefficient of variation: medium volatility
    repl_low: float = 0.90               # ordered / sold below this: under-replenished
    repl_high: float = 1.05              # ordered / sold above this: over-replenished
    lead_high_days: float = 10           # supplier lead time: high risk
    lead_medium_days: float = 6          # supplier lead time: medium risk
    buffer_tight: float = 1.25           # inventory <= 1.25 x reorder point: tight buffer
    buffer_healthy: float = 1.50         # inventory <= 1.50 x reorder point: healthy buffer
    overstock_rop_multiple: float = 1.5  # inventory > 1.5 x reorder point: excess
    high_cover_lead_multiple: float = 2  # cover > 2 x lead time: high cover / overstock
    supply_monitor_multiple: float = 1.5 # cover < 1.5 x lead time: supply risk
    service_stockout_rate: float = 0.01  # warehouse stockout rate above 1 %
    warehouse_cover_days: float = 25     # warehouse cover above 25 days
    cover_quantiles: int = 4             # NTILE(4) of days of cover
    # --- fixed values (report lengths) ---
    sku_profile_top: int = 15
    pair_profile_top: int = 20
    forecast_accuracy_top: int = 20
    attention_top: int = 20
    priority_list_top: int = 30
    decision_profile_top: int = 20
    quartile_priority_top: int = 30
    # --- execution knobs ---
    # Distinct counts are exact by default; True switches them to
    # approx_count_distinct (HyperLogLog++, 1 % relative standard deviation;
    # no shuffle of the distinct values themselves).
    approx_distinct: bool = False
    # Global (un-partitioned) windows: "distributed" uses range partitioning
    # plus per-partition offsets, whatever the input size; "builtin" uses
    # Spark's single-partition Window (a comparator for tests).
    global_window: str = "distributed"
    # Range partitions for the distributed path; None = session's
    # spark.sql.shuffle.partitions.
    window_partitions: int | None = None


DEFAULT = Params()
