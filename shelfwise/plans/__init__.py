from shelfwise.plans.oracle import oracle_queries
from shelfwise.plans.registry import REPORTS, all_queries, run

__all__ = ["REPORTS", "all_queries", "oracle_queries", "run"]
