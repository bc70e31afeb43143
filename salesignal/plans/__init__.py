"""All registered queries on the driver's tables."""

from salesignal.plans import authority, feeds, funnel, market, mechanisms, relational, rules, scalars, scan, watch  # noqa: F401
from salesignal.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
