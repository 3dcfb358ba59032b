"""Query catalogue: importing this package registers every query key."""

from postmetrics.plans import q_accounts, q_aggregates, q_io, q_labels, q_models, q_rows, q_threads  # noqa: F401
from postmetrics.plans.registry import ORACLE, QUERIES  # noqa: F401

__all__ = ["QUERIES", "ORACLE"]
