"""Named queries over the test tables."""

from tidecase.plans import aggregates, job_queries, join_queries, rows, scalars, scans, windows  # noqa: F401
from tidecase.plans.registry import QUERIES

__all__ = ["QUERIES"]
