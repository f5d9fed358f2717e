"""All queries on the engine's own operators, with SQL that gives the same rows."""

from __future__ import annotations

from windloom.plans import condition_queries, distribution_queries, spectral_queries, window_queries  # noqa: F401  register their queries
from windloom.plans.base import ORACLE, QUERIES  # noqa: F401
