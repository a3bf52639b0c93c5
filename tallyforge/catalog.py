"""All queries of the library by name, with the SQL that DuckDB runs for the same rows."""

from __future__ import annotations

from .plans import admission, details, durable, forecasting, histories, ingestion, journals, models, parsers, participation, rates, relational, scoring, statements, texts  # noqa: F401  registers their queries
from .plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "strict_prior_scorecard"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
