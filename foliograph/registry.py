"""Queries on the driver's tables, by name, and the SQL that must give the same rows."""

from .plans import pdf_queries, scalar_queries  # noqa: F401  (they register theirs)
from .plans.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
