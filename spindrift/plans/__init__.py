"""Queries over a data folder, each with the SQL that gives the same rows."""

from . import audits, classes, conform, documents, landing, matching, relational, reporting, result_tables, variability  # noqa: F401  (they register their queries)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
