"""Queries over the standard tables, and their SQL."""

from __future__ import annotations

from quire.plans import document_queries, text_queries  # noqa: F401  they register themselves
from quire.plans.registry import QUERIES, SQL

FLAGSHIP = "language_report"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
