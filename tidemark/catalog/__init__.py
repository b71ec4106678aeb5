"""Every registered query: a Spark job over the test tables, and its SQL twin where one exists."""

from tidemark.catalog import feeds, ingest, portfolios, returns, studies  # noqa: F401
from tidemark.catalog.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
