"""Named queries over the shared test tables, each with the SQL that must give the same rows."""

from postloom.catalog import consolidation, crawling, fetched, keys, streams, tagging  # noqa: F401
from postloom.catalog.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
