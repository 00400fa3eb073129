"""Driver queries over the given tables, each next to the SQL that checks it."""

from tidewatch.catalog import analytics, hosts, ingest, news, pages, sites, vectors  # noqa: F401
from tidewatch.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
