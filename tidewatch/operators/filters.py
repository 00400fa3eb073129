"""Predicates as columns."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions import text

# Columns that show a host was enriched before (fixed values).
ENRICHED_BY = ("asn", "product", "vulns", "ssl_fingerprint")

# Four groups of digits (fixed value).
_IPV4 = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"


def is_ipv4(address: Column) -> Column:
    return F.coalesce(F.trim(address).rlike(_IPV4), F.lit(False))


def is_missing(value: Column) -> Column:
    """Null, blank, or the text ``nan``."""
    return text.is_blank(value) | (F.lower(value) == "nan")


def needs_enrichment(address: str = "ip_address") -> Column:
    """A usable address, and none of the marker columns filled."""
    empty = is_ipv4(F.col(address))
    for name in ENRICHED_BY:
        empty = empty & is_missing(F.col(name))
    return empty


def needs_coordinates() -> Column:
    return F.col("latitude").isNull() | F.col("longitude").isNull()


def on_day(day: Column, as_of: date | str) -> Column:
    return F.coalesce(day == F.lit(str(as_of)).cast("date"), F.lit(False))


def usable_location() -> Column:
    return F.col("fqdn").endswith(".onion") & F.col("enabled")
