"""List-valued and label columns: decoding, CVE lists, short summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_QUOTED = r"""'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+\""""
_LIST = rf"(?s)^\s*+\[\s*+(?:(?:{_QUOTED}|[-+.\w]++)\s*+(?:,\s*+|(?=\])))*+\]\s*+$"


def decode_list(text: Column) -> Column:
    """Quoted items of a list literal; null or malformed text gives an empty list."""
    items = F.transform(
        F.regexp_extract_all(text, F.lit(_QUOTED), F.lit(0)),
        lambda x: F.regexp_replace(F.substr(x, F.lit(2), F.length(x) - 2), r"\\(.)", "$1"),
    )
    return F.when(text.rlike(_LIST), items).otherwise(F.array().cast("array<string>"))


def only_cves(items: Column) -> Column:
    return F.filter(items, lambda x: x.startswith("CVE-"))


def split_cves(text: Column) -> Column:
    """Comma-separated text to its trimmed CVE names."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x))
    return only_cves(parts)


def combine_cves(vulns: Column, listed: Column) -> Column:
    """Distinct CVE names of both columns, sorted."""
    named = F.transform(only_cves(decode_list(listed)), lambda x: F.trim(x))
    return F.array_sort(F.array_union(split_cves(vulns), named))


def head_summary(items: Column, size: Column | None = None) -> Column:
    """First three items joined, with ``...`` when the list is longer."""
    size = F.size(items) if size is None else size
    return F.concat(
        F.array_join(F.slice(items, 1, 3), ", "), F.when(size > 3, "...").otherwise("")
    )


def region_label(country: Column, region: Column) -> Column:
    """``country - region``; null when either is missing."""
    return F.concat(country, F.lit(" - "), region)


def tooltip(group: Column, domain: Column, cve: Column, ttp: Column) -> Column:
    """Four-line label of a host."""
    filled = [F.coalesce(c.cast("string"), F.lit("nan")) for c in (group, domain, cve, ttp)]
    return F.format_string("Group: %s\nDomain: %s\nCVE: %s\nTTP: %s", *filled)
