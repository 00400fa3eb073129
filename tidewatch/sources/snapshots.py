"""Snapshot tables that stand in for live lookups: host scans and CVE details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import schemas
from tidewatch.functions import documents


def host_scans(snapshot: DataFrame) -> DataFrame:
    """``ip`` and its feature columns from ``(ip, json)``.

    Documents with an error and malformed ones are left out. Each step is a
    projection of its own, so no document is parsed again for every feature.
    """

    def usable(top: Column) -> Column:
        error = F.try_element_at(top, F.lit("error"))
        return top.isNotNull() & (error.isNull() | (error == ""))

    names = schemas.HOST_FEATURES
    top = F.filter(F.array(documents.parsed(F.col("json"))), usable)
    return (
        snapshot.select("ip", F.explode(top).alias("top"))
        .select("ip", documents.merged_document(F.col("top")).alias("doc"))
        .select("ip", *_named(documents.opened(F.col("doc"))))
        .select("ip", *_named(documents.raw_features()))
        .select("ip", *_named(documents.shaped_features(names)))
        .select("ip", *_named(documents.final_features(names)))
    )


def _named(columns: dict[str, Column]) -> list[Column]:
    return [column.alias(name) for name, column in columns.items()]


def cve_details(snapshot: DataFrame) -> DataFrame:
    """The kept fields of ``(cve_id, json)``; a missing ``cpes`` is an empty list.

    A row without a readable document carries ``error`` and nulls.
    """
    doc = F.from_json("json", schemas.CVE_DETAIL)
    fields = [part.strip().split(" ")[0] for part in schemas.CVE_DETAIL.split(", ")]
    kept = []
    for name in fields:
        value = F.col(f"doc.{name}")
        if name == "cve_id":
            value = F.coalesce(value, F.col("asked_id"))
        if name == "cpes":
            value = F.when(F.col("found"), F.coalesce(value, F.array().cast("array<string>")))
        kept.append(value.alias(name))
    return (
        snapshot.select(F.col("cve_id").alias("asked_id"), doc.alias("doc"))
        .withColumn("found", F.col("doc.cve_id").isNotNull())
        .select(*kept, F.when(~F.col("found"), "No response").alias("error"))
    )
