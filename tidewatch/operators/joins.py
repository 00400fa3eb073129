"""Lookups and updates by key.

None of these joins is hinted: below the broadcast threshold Spark picks a
broadcast from the measured size, above it a sort-merge join whose hot
partitions adaptive execution splits. The lookup side is reduced to one row per
key first, so a hot key never multiplies rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch import schemas
from tidewatch.operators import dedupe, filters


def resolve_domains(urls: DataFrame, dns: DataFrame) -> DataFrame:
    """First IPv4 answer of each domain; ``ip_status`` says why there is none.

    ``dns`` holds ``domain, seq, answer, failure``.
    """
    first = F.min(
        F.when(
            filters.is_ipv4(F.col("answer")),
            F.struct(F.col("seq"), F.trim("answer").alias("answer")),
        )
    )
    answers = dns.groupBy("domain").agg(
        first["answer"].alias("ip_address"), F.max("failure").alias("failure")
    )
    status = (
        F.when(F.col("domain").isNull() | (F.col("domain") == ""), "INVALID_DOMAIN")
        .when(F.col("ip_address").isNotNull(), "OK")
        .otherwise(F.coalesce("failure", F.lit("NO_IP_FOUND")))
    )
    return (
        urls.join(answers, "domain", "left").withColumn("ip_status", status).drop("failure")
    )


def wanted_addresses(hosts: DataFrame) -> DataFrame:
    """Distinct addresses, as ``ip``, of the hosts that need enrichment."""
    hosts = dedupe.add_missing(hosts, filters.ENRICHED_BY)
    return (
        hosts.filter(filters.needs_enrichment()).select(F.trim("ip_address").alias("ip")).distinct()
    )


def enrich_hosts(hosts: DataFrame, scans: DataFrame) -> DataFrame:
    """Fill the feature columns of hosts never enriched before from ``scans`` (one row per ip).

    Only rows that need it take part in the join; all other rows pass by unshuffled.
    """
    hosts = dedupe.add_missing(hosts, schemas.HOST_FEATURES)
    needs = filters.needs_enrichment()
    found = scans.select(
        F.col("ip").alias("_ip"), *[F.col(c).alias(f"_{c}") for c in schemas.HOST_FEATURES]
    )
    joined = hosts.filter(needs).join(found, F.trim("ip_address") == F.col("_ip"), "left")
    filled = joined.select(
        *[
            F.when(F.col("_ip").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
            if c in schemas.HOST_FEATURES
            else F.col(c)
            for c in hosts.columns
        ]
    )
    return hosts.filter(~F.coalesce(needs, F.lit(False))).unionByName(filled)


def new_cves(pairs: DataFrame, cves: DataFrame) -> DataFrame:
    """CVEs of the hosts that the CVE table lacks, sorted."""
    known = cves.filter(F.col("cve_id").isNotNull()).select("cve_id").distinct()
    return pairs.select("cve_id").distinct().join(known, "cve_id", "left_anti").orderBy("cve_id")


def add_coordinates(hosts: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Coordinates for hosts that lack one, by region and country; full pairs are kept."""
    hosts = hosts if "latitude" in hosts.columns else hosts.withColumns(
        {c: F.lit(None).cast("double") for c in ("latitude", "longitude")}
    )
    keyed = F.col("region_code").isNotNull() & F.col("country_code").isNotNull()
    needs = filters.needs_coordinates()
    places = dedupe.keep_first(
        gazetteer.select(
            "region_code",
            "country_code",
            F.col("latitude").alias("_latitude"),
            F.col("longitude").alias("_longitude"),
        ),
        ["region_code", "country_code"],
        [F.col("_latitude"), F.col("_longitude")],
    )
    located = (
        hosts.filter(needs & keyed)
        .join(places, ["region_code", "country_code"], "left")
        .withColumns({"latitude": F.col("_latitude"), "longitude": F.col("_longitude")})
        .select(*hosts.columns)
    )
    # Half a pair counts as none, as in the lookup that finds nothing.
    nowhere = hosts.filter(needs & ~keyed).withColumns(
        {c: F.lit(None).cast("double") for c in ("latitude", "longitude")}
    )
    return hosts.filter(~needs).unionByName(located).unionByName(nowhere)


def latest_locations(locations: DataFrame) -> DataFrame:
    """Newest usable address per group; the first listed wins a tie."""
    return (
        locations.filter(filters.usable_location())
        .groupBy("name")
        .agg(
            F.max_by("fqdn", F.struct(F.col("updated"), -F.col("ordinal"))).alias("fqdn")
        )
    )


def upsert_seeds(seeds: DataFrame, current: DataFrame) -> DataFrame:
    """Seeds with the current address of each group: ``update``, ``insert`` or ``keep``."""
    old = seeds.select("group", F.col("fqdn").alias("old"))
    new = current.select("group", F.col("fqdn").alias("new"))
    action = (
        F.when(F.col("old").isNull(), "insert")
        .when(F.col("new").isNotNull() & (F.col("new") != F.col("old")), "update")
        .otherwise("keep")
    )
    return old.join(new, "group", "full_outer").select(
        "group", F.coalesce("new", "old").alias("fqdn"), action.alias("action")
    )
