"""Threat tables played by the given tables, as DataFrames and as SQL.

Hosts are suppliers, a host's CVEs are the distinct parts it shipped, the CVE
table is ``part`` and a technique is a brand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.catalog.registry import table

GROUP = "NATION_3"


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A position for each nation, computed from its key."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    key = F.col("n_nationkey")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("region_code"),
        F.col("r_name").alias("country_code"),
        (key * 3.0 - 36.0).alias("latitude"),
        (key * 7.0 - 80.0).alias("longitude"),
        "n_nationkey",
    )


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth host lacks coordinates."""
    supplier = table(spark, sf_dir, "supplier")
    place = gazetteer(spark, sf_dir)
    known = F.col("s_suppkey") % 10 != 7
    return supplier.join(place, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("host_id"),
        F.col("region_code").alias("group"),
        F.col("s_name").alias("domain"),
        "country_code",
        "region_code",
        F.when(known, F.col("latitude")).alias("latitude"),
        F.when(known, F.col("longitude")).alias("longitude"),
    )


def placed_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts(spark, sf_dir).dropna(subset=["latitude", "longitude"])


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .select(F.col("l_suppkey").alias("host_id"), F.col("l_partkey").alias("cve_id"))
        .distinct()
    )


def cves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("cve_id"),
        F.col("p_retailprice").alias("cvss"),
        F.col("p_brand").alias("technique_id"),
    )


def techniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "part")
        .groupBy(F.col("p_brand").alias("technique_id"))
        .agg(F.min("p_type").alias("technique_name"), F.min("p_name").alias("description"))
    )


SQL = """
WITH gazetteer AS (
  SELECT n_name AS region_code, r_name AS country_code, n_nationkey * 3.0::DOUBLE - 36.0 AS latitude,
         n_nationkey * 7.0::DOUBLE - 80.0 AS longitude, n_nationkey
  FROM nation JOIN region ON n_regionkey = r_regionkey
), hosts AS (
  SELECT s_suppkey AS host_id, region_code AS "group", s_name AS domain, country_code, region_code,
         CASE WHEN s_suppkey % 10 <> 7 THEN latitude END AS latitude,
         CASE WHEN s_suppkey % 10 <> 7 THEN longitude END AS longitude
  FROM supplier JOIN gazetteer ON s_nationkey = n_nationkey
), placed AS (
  SELECT * FROM hosts WHERE latitude IS NOT NULL AND longitude IS NOT NULL
), pairs AS (
  SELECT DISTINCT l_suppkey AS host_id, l_partkey AS cve_id FROM lineitem
), cves AS (
  SELECT p_partkey AS cve_id, p_retailprice AS cvss, p_brand AS technique_id FROM part
), techniques AS (
  SELECT p_brand AS technique_id, min(p_type) AS technique_name, min(p_name) AS description
  FROM part GROUP BY p_brand
), counts AS (
  SELECT "group", technique_id, CAST(count(*) AS BIGINT) AS "count"
  FROM placed JOIN pairs USING (host_id) JOIN cves USING (cve_id)
  GROUP BY "group", technique_id
)
"""
