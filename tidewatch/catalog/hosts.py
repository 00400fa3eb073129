"""Host and CVE tables: merging, enrichment, lists, refresh, coordinates."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewatch.catalog import standins as S
from tidewatch.catalog.registry import query, table
from tidewatch.functions import lists
from tidewatch.operators import aggregates, dedupe, joins, match
from tidewatch.plans import jobs
from tidewatch.session import delete_at_exit, shared_dir, written
from tidewatch.sources import snapshots, tables


def _url_table(spark: SparkSession, sf_dir: str, part: int, extra: str | None = None) -> DataFrame:
    """Orders play crawled URL rows: the key is the customer and every third order is one table."""
    key = F.col("o_orderkey")
    url = F.when(key % 97 != 0, F.concat(F.lit("http://h"), F.col("o_custkey").cast("string")))
    rows = (
        table(spark, sf_dir, "orders")
        .filter(key % 3 == part)
        .select(
            url.alias("url"),
            F.col("o_orderpriority").alias("group"),
            key.alias("row_id"),
            F.lit("f").alias("file"),
            key.alias("ordinal"),
        )
    )
    return rows.withColumn(extra, F.col("row_id") % 10) if extra else rows


URL_SQL = """
WITH urls AS (
  SELECT CASE WHEN o_orderkey % 97 <> 0 THEN 'http://h' || o_custkey END AS url,
         o_orderpriority AS "group", o_orderkey AS row_id, o_orderkey % 3 AS part FROM orders
)
"""


@query(
    URL_SQL
    + """
, merged AS (
  SELECT url, "group", row_id, CASE WHEN noted THEN row_id % 10 END AS note,
         row_number() OVER (PARTITION BY url ORDER BY part, row_id) AS r
  FROM (SELECT url, "group", row_id, least(part, 1) AS part, part = 1 AS noted FROM urls)
)
SELECT COALESCE(url, 'none') AS url, "group", row_id, COALESCE(CAST(note AS VARCHAR), 'none') AS note
FROM merged WHERE r = 1
"""
)
def merge_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _url_table(spark, sf_dir, 0)
    new = _url_table(spark, sf_dir, 1, extra="note")
    merged = jobs.merge_hosts(base, new, _url_table(spark, sf_dir, 2))
    return merged.select(
        F.coalesce("url", F.lit("none")).alias("url"),
        "group",
        "row_id",
        F.coalesce(F.col("note").cast("string"), F.lit("none")).alias("note"),
    )


@query(
    URL_SQL
    + """
, merged AS (
  SELECT url, "group", row_id, row_number() OVER (PARTITION BY url ORDER BY part, row_id) AS r FROM urls
)
SELECT COALESCE(url, 'none') AS url, "group", row_id FROM merged WHERE r = 1
"""
)
def keyed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bucketed table that two runs add to; each run is repeated, which adds nothing."""
    name = f"hosts_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    base = dedupe.merge_keep_first(_url_table(spark, sf_dir, 0), [])
    tables.create_keyed(base, name, path, buckets=8)
    delete_at_exit(spark, path)
    for part in (1, 1, 2, 2):
        tables.merge_keyed(spark, name, path, _url_table(spark, sf_dir, part), buckets=8)
    return tables.read_keyed(spark, name).withColumn("url", F.coalesce("url", F.lit("none")))


@query(
    URL_SQL
    + """
, n AS (
  SELECT count(DISTINCT COALESCE(url, '')) FILTER (WHERE part = 0) AS base_rows,
         count(DISTINCT COALESCE(url, '')) AS merged_rows
  FROM urls
)
SELECT CAST(base_rows AS BIGINT) AS base_rows, CAST(merged_rows AS BIGINT) AS merged_rows,
       CAST(greatest(0, merged_rows - base_rows) AS BIGINT) AS added_rows FROM n
"""
)
def merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted while the merged table is written."""
    new = [_url_table(spark, sf_dir, 1), _url_table(spark, sf_dir, 2)]
    merged, counted = dedupe.observed_merge(_url_table(spark, sf_dir, 0), new)
    written(merged)
    return _counters(spark, counted)


def _counters(spark: SparkSession, *counted: Observation) -> DataFrame:
    numbers = {name: n for c in counted for name, n in c.get.items()}
    return spark.createDataFrame([tuple(numbers.values())], ", ".join(f"{n} long" for n in numbers))


@query(
    URL_SQL
    + """
, fresh AS (
  SELECT url FROM urls u
  WHERE part = 2 AND NOT EXISTS (SELECT 1 FROM urls t WHERE t.part = 1 AND t.url IS NOT DISTINCT FROM u.url)
), joined AS (SELECT url FROM urls WHERE part = 0 UNION ALL SELECT url FROM fresh)
SELECT (SELECT count(*) FROM fresh) AS left_rows, count(*) AS merged_rows,
       count(DISTINCT COALESCE(url, '')) AS final_rows FROM joined
"""
)
def holdout_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = _url_table(spark, sf_dir, 2).withColumnRenamed("url", "extracted_url")
    kept, before, after = dedupe.observed_holdout(new, _url_table(spark, sf_dir, 1), _url_table(spark, sf_dir, 0))
    written(kept)
    return _counters(spark, before, after)


@query(
    URL_SQL
    + """
, train AS (SELECT url FROM urls WHERE part = 1),
fresh AS (
  SELECT url, "group", row_id FROM urls u
  WHERE part = 2 AND NOT EXISTS (SELECT 1 FROM train t WHERE t.url IS NOT DISTINCT FROM u.url)
), joined AS (
  SELECT url, "group", row_id, 0 AS src FROM urls WHERE part = 0
  UNION ALL SELECT url, "group", row_id, 1 FROM fresh
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY src, row_id) AS r FROM joined
)
SELECT COALESCE(url, 'none') AS url, "group", row_id FROM ranked WHERE r = 1
"""
)
def holdout_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = _url_table(spark, sf_dir, 2).withColumnRenamed("url", "extracted_url")
    refreshed = jobs.refresh_holdout(
        new, _url_table(spark, sf_dir, 1), _url_table(spark, sf_dir, 0)
    )
    return refreshed.withColumn("url", F.coalesce("url", F.lit("none")))


def _known_cves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CVE table before the refresh: three parts of four."""
    part = table(spark, sf_dir, "part")
    return part.filter(F.col("p_partkey") % 4 != 0).select(
        F.col("p_partkey").cast("string").alias("cve_id"), F.col("p_name").alias("summary")
    )


def _text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pairs(spark, sf_dir).select("host_id", F.col("cve_id").cast("string").alias("cve_id"))


@query(
    """
SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS cve_id FROM lineitem
WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 4 <> 0)
"""
)
def new_cves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.new_cves(_text_pairs(spark, sf_dir), _known_cves(spark, sf_dir))


@query(
    """
SELECT CAST(p_partkey AS VARCHAR) AS cve_id, p_name AS summary,
       CASE WHEN p_partkey % 4 = 0 THEN p_retailprice ELSE -1 END AS cvss,
       CASE WHEN p_partkey % 4 <> 0 THEN 'none' WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand || ';' || p_type END AS cpes,
       CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size > 25 AS VARCHAR) ELSE 'none' END AS kev
FROM part
WHERE p_partkey % 4 <> 0
   OR (p_partkey % 8 = 0 AND p_partkey IN (SELECT l_partkey FROM lineitem))
"""
)
def cve_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the missing CVEs have a detail document; a third of those lack ``cpes``."""
    part = table(spark, sf_dir, "part")
    document = F.to_json(
        F.struct(
            F.col("p_partkey").cast("string").alias("cve_id"),
            F.col("p_name").alias("summary"),
            F.col("p_retailprice").alias("cvss"),
            (F.col("p_size") > 25).alias("kev"),
            F.when(F.col("p_partkey") % 3 != 0, F.array("p_brand", "p_type")).alias("cpes"),
        )
    )
    details = part.select(
        F.col("p_partkey").cast("string").alias("cve_id"),
        F.when(F.col("p_partkey") % 8 == 0, document).alias("json"),
    )
    refreshed = jobs.refresh_cve_table(
        _text_pairs(spark, sf_dir), _known_cves(spark, sf_dir), details
    )
    return refreshed.select(
        "cve_id",
        "summary",
        F.coalesce("cvss", F.lit(-1.0)).alias("cvss"),
        F.when(F.col("cpes").isNull(), "none").otherwise(F.array_join("cpes", ";")).alias("cpes"),
        F.coalesce(F.col("kev").cast("string"), F.lit("none")).alias("kev"),
    )


def _cve_columns() -> tuple[Column, Column]:
    """A comma text and a list literal per event; some are malformed, empty or null."""
    user = F.col("user_id").cast("string")
    kind = F.col("event_type")
    number = F.col("event_id").cast("string")
    vulns = F.when(
        F.col("event_id") % 5 != 0,
        F.concat(F.lit(" CVE-A-"), user, F.lit(" , cve-x, CVE-B-"), kind, F.lit(",")),
    )
    listed = (
        F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("['CVE-C-"), number, F.lit("', 12")))
        .when(F.col("event_id") % 7 == 1, F.lit("[]"))
        .when(F.col("event_id") % 7 == 2, F.lit(None).cast("string"))
        .otherwise(
            F.concat(
                F.lit("['CVE-B-"), kind, F.lit("', \"CVE-D-"), number, F.lit(" \", 'x', None, 3]")
            )
        )
    )
    return vulns, listed


CVE_LISTS = """
WITH raw AS (
  SELECT event_id,
    CASE WHEN event_id % 5 <> 0 THEN ['CVE-A-' || user_id, 'CVE-B-' || event_type] ELSE [] END AS a,
    CASE WHEN event_id % 7 IN (0, 1, 2) THEN [] ELSE ['CVE-B-' || event_type, 'CVE-D-' || event_id] END AS b
  FROM events
)
"""


@query(
    CVE_LISTS
    + """
SELECT event_id, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS cve_list,
  COALESCE((list_sort(list_distinct(list_concat(a, b)))[1:3]).array_to_string(', '), '')
    || CASE WHEN len(list_distinct(list_concat(a, b))) > 3 THEN '...' ELSE '' END AS cve_summary
FROM raw
"""
)
def cve_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    vulns, listed = _cve_columns()
    derived = jobs.derive_cves(
        table(spark, sf_dir, "events").select(
            "event_id", vulns.alias("vulns"), listed.alias("shodan_vulns")
        )
    )
    return derived.select(
        "event_id",
        F.array_join("cve_list", ",").alias("cve_list"),
        lists.head_summary(F.col("cve_list")).alias("cve_summary"),
    )


@query(
    CVE_LISTS
    + "SELECT DISTINCT unnest(list_concat(a, b)) AS cve_id FROM raw"
)
def listed_cves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct CVEs over the in-row lists."""
    vulns, listed = _cve_columns()
    derived = jobs.derive_cves(
        table(spark, sf_dir, "events").select(
            F.col("event_id").alias("host_id"), vulns.alias("vulns"), listed.alias("shodan_vulns")
        )
    )
    return aggregates.distinct_cves(aggregates.explode_cves(derived))


def _scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan document per event, nested as a host scan is.

    Later ``data`` items replace earlier ones key by key, a whole ``http`` object
    included; some documents carry an error or are cut off.
    """
    number = F.col("event_id").cast("string")
    user = F.col("user_id").cast("string")
    quoted = [
        '{"data":[{"product":"old","http":{"server":"first","components":{"x":{}}},"version":"1"},',
        '{"product":"', F.col("event_type"), '","http":{"components":{"', F.col("event_type"),
        '":{},"php":{"v":[1]}}},"ssh":{"key":"k', number, '","kex":{"kex_algorithms":["a","b"],',
        '"mac_algorithms":["m', number, '"]},"cipher":"c', user, '"},"cpe":["cpe:/a:', F.col("event_type"),
        '"],"cpe23":["x:', user, '","y"],"version":null}],"asn":"AS', user, '","hostnames":["h', number,
        '","w"],"tags":[],"domains":["d', number, '","e"],"org":"O', user, '","isp":"",',
        '"vulns":{"CVE-', user, '":{"cvss":1},"CVE-X":{}},"location":{"country_code":"C',
        F.col("event_type"), '"},"region_code":"R', user,
        '","ssl":{"ja3s":"j', number, '","jarm":"r', user, '","cert":{"fingerprint":{"sha256":"f', number,
        '"},"issuer":{"CN":"i"},"subject":{"CN":"', number, '"}}}}',
    ]
    full = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in quoted])
    json = (
        F.when(F.col("event_id") % 11 == 0, F.lit('{"error":"No information"}'))
        .when(F.col("event_id") % 11 == 1, F.substring(full, 1, 40))
        .otherwise(full)
    )
    return table(spark, sf_dir, "events").select(number.alias("ip"), json.alias("json"))


@query(
    """
SELECT CAST(event_id AS VARCHAR) AS ip, event_type AS product, 'none' AS version,
  event_type || ', php' AS components, 'k' || event_id AS ssh_key, 'a, b' AS ssh_kex,
  'f' || event_id AS ssl_fingerprint, 'h' || event_id || ', w' AS hostnames,
  'CVE-' || user_id || ', CVE-X' AS vulns, 'none' AS tags, 'none' AS server, 'AS' || user_id AS asn,
  'C' || event_type AS country_code, 'R' || user_id AS region_code, '{"CN":"i"}' AS ssl_issuer,
  'cpe:/a:' || event_type AS cpe, 'x:' || user_id || ', y' AS cpe23, 'm' || event_id AS ssh_mac,
  'c' || user_id AS ssh_cipher, 'j' || event_id AS ssl_ja3s, 'r' || user_id AS ssl_jarm,
  'd' || event_id || ', e' AS domains, 'O' || user_id AS org, 'none' AS isp,
  '{"CN":"' || event_id || '"}' AS ssl_subject
FROM events WHERE event_id % 11 NOT IN (0, 1)
"""
)
def host_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = snapshots.host_scans(_scan_documents(spark, sf_dir))
    return scans.select("ip", *[F.coalesce(c, F.lit("none")).alias(c) for c in scans.columns if c != "ip"])


def _address(key: Column) -> Column:
    octets = [F.lit("10"), F.floor(key / 62500) % 250, F.floor(key / 250) % 250, key % 250]
    return F.concat_ws(".", *[o.cast("string") for o in octets])


@query(
    """
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'NO_IP_FOUND' ELSE
    '10.' || (c_custkey // 62500) % 250 || '.' || (c_custkey // 250) % 250 || '.' || c_custkey % 250
  END AS ip_address,
  CASE WHEN c_custkey % 3 = 0 THEN 'kept' WHEN c_custkey % 5 <> 0 AND s_suppkey IS NOT NULL
       THEN s_name WHEN c_custkey % 3 = 1 THEN 'nan' ELSE 'none' END AS product,
  CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AND s_suppkey IS NOT NULL
       THEN 'AS' || s_nationkey ELSE 'none' END AS asn
FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey
"""
)
def enriched_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers play host rows: a third was enriched before, a fifth has no address."""
    key = F.col("c_custkey")
    hosts = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(key % 5 == 0, "NO_IP_FOUND").otherwise(_address(key)).alias("ip_address"),
        F.when(key % 3 == 0, "kept").when(key % 3 == 1, "nan").alias("product"),
    )
    scans = table(spark, sf_dir, "supplier").select(
        _address(F.col("s_suppkey")).alias("ip"),
        F.to_json(
            F.struct(
                F.col("s_name").alias("product"),
                F.concat(F.lit("AS"), F.col("s_nationkey").cast("string")).alias("asn"),
            )
        ).alias("json"),
    )
    enriched = jobs.enrich_hosts(hosts, scans)
    return enriched.select(
        "c_custkey",
        "ip_address",
        *[F.coalesce(c, F.lit("none")).alias(c) for c in ("product", "asn")],
    )


@query(
    """
SELECT c_custkey, round(CASE WHEN c_custkey % 4 = 0 THEN 1.5
    WHEN c_custkey % 7 = 0 THEN -999 ELSE n_nationkey * 3.0 - 36.0 END, 6) AS latitude,
  round(CASE WHEN c_custkey % 4 = 0 THEN 2.5
    WHEN c_custkey % 7 = 0 THEN -999 ELSE n_nationkey * 7.0 - 80.0 END, 6) AS longitude
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""
)
def added_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the hosts has coordinates; one in seven has no region."""
    key = F.col("c_custkey")
    place = S.gazetteer(spark, sf_dir)
    names = place.select("region_code", "country_code", "n_nationkey")
    hosts = (
        table(spark, sf_dir, "customer")
        .join(names, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "c_custkey",
            F.when(key % 7 != 0, F.col("region_code")).alias("region_code"),
            "country_code",
            F.when(key % 4 == 0, 1.5).alias("latitude"),
            F.when(key % 4 == 0, 2.5).when(key % 4 == 1, 9.0).alias("longitude"),
        )
    )
    located = jobs.add_coordinates(hosts, place.drop("n_nationkey"))
    return located.select(
        "c_custkey",
        *[F.round(F.coalesce(c, F.lit(-999.0)), 6).alias(c) for c in ("latitude", "longitude")],
    )


@query(
    """
SELECT p_partkey AS cve_id, p_brand AS technique_id, round(p_retailprice / 1000, 6) AS similarity
FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0
"""
)
def flattened_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored matches as flat columns; rows without a match, a similarity or a score are of no use."""
    key = F.col("p_partkey")
    found = F.struct(
        F.col("p_brand").alias("id"),
        F.col("p_type").alias("name"),
        F.when(key % 7 != 0, F.col("p_retailprice") / 1000).alias("score"),
    )
    cves = table(spark, sf_dir, "part").select(
        key.alias("cve_id"),
        F.when(key % 11 != 0, F.col("p_retailprice")).alias("cvss"),
        F.when(key % 5 != 0, found).alias("mitre_match"),
    )
    usable = aggregates.usable_cves(match.flatten_match(cves))
    return usable.select("cve_id", "technique_id", F.round("similarity", 6).alias("similarity"))
