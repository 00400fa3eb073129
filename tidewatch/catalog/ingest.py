"""Seeds, page walks, listings and retention."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.catalog.registry import query, table
from tidewatch.operators import aggregates, crawl, dedupe, filters, joins
from tidewatch.plans import jobs
from tidewatch.session import delete_at_exit, shared_dir
from tidewatch.sources import sinks, tables

AS_OF = "1998-03-01"


def _locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One location per order of a customer; one in five is no onion address."""
    key = F.col("o_orderkey")
    ending = F.when(key % 5 == 0, ".com").otherwise(".onion")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("name"),
        key.alias("ordinal"),
        F.concat(key.cast("string"), ending).alias("fqdn"),
        (F.col("o_orderstatus") != "P").alias("enabled"),
        F.col("o_orderdate").alias("updated"),
    )


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even customers with their oldest order."""
    return (
        table(spark, sf_dir, "orders")
        .filter(F.col("o_custkey") % 2 == 0)
        .groupBy(F.col("o_custkey").cast("string").alias("group"))
        .agg(F.concat(F.min("o_orderkey").cast("string"), F.lit(".onion")).alias("fqdn"))
    )


SEED_SQL = """
WITH locations AS (
  SELECT CAST(o_custkey AS VARCHAR) AS name, o_orderkey AS ordinal,
    o_orderkey || CASE WHEN o_orderkey % 5 = 0 THEN '.com' ELSE '.onion' END AS fqdn,
    o_orderstatus <> 'P' AS enabled, o_orderdate AS updated
  FROM orders
), newest AS (
  SELECT name, fqdn FROM locations WHERE fqdn LIKE '%.onion' AND enabled
  QUALIFY row_number() OVER (PARTITION BY name ORDER BY updated DESC, ordinal) = 1
), seeds AS (
  SELECT CAST(o_custkey AS VARCHAR) AS "group", min(o_orderkey) || '.onion' AS fqdn
  FROM orders WHERE o_custkey % 2 = 0 GROUP BY o_custkey
)
"""


@query(SEED_SQL + "SELECT name, fqdn FROM newest")
def latest_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.latest_locations(_locations(spark, sf_dir))


@query(
    SEED_SQL
    + """
SELECT COALESCE(s."group", n.name) AS "group", COALESCE(n.fqdn, s.fqdn) AS fqdn,
  CASE WHEN s.fqdn IS NULL THEN 'insert' WHEN n.fqdn <> s.fqdn THEN 'update' ELSE 'keep' END AS action
FROM seeds s FULL JOIN newest n ON s."group" = n.name
"""
)
def seed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = joins.latest_locations(_locations(spark, sf_dir)).withColumnRenamed("name", "group")
    return joins.upsert_seeds(_seeds(spark, sf_dir), newest)


@query(
    SEED_SQL
    + f"""
, today AS (
  SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS name FROM orders
  WHERE CAST(o_orderdate AS DATE) = DATE '{AS_OF}'
), current AS (SELECT name, fqdn FROM newest JOIN today USING (name))
SELECT COALESCE(s."group", n.name) AS "group", COALESCE(n.fqdn, s.fqdn) AS fqdn,
  CASE WHEN s.fqdn IS NULL THEN 'insert' WHEN n.fqdn <> s.fqdn THEN 'update' ELSE 'keep' END AS action
FROM seeds s FULL JOIN current n ON s."group" = n.name
"""
)
def seed_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one day play the leak posts of today; each order is a one-location feed entry."""
    orders = table(spark, sf_dir, "orders")
    posts = orders.select(
        F.to_date("o_orderdate").alias("date"), F.col("o_custkey").cast("string").alias("group")
    )
    place = F.struct("fqdn", "enabled", "updated")
    feed = _locations(spark, sf_dir).select("name", F.array(place).alias("locations"))
    return jobs.refresh_seeds(posts, feed, _seeds(spark, sf_dir), AS_OF)


@query(
    """
WITH named AS (
  SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'kairos' WHEN 'BUILDING' THEN 'play'
    WHEN 'MACHINERY' THEN 'unknown_group' ELSE 'gr_' || lower(c_mktsegment) END AS "group",
    CASE WHEN c_custkey % 9 <> 0 THEN c_name END AS fqdn
  FROM customer
)
SELECT "group", fqdn, CAST(page AS BIGINT) AS page,
  'http://' || fqdn || CASE WHEN page = 1 THEN '/' WHEN "group" = 'kairos' THEN '/?PAGEN_1=' || page
    WHEN "group" = 'play' THEN '/index.php?page=' || page ELSE '/?page=' || page END AS url,
  "group" || '_19980301_page' || page || '.html' AS file_name
FROM named, range(1, 6) AS p(page) WHERE fqdn IS NOT NULL
"""
)
def seed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    group = (
        F.when(segment == "AUTOMOBILE", " Kairos ")
        .when(segment == "BUILDING", "PLAY")
        .when(segment == "MACHINERY", "  ")
        .otherwise(F.concat(F.lit("GR "), segment))
    )
    seeds = table(spark, sf_dir, "customer").select(
        group.alias("group"), F.when(F.col("c_custkey") % 9 != 0, F.col("c_name")).alias("fqdn")
    )
    pages = crawl.seed_pages(seeds, AS_OF)
    return pages.withColumn("page", F.col("page").cast("long"))


def _fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("fqdn"),
        (F.col("turn") + 1).alias("page"),
        (F.length("text") % 4 != 0).alias("ok"),
    )


WALK_SQL = """
WITH log AS (
  SELECT conv_id AS fqdn, turn + 1 AS page, length(text) % 4 <> 0 AS ok FROM conversations
), ends AS (
  SELECT *, min(CASE WHEN NOT ok THEN page END) OVER (PARTITION BY fqdn) AS stop FROM log
)
"""


@query(WALK_SQL + "SELECT fqdn, page FROM ends WHERE stop IS NULL OR page < stop")
def page_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages fetched before the first failure."""
    log = _fetch_log(spark, sf_dir)
    return crawl.page_walk(log, ["fqdn"], ~F.col("ok"), keep_stop=False).drop("ok")


@query(WALK_SQL + "SELECT fqdn, page FROM ends WHERE (stop IS NULL OR page <= stop) AND page <= 3")
def page_walk_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages up to the first that shows the wanted thing, three at most."""
    log = _fetch_log(spark, sf_dir)
    return crawl.page_walk(log, ["fqdn"], ~F.col("ok"), keep_stop=True, limit=3).drop("ok")


@query(
    """
WITH listings AS (
  SELECT url AS listing, page_id, CASE page_id % 4 WHEN 0 THEN 'page_arg' WHEN 1 THEN 'main_query'
    WHEN 2 THEN 'path' ELSE 'single' END AS style FROM pages
)
SELECT page_id, CAST(page AS BIGINT) AS page,
  CASE WHEN style = 'page_arg' THEN listing || CASE WHEN contains(listing, '?') THEN '&' ELSE '?' END || 'Page=' || page
    WHEN page = 1 THEN listing
    WHEN style = 'main_query' THEN listing || '?page=' || page || '#latest_news_section'
    ELSE listing || '/page/' || page END AS url
FROM listings, range(1, 4) AS p(page) WHERE style <> 'single' OR page = 1
"""
)
def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    style = F.element_at(
        F.array(*[F.lit(s) for s in ("page_arg", "main_query", "path", "single")]),
        (F.col("page_id") % 4 + 1).cast("int"),
    )
    listings = table(spark, sf_dir, "pages").select(
        F.col("url").alias("listing"), "page_id", style.alias("style")
    )
    pages = crawl.listing_pages(listings, 3)
    return pages.select("page_id", F.col("page").cast("long").alias("page"), "url")


@query(
    """
SELECT conv_id, turn, role,
  CAST(row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS BIGINT) AS seq
FROM conversations
"""
)
def listing_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A role plays a listing and a conversation one of its pages."""
    cards = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    numbered = crawl.number_in_listing(cards, ["role"], "conv_id", "turn")
    return numbered.withColumn("seq", F.col("seq").cast("long"))


@query(
    """
SELECT event_type AS site, user_id AS url, event_id AS position FROM events
QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id % 5, event_id) = 1
"""
)
def category_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("site"),
        F.col("user_id").alias("url"),
        (F.col("event_id") % 5).alias("category_rank"),
        F.lit(1).alias("page"),
        F.col("event_id").alias("position"),
    )
    return crawl.once_per_url(cards).select("site", "url", "position")


@query(
    """
SELECT o_custkey, o_orderkey FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 3
"""
)
def first_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three cards of each listing, where a listing is a customer's orders."""
    cards = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return dedupe.top_k(cards, ["o_custkey"], [F.col("o_orderkey")], 3)


@query(
    """
SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS "group" FROM orders
WHERE CAST(o_orderdate AS DATE) = DATE '1998-03-01'
"""
)
def groups_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = table(spark, sf_dir, "orders").select(
        F.to_date("o_orderdate").alias("date"), F.col("o_custkey").cast("string").alias("group")
    )
    return aggregates.distinct_sorted(
        posts.filter(filters.on_day(F.col("date"), AS_OF)), "group"
    )


@query(
    """
SELECT o_orderkey FROM orders
WHERE CAST(o_orderdate AS DATE) = DATE '1998-03-01' AND o_orderkey % 6 <> 5
"""
)
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders and saved pages in the five notations that are written; another is never kept."""
    return sinks.retain(_stored(spark, sf_dir, F.col("o_orderdate")), AS_OF).select("o_orderkey")


@query(
    """
SELECT o_orderkey FROM orders
WHERE date_trunc('month', CAST(o_orderdate AS DATE)) = DATE '1998-03-01' AND o_orderkey % 6 <> 5
"""
)
def retained_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in folders, one for the first day of each month; a rerun replaces the day that is then read."""
    path = f"{shared_dir(spark)}/days-{uuid.uuid4().hex}"
    delete_at_exit(spark, path)
    stored = _stored(spark, sf_dir, F.trunc("o_orderdate", "month"))
    again = F.col("day") == AS_OF
    # The first run had half the rows of that day.
    tables.write_days(stored.where(~again | (F.col("o_orderkey") % 2 == 0)).drop("day"), path)
    tables.write_days(stored.where(again & (F.col("o_orderkey") % 6 != 5)).drop("day"), path)
    return tables.read_day(spark, path, AS_OF).select("o_orderkey")


def _stored(spark: SparkSession, sf_dir: str, day: Column) -> DataFrame:
    key = F.col("o_orderkey")
    label = (
        F.when(key % 6 == 0, F.date_format(day, "MMMM d, yyyy"))
        .when(key % 6 == 1, F.date_format(day, "yyyy-MM-dd"))
        .when(key % 6 == 2, F.date_format(day, "MMM dd, yyyy"))
        .when(key % 6 == 3, F.date_format(day, "MMMM dd, yyyy"))
        .when(key % 6 == 4, F.concat(F.lit("play_"), F.date_format(day, "yyyyMMdd"), F.lit("_page2.html")))
        .otherwise(F.date_format(day, "dd/MM/yyyy"))
    )
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", label.alias("date"), F.date_format(day, "yyyy-MM-dd").alias("day")
    )


@query(
    """
SELECT CAST(c_custkey AS VARCHAR) AS "group", CAST(c_custkey % 6 AS BIGINT) AS pages
FROM customer WHERE c_custkey % 6 > 0
"""
)
def fetched_seed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed pages joined to a fetch log in which page n of a host fails from n > key % 6 on."""
    key = F.col("c_custkey")
    seeds = table(spark, sf_dir, "customer").select(
        key.cast("string").alias("group"), F.col("c_name").alias("fqdn"), "c_custkey"
    )
    log = seeds.select("fqdn", "c_custkey", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("page"))
    log = log.select("fqdn", "page", (F.col("page") <= F.col("c_custkey") % 6).alias("ok"))
    fetched = jobs.expand_seed_pages(seeds.drop("c_custkey"), log, AS_OF)
    return fetched.groupBy("group").agg(F.count("*").alias("pages"))
