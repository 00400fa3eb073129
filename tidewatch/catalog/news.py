"""Article files, search documents, news days, dates and names."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import schemas
from tidewatch.catalog import vectors
from tidewatch.catalog.registry import query, table
from tidewatch.functions import dates, text
from tidewatch.operators import aggregates, features
from tidewatch.plans import jobs
from tidewatch.session import delete_at_exit, shared_dir
from tidewatch.sources import files, sinks


def _article_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as labelled article files: four layouts and three date notations."""
    key = F.col("doc_id")
    lines = F.split("text", "\n")
    title = F.concat(F.lit("제목: "), lines[0])
    body = F.array_join(F.slice(lines, F.lit(2), F.size(lines)), "\n")
    url = F.concat(F.lit("URL: http://news/"), key.cast("string"))
    value = (
        F.when(key % 4 == 0, F.concat_ws("\n", title, url, F.lit("날짜: today"), body))
        .when(key % 4 == 1, F.concat_ws("\n", F.lit(" "), title, F.lit("skipped"), body, F.lit("")))
        .when(key % 4 == 2, F.concat_ws("\n", F.lit("intro"), title, F.lit("x"), url, body))
        .otherwise(body)
    )
    day = F.date_add(F.lit("2024-02-27").cast("date"), (key % 5).cast("int"))
    folder = (
        F.when(key % 3 == 0, F.date_format(day, "MMMM dd, yyyy"))
        .when(key % 3 == 1, F.date_format(day, "yyyy-MM-dd"))
        .otherwise(F.date_format(day, "MMM dd, yyyy"))
    )
    path = F.concat_ws(
        "/", "source", folder, F.concat(key.cast("string"), F.lit("_title")), F.lit("article.txt")
    )
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), value.alias("value"))


ARTICLE_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, string_split(text, chr(10)) AS lines,
    DATE '2024-02-27' + CAST(doc_id % 5 AS INTEGER) AS day FROM documents
), parts AS (
  SELECT doc_id, source, day, lines[1] AS head, array_to_string(lines[2:], chr(10)) AS body FROM docs
)
"""


@query(
    ARTICLE_SQL
    + r"""
SELECT doc_id, source, regexp_replace(head, '^\s+|\s+$', '', 'g') AS title,
  CASE WHEN doc_id % 3 = 2 THEN '' ELSE strftime(day, '%Y-%m-%d') END AS date,
  md5(regexp_replace(CASE WHEN doc_id % 4 = 0 THEN '날짜: today' || chr(10) || body ELSE body END,
      '^\s+|\s+$', '', 'g')) AS content_md5
FROM parts WHERE doc_id % 4 <> 3
"""
)
def article_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = files.parse_articles(_article_files(spark, sf_dir))
    return parsed.select(
        F.regexp_extract("path", r"/(\d+)_title/", 1).cast("long").alias("doc_id"),
        "source",
        "title",
        dates.date_text(F.col("date")).alias("date"),
        F.md5("content").alias("content_md5"),
    )


@query(
    ARTICLE_SQL
    + r"""
, texts AS (
  SELECT regexp_replace(head, '^\s+|\s+$', '', 'g') AS title, doc_id,
    regexp_replace(body, '^\s+|\s+$', '', 'g') AS content
  FROM parts WHERE doc_id % 4 = 0
)
SELECT title, 'http://news/' || doc_id AS url, '2024-03-01' AS published_at, 'Example' AS source,
  substring(content, 1, 300) AS summary, md5(content) AS content_md5
FROM texts WHERE title <> ''
UNION ALL
SELECT title, url, '2024-03-01', 'Example', substring(content, 1, 300), md5(content) FROM (
  SELECT 'intro' AS title, '제목: ' || regexp_replace(head, '^\s+|\s+$', '', 'g') AS url,
    regexp_replace('URL: http://news/' || doc_id || chr(10) || body, '^\s+|\s+$', '', 'g') AS content
  FROM parts WHERE doc_id % 4 = 2)
UNION ALL
SELECT title, url, '2024-03-01', 'Example', substring(content, 1, 300), md5(content) FROM (
  SELECT regexp_replace(string_split(body, chr(10))[1], '^\s+|\s+$', '', 'g') AS title,
    regexp_replace(COALESCE(string_split(body, chr(10))[2], ''), '^\s+|\s+$', '', 'g') AS url,
    regexp_replace(COALESCE(array_to_string(string_split(body, chr(10))[4:], chr(10)), ''),
                   '^\s+|\s+$', '', 'g') AS content
  FROM parts WHERE doc_id % 4 = 3) WHERE title <> '' AND url <> ''
"""
)
def search_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = jobs.search_documents(_article_files(spark, sf_dir), "2024-03-01", "Example")
    return docs.select(
        "title", "url", "published_at", "source", "summary", F.md5("content").alias("content_md5")
    )


@query(
    """
WITH news AS (
  SELECT event_id, strftime(ts, '%Y-%m-%d') AS date_str FROM events WHERE event_id % 13 <> 0
), days AS (
  SELECT date_str, COALESCE(lag(date_str) OVER w, date_str) AS previous_date,
    COALESCE(lead(date_str) OVER w, date_str) AS next_date
  FROM (SELECT DISTINCT date_str FROM news) WINDOW w AS (ORDER BY date_str)
)
SELECT event_id, date_str, row_number() OVER w AS position, count(*) OVER d AS of,
  COALESCE(lag(event_id) OVER w, max(event_id) OVER d) AS previous_item,
  COALESCE(lead(event_id) OVER w, min(event_id) OVER d) AS next_item, previous_date, next_date
FROM news JOIN days USING (date_str)
WINDOW w AS (PARTITION BY date_str ORDER BY event_id), d AS (PARTITION BY date_str)
"""
)
def news_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.when(F.col("event_id") % 13 == 0, "").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    news = table(spark, sf_dir, "events").select("event_id", day.alias("date"))
    placed = jobs.news_calendar(news, item="event_id", order="event_id")
    return placed.select(
        "event_id",
        "date_str",
        F.col("position").cast("long").alias("position"),
        F.col("of").cast("long").alias("of"),
        "previous_item",
        "next_item",
        "previous_date",
        "next_date",
    )


@query("SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS date_str FROM events")
def news_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    news = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("date_str"))
    return aggregates.distinct_sorted(news, "date_str")


@query(
    """
SELECT doc_id, lang, CASE WHEN lang = 'de' THEN md5(replace(text, 'en', 'EN')) ELSE md5(text) END AS text_md5
FROM documents
"""
)
def source_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A letter swap plays the translator of one source."""

    def swap(batches):
        for batch in batches:
            yield batch.assign(content=batch["content"].str.replace("en", "EN", regex=False))

    articles = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("source"), F.col("text").alias("content")
    )
    changed = features.transform_source(articles, "de", swap, columns=("content",))
    return changed.select("doc_id", F.col("source").alias("lang"), F.md5("content").alias("text_md5"))


PARSED = (
    ARTICLE_SQL
    + r"""
SELECT doc_id AS id, source, regexp_replace(head, '^\s+|\s+$', '', 'g') AS title,
  CASE WHEN doc_id % 3 = 2 THEN '' ELSE strftime(day, '%Y-%m-%d') END AS date,
  regexp_replace(CASE WHEN doc_id % 4 = 0 THEN '날짜: today' || chr(10) || body ELSE body END,
      '^\s+|\s+$', '', 'g') AS text
FROM parts WHERE doc_id % 4 <> 3
"""
)


@query(
    vectors.vector_sql(PARSED, vectors.ITEMS)
    + vectors.UNIT_SQL
    + vectors.MATCH_SQL
    + ", "
    + vectors.summary_sql(PARSED)
    + f"""
SELECT title, date, source, md5(text) AS content_md5, md5(COALESCE(summary, '')) AS summary_md5,
  COALESCE(CAST(item_id AS VARCHAR), 'none') AS match_id, COALESCE(round(score, 6), -1) AS score
FROM ({PARSED}) p LEFT JOIN best ON best.id = p.id LEFT JOIN chosen ON chosen.id = p.id
"""
)
def built_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole news job: article files to summarized articles with their technique."""
    techniques = vectors.benchmark_techniques(spark, sf_dir)
    news = jobs.build_news(_article_files(spark, sf_dir), techniques)
    return news.select(
        "title",
        "date",
        "source",
        F.md5("content").alias("content_md5"),
        F.md5("summary").alias("summary_md5"),
        F.coalesce("mitre_match.id", F.lit("none")).alias("match_id"),
        F.coalesce(F.round("mitre_match.score", 6), F.lit(-1.0)).alias("score"),
    )


def _notations(day: Column) -> dict[str, Column]:
    part = F.date_format
    return {
        "korean": F.concat(
            F.lit("기자 "), part(day, "yyyy"), F.lit("년 "), part(day, "M"), F.lit("월 "),
            part(day, "d"), F.lit("일 10:00"),
        ),
        "short_us": part(day, "MMM dd, yyyy"),
        "long_us": part(day, "MMMM dd, yyyy"),
        "unpadded": part(day, "yyyy-M-d"),
    }


@query(
    """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS korean, strftime(o_orderdate, '%Y-%m-%d') AS short_us,
  strftime(o_orderdate, '%Y-%m-%d') AS long_us, strftime(o_orderdate, '%Y-%m-%d') AS unpadded,
  CASE WHEN month(o_orderdate) = 5 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS short_as_folder
FROM orders
"""
)
def date_notations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each notation read back; a short month in a folder name is unreadable, except May."""
    shown = table(spark, sf_dir, "orders").select(
        "o_orderkey", *[c.alias(n) for n, c in _notations(F.col("o_orderdate")).items()]
    )
    return shown.select(
        "o_orderkey",
        dates.date_text(dates.korean_date(F.col("korean"))).alias("korean"),
        dates.date_text(dates.display_date(F.col("short_us"))).alias("short_us"),
        dates.date_text(dates.display_date(F.col("long_us"))).alias("long_us"),
        dates.date_text(dates.parse_date(F.col("unpadded"))).alias("unpadded"),
        dates.date_text(dates.parse_date(F.col("short_us"))).alias("short_as_folder"),
    )


@query(
    r"""
WITH t AS (SELECT doc_id, string_split(text, chr(10))[1] AS title, source FROM documents)
SELECT doc_id, lower(regexp_replace(title, '[^a-zA-Z0-9]', '_', 'g')) AS slug,
  substring(regexp_replace(regexp_replace(title, '[^a-zA-Z0-9가-힣]', '_', 'g'), '_+', '_', 'g'), 1, 80) AS slug_hangul,
  regexp_replace(title, '[^\p{L}\p{M}\p{N}_.\-]', '_', 'g') AS slug_file,
  CASE WHEN doc_id % 3 = 0 THEN 'unknown_group' ELSE 'my_' || source || '_' END AS group_name
FROM t
"""
)
def title_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.split("text", "\n")[0]
    raw = F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(
        F.concat(F.lit(" MY "), F.upper("source"), F.lit("! "))
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        text.slug(title).alias("slug"),
        text.slug_hangul(title).alias("slug_hangul"),
        text.slug_file(title).alias("slug_file"),
        text.group_name(raw).alias("group_name"),
    )


def _fresh_folder(spark: SparkSession, name: str) -> str:
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    delete_at_exit(spark, folder)
    return folder


@query(
    """
SELECT event_type AS title, CASE WHEN event_id % 13 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%d') END AS date,
  'T' || user_id AS match_id, CAST(count(*) * 2 AS BIGINT) AS rows
FROM events GROUP BY ALL
"""
)
def news_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News appended to the JSON store twice: a rerun adds its rows again."""
    day = F.when(F.col("event_id") % 13 != 0, F.to_date("ts"))
    news = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("title"),
        day.alias("date"),
        F.struct(
            F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("id"),
            F.lit("n").alias("name"),
            F.lit(0.5).alias("score"),
        ).alias("mitre_match"),
    )
    folder = _fresh_folder(spark, "news")
    sinks.append_news(news, folder)
    sinks.append_news(news, folder)
    stored = spark.read.schema(schemas.NEWS).json(folder)
    return stored.groupBy("title", "date", F.col("mitre_match.id").alias("match_id")).agg(
        F.count("*").alias("rows")
    )


@query(
    """
WITH rows AS (
  SELECT 'h' || o_custkey AS url, o_orderstatus AS "group", o_orderkey AS row_id, o_orderkey % 3 AS part FROM orders
)
SELECT url, min("group") AS "group", CAST(min(part) AS BIGINT) AS part FROM (
  SELECT url, "group", part, row_number() OVER (PARTITION BY url ORDER BY part, row_id) AS r FROM rows
) WHERE r = 1 GROUP BY url
"""
)
def csv_merge_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three CSV files written, read back as one folder with row order, and merged by url."""
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("h"), F.col("o_custkey").cast("string")).alias("url"),
        F.col("o_orderstatus").alias("group"),
        key.alias("row_id"),
        (key % 3).alias("part"),
    )
    folder = _fresh_folder(spark, "csv")
    for part in range(3):
        sinks.write_table(rows.filter(F.col("part") == part), f"{folder}/part{part}", "csv")
    schema = "url string, `group` string, row_id long, part long"
    tables = [files.read_csv_folder(spark, f"{folder}/part{part}", schema) for part in range(3)]
    # Written in several tasks, so the row's own number, not the file, carries its order.
    tables = [t.withColumns({"file": F.col("part"), "ordinal": F.col("row_id")}) for t in tables]
    return jobs.merge_hosts(tables[0], *tables[1:]).select("url", "group", "part")
