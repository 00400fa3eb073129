"""File sources: article texts, saved pages, CSV tables, JSON arrays, the technique sheet."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewatch import schemas
from tidewatch.functions import dates, text
from tidewatch.operators import dedupe

# Marker for pages saved directly under the base folder (fixed value).
ROOT_GROUP = "unknown_group_at_root"
MIN_PAGE_CHARS = 50


def _whole_files(spark: SparkSession, base: str, glob: str) -> DataFrame:
    """One row per file: ``path`` relative to ``base`` and the whole text."""
    root = base.rstrip("/")
    # A local path is reported as a file: URI, so the prefix is cut after the base folder.
    relative = F.regexp_replace(
        F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))),
        "^.*?" + _quoted(root) + "/+",
        "",
    )
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .text(root, wholetext=True)
        .select(relative.alias("path"), F.col("value"))
    )


def _quoted(literal: str) -> str:
    return r"\Q" + literal.split(":", 1)[-1].lstrip("/") + r"\E"


def read_article_files(spark: SparkSession, base: str) -> DataFrame:
    """``path, value`` of every ``article.txt`` below ``base``."""
    return _whole_files(spark, base, "article.txt")


def read_article_texts(spark: SparkSession, base: str) -> DataFrame:
    """``path, value`` of every text file below ``base``, for the search documents."""
    return _whole_files(spark, base, "*.txt")


def parse_articles(
    files: DataFrame, formats: tuple[str, ...] = dates.DIRECTORY_FORMATS
) -> DataFrame:
    """Article rows from ``path, value``; files without a title line are dropped.

    ``path`` is ``source/date/...`` and stays as the row's id; an unreadable date becomes null.
    """
    parts = F.split(F.col("path"), "/")
    # The last part is the file name, so it never counts as source or date.
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    # Lines are split once, and the explode drops files without a title line.
    titled = files.select("path", text.article_lines(F.col("value")).alias("lines")).select(
        "path",
        "lines",
        F.try_element_at(text.first_with(F.col("lines"), text.URL_LABEL), F.lit(1)).alias("url_line"),
        F.explode(text.first_with(F.col("lines"), text.TITLE_LABEL)).alias("title_line"),
    )
    # The body follows the first URL line, else starts two lines after the title line.
    start = F.coalesce(
        F.array_position("lines", F.col("url_line")) + 1,
        F.array_position("lines", F.col("title_line")) + 2,
    )
    body = F.array_join(F.slice("lines", start.cast("int"), F.size("lines")), "\n")
    return titled.select(
        "path",
        text.trim_blank(F.replace("title_line", F.lit(text.TITLE_LABEL), F.lit(""))).alias("title"),
        text.trim_blank(body).alias("content"),
        dates.parse_date(F.try_element_at(folders, F.lit(2)), formats).alias("date"),
        F.coalesce(F.try_element_at(folders, F.lit(1)), F.lit(".")).alias("source"),
    )


def read_pages(spark: SparkSession, base: str) -> DataFrame:
    """``html_file, group, html`` of every saved page, one folder per group."""
    return page_rows(_whole_files(spark, base, "*.html"))


def page_rows(files: DataFrame) -> DataFrame:
    """Name and group from ``path``; pages under 50 characters are dropped."""
    parts = F.split(F.col("path"), "/")
    return files.filter(F.length("value") >= MIN_PAGE_CHARS).select(
        F.element_at(parts, -1).alias("html_file"),
        F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(ROOT_GROUP)).alias("group"),
        F.col("value").alias("html"),
    )


def read_csv_folder(
    spark: SparkSession,
    folder: str,
    schema: str = "",
    exclude: str = "shodan_data.csv",
    multi_line: bool = True,
) -> DataFrame:
    """Every CSV of ``folder`` but the base file, with ``file`` and ``ordinal`` giving row order.

    Columns are matched by header name: the result has the columns of all files, null
    where a file lacks one. ``schema`` gives the types of known columns; other ones are
    text. Files with the same header are read together; damaged files are skipped. Without
    ``multi_line`` values hold no line ends and large files are read by several tasks.
    """
    headers = _headers(spark, folder).collect()
    by_header: dict[tuple[str, ...], list[str]] = {}
    for row in sorted(headers):
        if not row.file.endswith("/" + exclude):
            by_header.setdefault(_header_names(row.header), []).append(row.file)
    tables = [
        _typed(_with_order(_csv(spark, multi_line).schema(_text_columns(header)).csv(same)), schema)
        for header, same in by_header.items()
        if header
    ]
    if not tables:
        empty = spark.createDataFrame([], schema or "url string")
        return empty.withColumns({"file": F.lit(""), "ordinal": F.lit(0).cast("long")})
    return dedupe.union_aligned(tables)


def _header_names(line: str) -> tuple[str, ...]:
    """Column names of a header line, a repeated one with a number; none if the line cannot be read."""
    try:
        names = [n.strip() for n in next(csv.reader([line], strict=True), [])]
    except csv.Error:
        return ()
    # Spark tells columns apart without regard to case.
    taken: set[str] = set()
    out = []
    for name in names:
        number, free = 0, name
        while free.lower() in taken:
            number += 1
            free = f"{name}.{number}"
        taken.add(free.lower())
        out.append(free)
    return tuple(out)


def _headers(spark: SparkSession, folder: str) -> DataFrame:
    """``file, header``: the first line of every CSV file, found in one pass by the tasks.

    Splits that begin inside a file are left out; of the others only the first line leaves a task.
    """
    lines = (
        spark.read.option("pathGlobFilter", "*.csv")
        .option("ignoreCorruptFiles", True)
        .text(folder)
        .where("_metadata.file_block_start = 0")
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.struct(F.monotonically_increasing_id().alias("at"), F.ltrim("value", F.lit("\ufeff")).alias("line")).alias("first"),
        )
    )
    return lines.groupBy("file").agg(F.min("first").alias("first")).select("file", F.col("first.line").alias("header"))


def read_csv_table(
    spark: SparkSession, path: str, schema: str = "", multi_line: bool = True
) -> DataFrame:
    """One CSV table with its row order in ``file`` and ``ordinal``."""
    return _typed(_with_order(_csv(spark, multi_line).csv(path)), schema)


def _csv(spark: SparkSession, multi_line: bool) -> DataFrameReader:
    return (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("ignoreCorruptFiles", True)
    )


def _text_columns(names: Sequence[str]) -> str:
    return ", ".join(f"`{name}` string" for name in names)


def _typed(rows: DataFrame, schema: str) -> DataFrame:
    """Known columns cast to their types; unreadable values become null."""
    types = {f.name: f.dataType for f in StructType.fromDDL(schema).fields} if schema else {}
    return rows.select(
        *[
            F.col(f"`{c}`").try_cast(types[c]).alias(c) if c in types else F.col(f"`{c}`")
            for c in rows.columns
        ]
    )


def _with_order(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {"file": F.col("_metadata.file_path"), "ordinal": F.monotonically_increasing_id()}
    )


def normalize_header(techniques: DataFrame) -> DataFrame:
    """Rename the sheet's id, name and description columns, whatever their case or padding."""
    names = {
        "id": "technique_id",
        "technique id": "technique_id",
        "name": "technique_name",
        "technique name": "technique_name",
        "description": "description",
    }
    columns: list[Column] = []
    for column in techniques.columns:
        known = names.get(column.strip().lower())
        columns.append(F.col(f"`{column}`").alias(known or column))
    return techniques.select(*columns)


def read_techniques(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Technique rows from a converted sheet, incomplete rows kept (see ``match_texts``)."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    return normalize_header(reader.load(path))


def match_texts(techniques: DataFrame, text_col: str = "technique_name") -> DataFrame:
    """``technique_id, technique_name, text``: names for articles, descriptions for CVEs.

    A sheet without a name column falls back to its description; null text becomes ``""``.
    """
    if text_col not in techniques.columns:
        text_col = "description"
    name = "technique_name" if "technique_name" in techniques.columns else "description"
    return techniques.select(
        "technique_id",
        F.col(name).alias("technique_name"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array file (articles, seeds, news) with a declared schema."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def read_group_feed(spark: SparkSession, path: str) -> DataFrame:
    """One row per location of each group in the feed."""
    feed = read_json_array(spark, path, schemas.GROUP_FEED)
    return explode_feed(feed)


def explode_feed(feed: DataFrame) -> DataFrame:
    return feed.select("name", F.posexplode("locations").alias("ordinal", "location")).select(
        "name", "ordinal", "location.*"
    )
