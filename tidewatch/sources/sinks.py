"""Sinks and retention."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import dates, text


def _edge_text(df: DataFrame) -> DataFrame:
    """Arrays, structs and maps as JSON text, for CSV."""
    columns = []
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        column = F.col(f"`{field.name}`")
        columns.append(
            F.to_json(column).alias(field.name) if kind in ("array", "struct", "map") else column
        )
    return df.select(*columns)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a new version of a table; CSV gets a header and text for nested columns."""
    if fmt == "csv":
        _edge_text(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    else:
        df.write.mode("overwrite").format(fmt).save(path)


def append_news(news: DataFrame, path: str) -> None:
    """Add news to the JSON store, one folder per date; a rerun adds its rows again."""
    day = dates.date_text(F.col("date"))
    (
        news.withColumns({"date": day, "day": F.nullif(day, F.lit(""))})
        # Few files per day, and several tasks for a day that holds much of the news.
        .hint("rebalance", "day")
        .write.mode("append")
        .partitionBy("day")
        .json(path)
    )


def search_document(value: Column, as_of: date | str, source: str) -> Column:
    """Search document of a labelled text: labels stripped, body from the fourth line."""
    lines = F.split(value, r"\r\n|\r|\n")

    def line(n: int, label: str) -> Column:
        found = F.coalesce(F.try_element_at(lines, F.lit(n)), F.lit(""))
        return text.trim_blank(F.replace(found, F.lit(label), F.lit("")))

    content = text.trim_blank(F.array_join(F.slice(lines, F.lit(4), F.size(lines)), "\n"))
    return F.struct(
        line(1, text.TITLE_LABEL).alias("title"),
        line(2, text.URL_LABEL).alias("url"),
        F.lit(str(as_of)).alias("published_at"),
        F.lit(source).alias("source"),
        F.array().cast("array<string>").alias("tags"),
        F.substring(content, 1, 300).alias("summary"),
        content.alias("content"),
    )


def search_documents(files: DataFrame, as_of: date | str, source: str) -> DataFrame:
    """Documents of ``(path, value)`` rows that have a title and an address."""
    return (
        files.select(search_document(F.col("value"), as_of, source).alias("doc"))
        .select("doc.*")
        .filter((F.col("title") != "") & (F.col("url") != ""))
    )


def write_search_documents(docs: DataFrame, path: str) -> None:
    """JSON lines, one document each."""
    docs.write.mode("append").json(path)


def retain(table: DataFrame, as_of: date | str, column: str = "date") -> DataFrame:
    """Rows whose date text, in any notation that is written, is ``as_of``."""
    return table.filter(dates.stored_day(F.col(column)) == F.lit(str(as_of)).cast("date"))
