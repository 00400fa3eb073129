"""Tables that grow by runs: bucketed by key for merges, partitioned by day for retention."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import dates
from tidewatch.operators import dedupe

# Column that rows are bucketed by: a text for every key, of its own for null.
KEY = "_key"
# Column and folder of a row's day.
DAY = "_day"


def _keyed(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumn(KEY, F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("null")))


def create_keyed(rows: DataFrame, name: str, path: str, key: str = "url", buckets: int = 200) -> None:
    """A table of the session's catalog with one row per ``key``, dealt to buckets by it.

    ``rows`` have unique keys, as a merge leaves them; null is a key too. The number of buckets stays with the table:
    choose it so that a bucket of the largest expected table fits a task.
    """
    write = _keyed(rows, key).write.bucketBy(buckets, KEY).sortBy(KEY).option("path", path)
    write.mode("overwrite").format("parquet").saveAsTable(name)


def read_keyed(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name).drop(KEY)


def new_rows(table: DataFrame, rows: DataFrame, key: str = "url") -> DataFrame:
    """The first row of each key that the keyed ``table`` lacks; ``file`` and ``ordinal`` fix what is first.

    The table's side is read bucket by bucket, without a shuffle, and of its columns the key alone.
    """
    first = dedupe.keep_first(_keyed(rows, key), [KEY], [F.col("file"), F.col("ordinal")])
    return first.join(table.select(KEY), KEY, "left_anti").drop("file", "ordinal")


def merge_keyed(spark: SparkSession, name: str, path: str, rows: DataFrame, key: str = "url", buckets: int = 200) -> dict:
    """Add the rows of new keys to a keyed table; ``{"added_rows": n}``, counted while they are written.

    Rows that the table has stay where they are, so a run costs what is new. A second run with the same rows
    adds none. Columns that the table lacks are not kept; those that ``rows`` lacks are null.
    """
    table = spark.table(name)
    counted = Observation()
    found = new_rows(table, rows, key).observe(counted, F.count("*").alias("added_rows"))
    absent = [c for c in table.columns if c not in found.columns]
    aligned = found.withColumns({c: F.lit(None).cast(table.schema[c].dataType) for c in absent}).select(*table.columns)
    write = aligned.write.bucketBy(buckets, KEY).sortBy(KEY).option("path", path)
    write.mode("append").format("parquet").saveAsTable(name)
    return counted.get


def write_days(rows: DataFrame, path: str, column: str = "date") -> None:
    """Write rows into folders by the day that their date text names; a day that is written again is replaced.

    Other days stay as they are. Rows whose date cannot be read lie in a folder of their own.
    """
    day = F.coalesce(F.date_format(dates.stored_day(F.col(column)), "yyyy-MM-dd"), F.lit("unknown"))
    (
        rows.withColumn(DAY, day)
        .hint("rebalance", DAY)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(DAY)
        .parquet(path)
    )


def read_day(spark: SparkSession, path: str, as_of: date | str) -> DataFrame:
    """Rows of one day, read from its folder alone."""
    days = spark.read.option("partitionColumnTypeInference", False).parquet(path)
    return days.where(F.col(DAY).cast("string") == str(as_of)).drop(DAY)
