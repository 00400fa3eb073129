"""Keep-first, top-k and unions with column alignment.

``row_number() <= k`` lets Spark trim every group to its best k rows before the
shuffle, so a key that holds much of the table sends k rows per input partition.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None
) -> DataFrame:
    """The first ``k`` rows of each key; null keys form one group. ``rank`` keeps the position."""
    name = rank or "_rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    kept = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)
    return kept if rank else kept.drop(name)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_k(df, keys, order, 1)


def union_aligned(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of all tables; columns of the first come first, missing ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def add_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Absent columns added as null text."""
    absent = [c for c in columns if c not in df.columns]
    return df.withColumns({c: F.lit(None).cast("string") for c in absent})


def merge_keep_first(
    base: DataFrame, new: Sequence[DataFrame], key: str = "url"
) -> DataFrame:
    """Base rows before new ones, one row per ``key``.

    Inputs carry ``file`` and ``ordinal``; they fix what "first" means.
    """
    return _merged(base, new, key).drop("_source", "file", "ordinal")


def _merged(base: DataFrame, new: Sequence[DataFrame], key: str) -> DataFrame:
    ranked = [base.withColumn("_source", F.lit(0))]
    ranked += [table.withColumn("_source", F.lit(1)) for table in new]
    order = [F.col("_source"), F.col("file"), F.col("ordinal")]
    return keep_first(union_aligned(ranked), [key], order)


def observed_merge(
    base: DataFrame, new: Sequence[DataFrame], key: str = "url"
) -> tuple[DataFrame, Observation]:
    """``merge_keep_first`` with its run counters, which are there once the result has been written.

    ``base_rows`` are base rows after dedupe, as these come first, ``merged_rows`` all rows and ``added_rows``
    what the new tables added. The counts are taken as rows pass by, so nothing is read twice.
    """
    counted = Observation()
    from_base = F.col("_source") == 0
    merged = _merged(base, new, key).observe(
        counted,
        F.count_if(from_base).alias("base_rows"),
        F.count("*").alias("merged_rows"),
        F.count_if(~from_base).alias("added_rows"),
    )
    return merged.drop("_source", "file", "ordinal"), counted


def without_known(new: DataFrame, known: DataFrame, key: str = "url") -> DataFrame:
    """Rows of ``new`` whose key is absent from ``known``; null matches null."""
    seen = known.select(F.col(key).alias("_seen")).distinct()
    return new.join(seen, new[key].eqNullSafe(seen["_seen"]), "left_anti")


def refresh_holdout(new: DataFrame, train: DataFrame, holdout: DataFrame) -> DataFrame:
    """Rows not in the training table, after the existing hold-out rows, one per url."""
    if "extracted_url" in new.columns:
        new = new.withColumnRenamed("extracted_url", "url")
    fresh = without_known(new, train)
    return merge_keep_first(holdout, [fresh])


def observed_holdout(
    new: DataFrame, train: DataFrame, holdout: DataFrame
) -> tuple[DataFrame, Observation, Observation]:
    """``refresh_holdout`` with its run counters, there once the result has been written.

    ``left_rows`` are the new rows left after the training table; ``merged_rows`` count them and the hold-out rows,
    ``final_rows`` what is left of both after dedupe.
    """
    if "extracted_url" in new.columns:
        new = new.withColumnRenamed("extracted_url", "url")
    before, after = Observation(), Observation()
    fresh = without_known(new, train)
    both = union_aligned([holdout.withColumn("_source", F.lit(0)), fresh.withColumn("_source", F.lit(1))]).observe(
        before, F.count_if(F.col("_source") == 1).alias("left_rows"), F.count("*").alias("merged_rows")
    )
    order = [F.col("_source"), F.col("file"), F.col("ordinal")]
    kept = keep_first(both, ["url"], order).drop("_source", "file", "ordinal")
    return kept.observe(after, F.count("*").alias("final_rows")), before, after
