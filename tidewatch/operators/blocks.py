"""Compare every row of one table with every row of a reference table, block by block.

Exact nearest-neighbour and distance sums need all pairs, but never as rows:
each task multiplies a batch of vectors with a block of the reference vectors
and returns one reduced row per input row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import written

# A reference table up to this many vector elements is sent whole to the executors
# (8 bytes each); a larger one is compared in blocks that are shuffled, not broadcast.
BROADCAST_ELEMENTS = 8_000_000
ROWS_PER_BLOCK = 4_096
# Largest product of input and reference rows held at once in a task.
CELLS_AT_ONCE = 4_000_000

Reduce = Callable[[pd.DataFrame, np.ndarray, pd.DataFrame], pd.DataFrame]


def stack(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def against_reference(
    rows: DataFrame,
    reference: DataFrame,
    reduce_batch: Reduce,
    schema: str,
    id_col: str,
    dims: int,
    broadcast_elements: int = BROADCAST_ELEMENTS,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> tuple[DataFrame, bool]:
    """``reduce_batch(batch, matrix, reference_rows)`` for each batch and reference block.

    Both tables have a ``vector`` column of ``dims`` numbers; a row of ``rows``
    without one gives nothing. The flag tells
    whether each input row met the whole reference at once; if not, there is one
    output row per block and the caller combines them by ``id_col``.
    """
    bound = max(1, broadcast_elements // max(1, dims))
    head = reference.limit(bound + 1).toPandas()
    if len(head) <= bound:
        return _broadcast(rows, head, reduce_batch, schema), True
    return _blocked(rows, reference, reduce_batch, schema, id_col, rows_per_block), False


def against_broadcast(
    rows: DataFrame, reference: DataFrame, reduce_batch: Reduce, schema: str
) -> DataFrame:
    """``reduce_batch`` of each batch and the whole of a reference whose size the caller has checked."""
    return _broadcast(rows, reference.toPandas(), reduce_batch, schema)


def _pieces(batch: pd.DataFrame, width: int) -> Iterator[pd.DataFrame]:
    # Rows without a vector are left out here: a filter before this step would be
    # pushed below the vector's own projection and compute it twice.
    batch = batch[batch["vector"].notna()]
    step = max(1, CELLS_AT_ONCE // max(1, width))
    for start in range(0, len(batch), step):
        yield batch.iloc[start : start + step]


def _broadcast(
    rows: DataFrame, local: pd.DataFrame, reduce_batch: Reduce, schema: str
) -> DataFrame:
    matrix = stack(local["vector"]) if len(local) else np.zeros((0, 0))
    shared = rows.sparkSession.sparkContext.broadcast((matrix, local.drop(columns="vector")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors, info = shared.value
        for batch in batches:
            if len(vectors):
                for piece in _pieces(batch, len(vectors)):
                    yield reduce_batch(piece, vectors, info)

    return rows.mapInPandas(run, schema)


def _blocked(
    rows: DataFrame,
    reference: DataFrame,
    reduce_batch: Reduce,
    schema: str,
    id_col: str,
    rows_per_block: int,
) -> DataFrame:
    # Both sides are counted and then read again.
    rows, reference = written(rows), written(reference)
    blocks = ceil(reference.count() / rows_per_block)
    slices = ceil(rows.count() / rows_per_block)
    left = rows.withColumn("_slice", F.pmod(F.xxhash64(F.col(id_col), F.lit(1)), slices)).withColumn(
        "_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    right = reference.withColumn("_block", F.pmod(F.xxhash64(*_keys(reference)), blocks)).withColumn(
        "_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    )
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(batch: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(batch) or not len(block):
            return pd.DataFrame(columns=names)
        vectors, info = stack(block["vector"]), block.drop(columns="vector")
        parts = [reduce_batch(piece, vectors, info) for piece in _pieces(batch, len(vectors))]
        return pd.concat(parts) if parts else pd.DataFrame(columns=names)

    return (
        left.groupBy("_block", "_slice")
        .cogroup(right.groupBy("_block", "_slice"))
        .applyInPandas(run, schema)
    )


def _keys(reference: DataFrame) -> list:
    return [F.col(c) for c in reference.columns if c != "vector"]
