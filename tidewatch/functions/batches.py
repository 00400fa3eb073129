"""Arrow batches in parts of bounded size, for Python functions whose results are larger than what they read."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Bytes of a part; a larger row is a part of its own. Python holds the objects of one part at a time.
PART_BYTES = 1 << 20


def parts(batch: pa.RecordBatch, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch``, in order, halved until a part has at most ``most`` bytes."""
    half = batch.num_rows // 2
    if half and batch.nbytes > most:
        yield from parts(batch.slice(0, half), most)
        yield from parts(batch.slice(half), most)
    else:
        yield batch


def by_parts(start: Callable[[], Callable[..., list]], kind: str, result: pa.DataType, *columns: Column) -> Column:
    """A column of Arrow type ``result`` and Spark type ``kind``, made of the rows' values by lists.

    ``start()`` is called once a task; what it returns turns equally long lists, one for each of the columns, into one.
    """
    names = [str(i) for i in range(len(columns))]

    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = start()
        for column in batches:
            for part in parts(pa.RecordBatch.from_arrays([column], names)):
                yield pa.array(work(part.column(0).to_pylist()), result)

    def several(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        work = start()
        for found in batches:
            for part in parts(pa.RecordBatch.from_arrays(list(found), names)):
                yield pa.array(work(*[c.to_pylist() for c in part.columns]), result)

    return F.arrow_udf(one if len(columns) == 1 else several, kind)(*columns)
