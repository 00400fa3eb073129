"""Arrow batches in parts: order, bounds, and the functions that read them so."""

from __future__ import annotations

import os
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from tidewatch.functions import batches

SF_DIR = "/root/testdata/sf0.001"


def test_parts_keep_rows_and_stay_small():
    texts = ["x" * n for n in (5, 90, 0, 2000, 40, 60, 1, 30)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])
    found = list(batches.parts(batch, 150))
    assert [t for p in found for t in p.column(0).to_pylist()] == texts
    assert all(p.nbytes <= 150 or p.num_rows == 1 for p in found)
    assert [p.num_rows for p in batches.parts(batch.slice(0, 0))] == [0]


def test_python_holds_a_part_at_a_time(spark):
    sizes = batches.by_parts(lambda: lambda texts, ids: [len(texts)] * len(texts), "int", pa.int32(), F.col("t"), F.col("id"))
    rows = spark.range(0, 4000, 1, 1).select("id", F.repeat(F.lit("x"), 1000).alias("t"))
    found = [r.n for r in rows.select(sizes.alias("n")).collect()]
    assert len(found) == 4000 and max(found) * 1000 <= batches.PART_BYTES


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are absent")
@pytest.mark.parametrize("name", ["extractive_summary", "subword_tokens", "article_bodies", "site_cards"])
def test_rows_pass_to_python_by_parts(spark, name):
    text = entry_points.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    # Functions over an iterator of Arrow batches, as those of ``by_parts`` are.
    assert set(re.findall(r"ArrowEvalPython .*, (\d+)", text)) == {"251"}
