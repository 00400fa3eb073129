"""What the plans must and must not contain, so that they hold at scale."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_points

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are absent")


def plan(spark, name):
    df = entry_points.queries()[name](spark, SF_DIR)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_no_pairs_of_all_rows(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text


@pytest.mark.parametrize(
    "name", ["merge_keep_first", "holdout_refresh", "category_first_wins", "first_cards", "cluster_top5_techniques"]
)
def test_groups_are_trimmed_before_the_shuffle(spark, name):
    text = plan(spark, name)
    assert "WindowGroupLimit" in text and "Partial" in text


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("group_technique_counts", "l_partkey:bigint,l_suppkey:bigint"),
        ("page_urls", "page_id:bigint,html:string"),
        ("tfidf_embeddings", "doc_id:bigint,text:string"),
    ],
)
def test_scans_read_only_what_they_need(spark, name, columns):
    assert f"ReadSchema: struct<{columns}>" in plan(spark, name)


@pytest.mark.parametrize("name", ["matched_documents", "built_news", "extractive_summary"])
def test_texts_stay_in_their_row(spark, name):
    assert "Exchange" not in plan(spark, name).split("Scan parquet")[0].replace("BroadcastExchange", "")


def test_counts_are_combined_before_the_cve_join(spark):
    text = plan(spark, "group_technique_counts")
    joins = text.index("p_partkey")
    assert text.count("partial_count") >= 1 and "partial_sum" in text[:joins]


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(l_suppkey), IsNotNull(l_partkey)]" in plan(spark, "group_technique_counts")
