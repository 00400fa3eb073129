"""Line removal with ids of other types, blanks that are no words, and a full set of fingerprints."""

from __future__ import annotations

import pytest

from tidewatch.llm import lines

LINES = [f"line {i} has some words in it" for i in range(12)]


def test_string_ids_and_rows_without_one(spark):
    text = "\n".join(LINES)
    rows = [("b", text), ("a", text), (None, "first\n" + text), (None, None), ("c", "")]
    found = spark.createDataFrame(rows, "doc_id string, text string")
    got = [(r["doc_id"], r["text"]) for r in lines.without_repeats(found).collect()]
    assert sorted(got, key=str) == sorted([("a", text), ("b", ""), (None, "first\n"), (None, None), ("c", "")], key=str)


def test_blanks_are_no_words(spark):
    rows = [(i, f"only {i}\nx" + " " * 40 + "y") for i in (1, 2)]
    found = lines.repeated_runs(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [(r["words"], r["runs"]) for r in found.collect()] == [([2, 2], [])] * 2


@pytest.mark.parametrize("bits", [64, 1 << 20])
def test_a_full_filter_loses_nothing(spark, monkeypatch, bits):
    monkeypatch.setattr(lines, "FILTER_BITS", bits)
    rows = [(d, "\n".join(LINES[(d * k) % 12] if k % 5 else f"own {d} {k} of words and more words" for k in range(30))) for d in range(1, 20)]
    rows += [(50, "\n".join(LINES[:6])), (51, "\n".join(["start", *LINES[:6], "end"])), (52, "\n".join(LINES[2:4]))]
    found = lines.repeated_runs(spark.createDataFrame(rows, "doc_id long, text string"), least_words=25)
    got = {r["doc_id"]: [(x["first"], x["last"]) for x in r["runs"]] for r in found.collect()}
    assert got[51] == [(1, 6)] and got[52] == []
