"""The pipeline's stages, each on what the one before kept."""

from __future__ import annotations

import re

import pandas as pd

import corpus_pipeline
from tests.llm.conftest import ODD, SF_DIR, lower
from tests.llm.test_operators import ALNUM, brute_print, linked
from tidewatch.session import written


def test_stages(spark, docs):
    frame, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before, frame = frame, written(stage(spark, frame, SF_DIR))
        seen[name] = before.toPandas(), frame.toPandas()
        if name != "packing":
            assert frame.columns == docs.columns
    before, after = seen["language"]
    assert set(before["doc_id"]) - set(after["doc_id"]) == {
        d for d, t in zip(before["doc_id"], before["text"]) if not re.search(r"[^\W\d_]", t or "")
    }
    before, after = seen["line_dedup"]
    assert sorted(before["doc_id"]) == sorted(after["doc_id"])
    assert after["n_chars"].tolist() == after["text"].str.len().tolist()
    before, after = seen["simhash"]
    before = before.sort_values("doc_id")
    first = linked([brute_print(t) for t in before["text"]], 2)
    assert sorted(after["doc_id"]) == [d for k, d in enumerate(before["doc_id"]) if first[k] == k]
    before, after = seen["decontamination"]
    items = pd.read_parquet(f"{SF_DIR}/benchmark.parquet")
    windows = {tuple(w[k : k + 10]) for w in map(ALNUM.findall, map(lower, items["text"])) for k in range(len(w) - 9)}
    clean = [
        d for d, t in zip(before["doc_id"], before["text"])
        if not any(tuple(w[k : k + 10]) in windows for w in [ALNUM.findall(lower(t))] for k in range(len(w) - 9))
    ]
    assert sorted(after["doc_id"]) == sorted(clean)
    before, after = seen["packing"]
    assert set(before["doc_id"]) == set(after["doc_id"])


def test_run_equals_the_stages(spark, docs):
    assert corpus_pipeline.run(spark, SF_DIR).select("doc_id").distinct().count() > 100


def test_odd_rows(spark, odd, none):
    for frame in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            frame = written(stage(spark, frame, SF_DIR))
    frame = written(corpus_pipeline.keep_known_languages(spark, odd, SF_DIR))
    assert frame.count() == sum(any(c.isalpha() for c in r[1] or "") for r in ODD)
