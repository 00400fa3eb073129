"""Repeated spans against all windows compared in Python."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from tests.llm.conftest import ODD
from tidewatch.llm import debruijn

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


def later_windows(docs, window):
    """Per document the places of its windows that a document of smaller id has, and where that has them first."""
    first = {}
    for doc, text in sorted((d for d in docs if d[0] is not None), key=lambda d: d[0]):
        words = WORD.findall(text or "")
        for i in range(len(words) - window + 1):
            first.setdefault(tuple(words[i : i + window]), doc)
    out = []
    for doc, text in docs:
        words = WORD.findall(text or "")
        sources = [first.get(tuple(words[i : i + window])) for i in range(len(words) - window + 1)]
        out.append({i for i, s in enumerate(sources) if s is not None and (doc is None or s < doc)})
    return out


def expected(docs, window=13):
    out = []
    for (doc, text), places in zip(docs, later_windows(docs, window)):
        words = WORD.findall(text or "")
        gone = {i + k for i in places for k in range(window)}
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def drawn(seed, count, passages, vocabulary):
    """Texts of few words, with passages and copies, so that windows repeat in all ways."""
    draw = random.Random(seed)
    held = [[draw.choice(vocabulary) for _ in range(draw.randint(5, 40))] for _ in range(passages)]
    docs = []
    for doc in range(count):
        words = []
        for _ in range(draw.randint(0, 6)):
            words += draw.choice(held) if draw.random() < 0.6 else [draw.choice(vocabulary) for _ in range(draw.randint(1, 20))]
            if draw.random() < 0.1:
                words += ["again"] * draw.randint(5, 60)
        text = "".join(w + draw.choice([" ", "  ", "\t", "\n", "\x0b "]) for w in words)
        docs.append((draw.choice([doc, doc, doc, None]), text))
    return docs


@pytest.mark.parametrize("hot_windows", [20_000, 0, 30])
@pytest.mark.parametrize("window", [13, 3])
def test_removals_equal_all_windows(spark, window, hot_windows):
    docs = drawn(7, 80, 6, [f"w{i}" for i in range(40)] + ["é", "ÀB", "日本", " x", "\x1c"])
    frame = spark.createDataFrame(docs, SCHEMA)
    assert found(debruijn.removals(frame, window=window, hot_windows=hot_windows)) == expected(docs, window)


def test_spans_and_paths(spark):
    docs = [(i, t) for i, t in drawn(3, 60, 5, [f"w{i}" for i in range(30)]) if i is not None]
    table = debruijn.spans(spark.createDataFrame(docs, SCHEMA))
    words = {d: WORD.findall(t) for d, t in docs}
    covered = {d: set() for d in words}
    spans = table.collect()
    for s in spans:
        size = s["windows"] + 12
        assert s["source_doc"] < s["doc"]
        assert words[s["doc"]][s["first"] : s["first"] + size] == words[s["source_doc"]][s["source_first"] : s["source_first"] + size]
        mine = set(range(s["first"], s["first"] + s["windows"]))
        assert not mine & covered[s["doc"]]
        covered[s["doc"]] |= mine
    assert [covered[d] for d, _ in docs] == later_windows(docs, 13)
    # Every window of a source is as often on a path as spans hold it, and no span ends inside a path.
    holds = {}
    for s in spans:
        for i in range(s["windows"]):
            key = (s["source_doc"], s["source_first"] + i)
            holds[key] = holds.get(key, 0) + 1
    paths = debruijn.paths(table).collect()
    assert holds == {(p["source_doc"], p["first"] + i): p["spans"] for p in paths for i in range(p["windows"])}
    cuts = {(s["source_doc"], p) for s in spans for p in (s["source_first"], s["source_first"] + s["windows"])}
    assert not any((p["source_doc"], p["first"] + i) in cuts for p in paths for i in range(1, p["windows"]))


def test_texts_are_cut(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = [(1, f"a\n{passage}  b"), (2, f"c  d\n{passage} e"), (3, "c  d\nkept as it  is"), (4, passage)]
    frame = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "'x' AS doc", "5 AS first", "'y' AS text_hash")
    got = {r["doc_id"]: r["text"] for r in debruijn.without_repeats(frame).collect()}
    assert got == {1: docs[0][1], 2: "c d e", 3: docs[2][1], 4: ""}


def test_odd_rows(spark, odd, none, clash):
    # Rows of one id are not compared with each other; the long text repeats only itself.
    docs = [(r[0], r[1]) for r in ODD]
    for frame in (odd, clash):
        assert found(debruijn.removals(frame)) == expected(docs)
    assert debruijn.removals(none).count() == 0 and debruijn.paths(debruijn.spans(none)).count() == 0
    assert debruijn.without_repeats(clash).columns == clash.columns


def test_string_ids(spark):
    text = " ".join(map(str, range(30)))
    frame = spark.createDataFrame([("b", text), ("a", text), ("c", "x " + text)], "doc_id string, text string")
    got = {r["doc_id"]: r["n_removed"] for r in debruijn.removals(frame).collect()}
    assert got == {"a": 0, "b": 30, "c": 30}


def test_hashes_of_windows():
    words = [b" ".join(b"w%d" % i for i in range(20))] * 2
    (_, _, numbers), *_ = debruijn.words_of_all(words, debruijn.UNSPACED)
    text, place, edge, least = debruijn._windows(numbers, 13)
    assert text.tolist() == [0] * 8 + [1] * 8 and place.tolist() == list(range(8)) * 2
    assert np.array_equal(edge[:8], edge[8:]) and np.array_equal(least[:8], least[8:]) and len(set(edge.tolist())) == 8
