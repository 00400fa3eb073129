"""Splits and verdicts by plain versions of their rules; packing by a plain lowest-cost rule; other tokenizers."""

from __future__ import annotations

import collections
import math
import os
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import SF_DIR
from tidewatch.llm import packing, queries, urls

# --- Urls ------------------------------------------------------------------------------------


def plain_split(label, known, total):
    """All starts of the last word tried at every place."""
    best = [(0.0, [])]
    for end in range(1, len(label) + 1):
        options = []
        for start in range(end):
            piece = label[start:end]
            n = known.get(piece)
            chance = math.log(n / total) if n else -math.log(total + 1.0) - 2.303 * len(piece)
            options.append((best[start][0] + chance, end - start, [*best[start][1], piece]))
        score, _, words = max(options, key=lambda x: (round(x[0], 9), x[1]))
        best.append((score, words))
    return best[-1]


def score_of(words, known, total):
    return sum(math.log(known[w] / total) if w in known else -math.log(total + 1.0) - 2.303 * len(w) for w in words)


def test_splits_are_the_most_probable():
    draw = random.Random(6)
    for _ in range(300):
        known = {"".join(draw.choice("ab") for _ in range(draw.randint(1, 6))): draw.randint(1, 90) for _ in range(6)}
        known |= {"abcabcabcabcabcabcabcabcabcabc": 5}
        total = sum(known.values())
        label = "".join(draw.choice([*known, "a", "b", "c"]) for _ in range(draw.randint(0, 6)))
        found = urls.best_split(label, known, total)
        assert "".join(found) == label
        assert score_of(found, known, total) == pytest.approx(plain_split(label, known, total)[0])


def test_long_words_and_labels_are_split(spark):
    long = "donaudampfschifffahrtsgesellschaft"
    counts = spark.createDataFrame([("cheap", 50), (long, 500), ("don", 9), ("au", 9), ("dampf", 9)], "word string, n long")
    many = "cheap" * 40
    labels = spark.createDataFrame([("cheap" + long,), (many,), ("z" * 3_000,)], "label string")
    got = {r["label"]: r["words"] for r in urls.segmented(labels, counts).collect()}
    assert got["cheap" + long] == ["cheap", long]
    assert got[many] == ["cheap"] * 40 and got["z" * 3_000] == ["z" * 3_000]


def test_verdicts_equal_a_plain_naive_bayes(spark):
    pages = pd.read_parquet(f"{SF_DIR}/pages.parquet")
    got = queries.QUERIES["op9_urls"](spark, SF_DIR).toPandas().set_index("page_id")
    known = collections.Counter()
    for html in pages["html"]:
        known.update(w for w in re.findall(r"[^\W\d_]+", re.sub(r"<[^>]*>", " ", html or "").lower()))
    total = sum(known.values())

    def tokens(host, path):
        words = [w for label in re.findall(r"[^\W\d_]+", host) for w in urls.best_split(label, known, total)]
        return ["h:" + w for w in words] + ["p:" + w for w in re.findall(r"[^\W_]+", path.lower())]

    rows = [(p, r["host"], r["path"], r["rule"], r["verdict"]) for p, r in got.iterrows()]
    seen = {"block": collections.Counter(), "allow": collections.Counter()}
    urls_of = collections.Counter()
    for _, host, path, rule, verdict in rows:
        if rule is not None:
            urls_of[verdict] += 1
            seen[verdict].update(tokens(host, path))
    words = set(seen["block"]) | set(seen["allow"])
    size = {v: sum(c.values()) + len(words) or 1 for v, c in seen.items()}
    prior = math.log((urls_of["block"] + 1) / (urls_of["allow"] + 1))
    for page, host, path, rule, verdict in rows:
        odds = prior + sum(
            math.log((seen["block"][t] + 1) / (seen["allow"][t] + 1)) + math.log(size["allow"] / size["block"])
            for t in tokens(host, path) if t in words
        )
        assert got.loc[page, "log_odds"] == pytest.approx(odds, abs=1e-6)
        if rule is None and abs(odds) > 1e-6:
            assert verdict == ("block" if odds > 0 else "allow")


# --- Packing ---------------------------------------------------------------------------------


def test_documents_go_to_the_cheapest_sequence_with_room():
    draw = random.Random(3)
    for _ in range(100):
        lengths = [draw.randint(1, 40) for _ in range(draw.randint(1, 30))]
        length = 32
        pieces = packing.pack(lengths, length)
        sizes = packing.powers(sum(lengths), length)
        room, cost = sizes.copy(), [0.0] * len(sizes)
        waiting = sorted([(-min(n - s, length), d, s) for d, n in enumerate(lengths) for s in range(0, n, length)])
        for p in pieces:
            negative, doc, start = waiting.pop(0)
            assert (p.doc, p.start) == (doc, start)
            fitting = [k for k in range(len(sizes)) if room[k] >= -negative]
            if fitting:
                assert p.length == -negative and p.sequence == min(fitting, key=lambda k: (cost[k], k))
            else:
                # Cut to fill the roomiest.
                assert p.length == room[p.sequence] == max(room)
                waiting = sorted([*waiting, (negative + p.length, doc, start + p.length)])
            room[p.sequence] -= p.length
            cost[p.sequence] += p.length + p.length**2 / 1_024
        assert not waiting


def test_other_tokenizers_encode_texts_whole(spark, docs, texts):
    path = os.path.join(os.path.dirname(queries.tokenizer_path()), "byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    assert packing.Encoder(queries.tokenizer_path()).cuts and not packing.Encoder(path).cuts
    found = packing.packed(docs.limit(20), path, with_ids=True).toPandas()
    of = dict(zip(texts["doc_id"], texts["text"]))
    for doc, rows in found.groupby("doc_id"):
        ids = np.concatenate(rows.sort_values("start")["ids"].tolist())
        assert ids[:-1].tolist() == tokenizer.encode(of[doc], add_special_tokens=False).ids and ids[-1] == 1
    assert all(zlib.crc32(np.array(i, dtype="<u4").tobytes()) == c for i, c in zip(found["ids"], found["ids_crc32"]))
