"""Texts as subword tokens, against another implementation."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

from tidewatch.operators import features, subwords

PIECES = "a b c ab abc cab ##a ##b ##ab ##bc ##abc ##c1 1 . ! é ##é zu ##zu ##g".split()


def tokenized(texts):
    tokenizer = Tokenizer(
        models.WordPiece({p: i for i, p in enumerate([*PIECES, subwords.UNKNOWN])}, unk_token=subwords.UNKNOWN)
    )
    tokenizer.normalizer = normalizers.Lowercase()
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [
            pre_tokenizers.WhitespaceSplit(),
            pre_tokenizers.Split(Regex(r"[^\p{L}\p{N}]"), "isolated"),
        ]
    )
    return [tokenizer.encode(t or "").tokens for t in texts]


def texts():
    draw = random.Random(7)
    made = [
        "".join(draw.choice("abcABCzug1é.! \n") for _ in range(draw.randrange(60))) for _ in range(300)
    ]
    return [*made, None, "", "  ", "abc" * 33 + "a", "abc" * 34, "ab " * 5000, "日本", made[0]]


@pytest.mark.parametrize("limit", [subwords.BROADCAST_PIECES, 0])
def test_both_ways_cut_as_another_tokenizer(spark, limit):
    rows = texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id int, text string")
    vocabulary = spark.createDataFrame([(p,) for p in [*PIECES, None, "", "ab"]], "piece string")
    got = subwords.with_tokens(df, "text", vocabulary, broadcast_pieces=limit).orderBy("id").collect()
    assert [r["tokens"] for r in got] == tokenized(rows)


@pytest.mark.parametrize("limit", [subwords.BROADCAST_PIECES, -1])
def test_without_a_vocabulary_every_word_is_unknown(spark, limit):
    df = spark.createDataFrame([(None, "ab c"), (None, "ab c"), (1, None)], "id int, text string")
    empty = spark.createDataFrame([], "piece string")
    got = subwords.with_tokens(df, "text", empty, broadcast_pieces=limit).collect()
    assert sorted(r["tokens"] for r in got) == [[], [subwords.UNKNOWN] * 2, [subwords.UNKNOWN] * 2]


def test_windows_count_tokens(spark):
    df = spark.createDataFrame([("abab " * 300,)], "text string")
    vocabulary = spark.createDataFrame([("ab",), ("##ab",)], "piece string")
    cut = subwords.with_tokens(df, "text", vocabulary)
    sizes = cut.select(F.transform(features.chunks(F.col("tokens")), F.size).alias("n")).first()["n"]
    assert sizes == [510, 344, 88]


def test_an_empty_table_has_no_rows(spark):
    df = spark.createDataFrame([], "id int, text string")
    vocabulary = spark.createDataFrame([("a",)], "piece string")
    for limit in (subwords.BROADCAST_PIECES, 0):
        assert subwords.with_tokens(df, "text", vocabulary, broadcast_pieces=limit).count() == 0
