"""Texts as the subword tokens of a model's vocabulary, by the longest piece that fits.

A word is cut from its start: the longest piece of the vocabulary is taken, then the longest continuing piece from
there on. A word that cannot be cut to its end, or is too long, is one unknown token. Windows of a model
(``features.chunks``) and its limits count these tokens, not words.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import batches
from tidewatch.session import written

# Format of such vocabularies (fixed values).
UNKNOWN = "[UNK]"
CONTINUES = "##"
LONGEST_WORD = 100

# Vocabularies of up to so many pieces, some 100 bytes each, are sent to the tasks; words are joined to larger ones.
BROADCAST_PIECES = 500_000

# Words whose pieces a task keeps, some 500 bytes each (fixed value).
KEPT_CUTS = 100_000

_TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, and each other sign that is no blank; none for a null text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TOKEN), F.lit(0))


def with_tokens(
    texts: DataFrame,
    text_col: str,
    vocabulary: DataFrame,
    to: str = "tokens",
    broadcast_pieces: int = BROADCAST_PIECES,
) -> DataFrame:
    """``texts`` with the array ``to`` of the pieces of each text, in text order.

    ``vocabulary`` holds ``piece``; nulls and repeated ones do not count. Up to a number of pieces they are sent to the
    tasks and a text is cut in its row, so nothing is shuffled. Beyond it the distinct words are joined to
    the pieces. Repeated rows and rows without an id stay as they are; a null or blank text has no
    tokens; with an empty vocabulary every word is unknown.
    """
    pieces = vocabulary.select("piece").where("piece <> ''").distinct()
    known = [row["piece"] for row in pieces.limit(broadcast_pieces + 1).collect()]
    if len(known) <= broadcast_pieces:
        return texts.withColumn(to, _in_row(texts, known)(words(F.col(text_col))))
    return _by_word(texts, text_col, pieces, to)


def _in_row(texts: DataFrame, known: list[str]) -> Callable[[Column], Column]:
    longest = max((len(piece) for piece in known), default=0)
    shared = texts.sparkSession.sparkContext.broadcast(frozenset(known))
    unknown, continues, longest_word = UNKNOWN, CONTINUES, LONGEST_WORD

    def cut(word: str, pieces: frozenset[str]) -> list[str]:
        found, at = [], 0
        while at < len(word) <= longest_word:
            mark = continues if at else ""
            ends = range(min(len(word), at + longest), at, -1)
            end = next((end for end in ends if mark + word[at:end] in pieces), None)
            if end is None:
                break
            found.append(mark + word[at:end])
            at = end
        return found if at == len(word) else [unknown]

    most = KEPT_CUTS

    def start() -> Callable[[list[list[str]]], list[list[str]]]:
        # A task's words repeat much, so each is cut once while the cuts are kept.
        cuts: dict[str, list[str]] = {}

        def tokens(rows: list[list[str]]) -> list[list[str]]:
            if len(cuts) > most:
                cuts.clear()
            for word in set().union(*rows).difference(cuts):
                cuts[word] = cut(word, shared.value)
            return [[piece for word in row for piece in cuts[word]] for row in rows]

        return tokens

    return lambda column: batches.by_parts(start, "array<string>", pa.list_(pa.string()), column)


def cut_words(found: DataFrame, pieces: DataFrame) -> DataFrame:
    """``word, pieces`` for the distinct words of ``found(word)``, by joins with ``pieces(piece)``."""
    longest = pieces.agg(F.max(F.length("piece"))).first()[0] or 0
    distinct = found.select("word").distinct()
    size = F.length("word")
    # A substring for each start and length; the longest word and piece bound their number.
    parts = (
        distinct.where(size <= LONGEST_WORD)
        .select("word", F.explode(F.sequence(F.lit(0), size - 1)).alias("at"))
        .select(
            "word",
            "at",
            F.explode(F.sequence(F.lit(1), F.least(F.lit(max(1, longest)), size - F.col("at")))).alias("n"),
        )
        .withColumn(
            "piece",
            F.concat(
                F.when(F.col("at") > 0, CONTINUES).otherwise(""),
                F.substr("word", F.col("at") + 1, F.col("n")),
            ),
        )
    )
    best = parts.join(pieces, "piece").groupBy("word", "at").agg(F.max("n").alias("n"))
    steps = best.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("steps"))
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("at"), none.alias("pieces"))

    def step(done: Column, at: Column) -> Column:
        piece = F.concat(
            F.when(at > 0, CONTINUES).otherwise(""),
            F.substr(F.col("word"), at + 1, F.try_element_at("steps", at)),
        )
        taken = F.struct(
            (at + F.try_element_at("steps", at)).alias("at"), F.array_append(done["pieces"], piece).alias("pieces")
        )
        return F.when((done["at"] == at) & F.map_contains_key("steps", at), taken).otherwise(done)

    walk = F.aggregate(F.sequence(F.lit(0), size - 1), start, step)
    return (
        distinct.join(steps, "word", "left")
        .withColumn("steps", F.coalesce("steps", F.expr("cast(map() as map<int,int>)")))
        .select("word", F.when(size <= LONGEST_WORD, walk).otherwise(start).alias("walk"))
        .select(
            "word",
            F.when(F.col("walk.at") == size, F.col("walk.pieces")).otherwise(F.array(F.lit(UNKNOWN))).alias("pieces"),
        )
    )


def _by_word(texts: DataFrame, text_col: str, pieces: DataFrame, to: str) -> DataFrame:
    # The rows are read twice and must keep their numbers.
    numbered = written(texts.withColumn("_row", F.monotonically_increasing_id()))
    placed = numbered.select("_row", F.posexplode(words(F.col(text_col))).alias("_at", "word"))
    cuts = cut_words(placed, pieces)
    # Words of a text meet in one row again, as its tokens are one array there.
    tokens = (
        placed.join(cuts, "word")
        .groupBy("_row")
        .agg(F.array_sort(F.collect_list(F.struct("_at", "pieces"))).alias("_found"))
        .select("_row", F.flatten("_found.pieces").alias(to))
    )
    none = F.array().cast("array<string>")
    return numbered.drop(to).join(tokens, "_row", "left").withColumn(to, F.coalesce(to, none)).drop("_row")
