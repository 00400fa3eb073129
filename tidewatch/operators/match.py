"""Nearest technique of each text by cosine similarity."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import text as T
from tidewatch.operators import blocks, dedupe, features, neighbours
from tidewatch.operators.features import words_of
from tidewatch.session import written


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1, norms)


def _best(batch: pd.DataFrame, matrix: np.ndarray, info: pd.DataFrame) -> pd.DataFrame:
    order = np.argsort(info["ordinal"].to_numpy(), kind="stable")
    scores = unit_rows(blocks.stack(batch["vector"])) @ unit_rows(matrix[order]).T
    best = scores.argmax(axis=1)
    return pd.DataFrame(
        {
            "text_id": batch["text_id"].to_numpy(),
            "ordinal": info["ordinal"].to_numpy()[order][best],
            "score": scores[np.arange(len(best)), best],
        }
    )


def nearest(
    texts: DataFrame,
    techniques: DataFrame,
    dims: int,
    broadcast_elements: int = blocks.BROADCAST_ELEMENTS,
    rows_per_block: int = blocks.ROWS_PER_BLOCK,
) -> DataFrame:
    """``text_id, ordinal, score`` of the most similar technique; the lowest ordinal wins ties.

    ``texts`` holds ``text_id, vector``; ``techniques`` holds ``ordinal, vector``.
    Rows without a vector give no result. Equal technique vectors are reduced to
    the first, so that rounding cannot decide between them. Techniques of up to ``broadcast_elements`` numbers
    are sent to all tasks; more are dealt to blocks, of which a text meets only those that can hold a
    technique as near as one it has met.
    """
    id_type = dict(texts.dtypes)["text_id"]
    usable = dedupe.keep_first(
        techniques.filter(F.col("vector").isNotNull()).select(F.col("ordinal").cast("long"), "vector"),
        ["vector"],
        [F.col("ordinal")],
    )
    schema = f"text_id {id_type}, ordinal long, score double"
    most = max(1, broadcast_elements // max(1, dims))
    if usable.limit(most + 1).count() <= most:
        return blocks.against_broadcast(texts.select("text_id", "vector"), usable, _best, schema)
    found = neighbours.search(
        texts.select(F.col("text_id").alias("id"), "vector"),
        written(usable).select(F.col("ordinal").alias("id"), "vector"),
        1,
        neighbours.chord,
        rows_per_block=rows_per_block,
    ).nearest
    # The chord of two directions and their cosine.
    score = 1 - F.col("distance") * F.col("distance") / 2
    return found.select(F.col("id").alias("text_id"), F.col("neighbour").alias("ordinal"), score.alias("score"))


# Technique postings (word, technique, weight) up to this number are sent whole to the
# executors, some 40 bytes each; more are joined by word.
BROADCAST_POSTINGS = 2_000_000

_MATCH = "struct<id:string,name:string,score:double>"


def postings(techniques: DataFrame) -> DataFrame:
    """``ordinal, word, weight, idf`` of all words of ``techniques(ordinal, text)``, written.

    The words' weights come from the techniques themselves: other words cannot add to a similarity. Each is one
    more than the usual, so that a word of all techniques still counts and a single technique can be found.
    """
    weights = features.word_weights(techniques, "text").withColumn("idf", F.col("idf") + 1)
    units = features.embed(techniques, weights, "ordinal", "text")
    return written(units.join(weights, "word").select("ordinal", "word", "weight", "idf"))


def with_match(
    texts: DataFrame,
    text_col: str,
    techniques: DataFrame,
    broadcast_postings: int = BROADCAST_POSTINGS,
) -> DataFrame:
    """``texts`` with ``mitre_match``: the technique of the most similar words, null without a common one.

    ``techniques`` holds ``ordinal, technique_id, technique_name, text``; scores that are equal to nine digits
    go to the lowest ordinal. Up to a number of postings they are sent to the tasks and each text is
    matched in its row, so repeated and null ids keep their rows and nothing is shuffled. Beyond it
    the texts' words are joined to the postings.
    """
    table = postings(techniques)
    known = techniques.select("ordinal", "technique_id", "technique_name")
    if table.count() <= broadcast_postings:
        return _matched_in_row(texts, text_col, table, known)
    return _matched_by_word(texts, text_col, table, known)


def _matched_in_row(texts: DataFrame, text_col: str, table: DataFrame, known: DataFrame) -> DataFrame:
    rows = table.toPandas().sort_values(["word", "ordinal"], kind="stable")
    used = known.join(table.select("ordinal").distinct(), "ordinal", "left_semi")
    names = {r["ordinal"]: (r["technique_id"], r["technique_name"]) for r in used.collect()}
    ordinals = np.unique(rows["ordinal"].to_numpy(dtype=np.int64))
    place = np.searchsorted(ordinals, rows["ordinal"].to_numpy(dtype=np.int64))
    words, first = np.unique(rows["word"].to_numpy(dtype=object), return_index=True)
    cuts = np.append(first, len(rows)).tolist()
    index = {w: k for k, w in enumerate(words)}
    shared = texts.sparkSession.sparkContext.broadcast(
        (index, cuts, place, rows["weight"].to_numpy(), rows["idf"].to_numpy(), [names[o] for o in ordinals.tolist()])
    )

    @F.pandas_udf(_MATCH)
    def best(found: pd.Series) -> pd.DataFrame:
        index, cuts, place, weight, idf, names = shared.value
        out = []
        for text in found:
            counts = Counter(index[w] for w in words_of(text) if w in index)
            scores = np.zeros(len(names))
            square = 0.0
            for k, n in counts.items():
                start, end = cuts[k], cuts[k + 1]
                x = n * idf[start]
                square += x * x
                scores[place[start:end]] += x * weight[start:end]
            if square == 0:
                out.append((None, None, None))
                continue
            scores /= np.sqrt(square)
            top = int(np.round(scores, 9).argmax())
            out.append((*names[top], float(scores[top])))
        return pd.DataFrame(out, columns=["id", "name", "score"])

    named = texts.withColumn("mitre_match", best(F.col(text_col)))
    return named.withColumn(
        "mitre_match", F.when(F.col("mitre_match.score").isNotNull(), F.col("mitre_match"))
    )


def _matched_by_word(texts: DataFrame, text_col: str, table: DataFrame, known: DataFrame) -> DataFrame:
    # The rows are read twice and must keep their numbers.
    numbered = written(texts.withColumn("_row", F.monotonically_increasing_id()))
    counted = (
        numbered.select("_row", F.explode(T.words(F.col(text_col))).alias("word"))
        .groupBy("_row", "word")
        .agg(F.count("*").alias("n"))
    )
    idf = table.select("word", "idf").distinct()
    length = counted.join(idf, "word").groupBy("_row").agg(
        F.sqrt(F.sum((F.col("n") * F.col("idf")) ** 2)).alias("_length")
    )
    scores = (
        counted.join(table, "word")
        .groupBy("_row", "ordinal")
        .agg(F.sum(F.col("n") * F.col("idf") * F.col("weight")).alias("x"))
        .join(length, "_row")
        .select("_row", "ordinal", (F.col("x") / F.col("_length")).alias("score"))
    )
    best = scores.groupBy("_row").agg(
        F.max(F.struct(F.round("score", 9), (-F.col("ordinal")).alias("o"), "score")).alias("b")
    ).select("_row", "b.score", (-F.col("b.o")).alias("ordinal"))
    named = best.join(known, "ordinal").select(
        "_row",
        F.struct(
            F.col("technique_id").alias("id"), F.col("technique_name").alias("name"), "score"
        ).alias("mitre_match"),
    )
    return numbered.join(named, "_row", "left").drop("_row")


def flatten_match(rows: DataFrame) -> DataFrame:
    """``rows`` with ``technique_id`` and ``similarity`` columns in place of ``mitre_match``."""
    return rows.withColumns(
        {"technique_id": F.col("mitre_match.id"), "similarity": F.col("mitre_match.score")}
    ).drop("mitre_match")
