"""Text vectors, chunk pooling, extractive summaries and the hook for user models."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tidewatch.functions import batches
from tidewatch.functions import text as T
from tidewatch.session import written

# Chunk length and step of long-text embedding, in tokens (fixed values).
CHUNK_TOKENS = 510
CHUNK_STRIDE = 256

# Words whose weights are sent to the tasks at most, some 200 bytes each in a worker (fixed value).
SENT_WORDS = 200_000

# Length of a summary, in words (fixed values).
SUMMARY_MIN_WORDS = 30
SUMMARY_MAX_WORDS = 130


_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits of one text, the same as the words of a column."""
    return _WORD.findall((text or "").lower())


def _words(texts: DataFrame, text_col: str) -> Column:
    """The words of a text column, or the tokens that the column holds already."""
    held = isinstance(texts.schema[text_col].dataType, ArrayType)
    return F.col(text_col) if held else T.words(F.col(text_col))


def _filled(texts: DataFrame, text_col: str) -> Column:
    held = isinstance(texts.schema[text_col].dataType, ArrayType)
    return F.size(text_col) > 0 if held else ~T.is_blank(F.col(text_col))


def word_weights(texts: DataFrame, text_col: str) -> DataFrame:
    """``word, idf`` of every word of the texts: ``ln((texts + 1) / (texts with the word + 1))``.

    The column holds texts, or arrays of tokens that take the place of words. Blank texts do not count. The table has a row for each distinct word and is written,
    as it is read several times.
    """
    usable = texts.select(text_col).filter(_filled(texts, text_col))
    # An empty word per text counts the texts in the same pass; no real word is empty.
    found = F.array_append(F.array_distinct(_words(texts, text_col)), "")
    counts = written(
        usable.select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    )
    first = counts.filter("word = ''").first()
    total = first["df"] if first else 0
    return counts.filter("word <> ''").select(
        "word", F.log((F.lit(total) + 1) / (F.col("df") + 1)).alias("idf")
    )


def _unit_weights(counted: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, word, weight``: counts ``n`` times idf, scaled to unit length for each of ``keys``."""
    weighed = counted.join(weights, "word").withColumn("_x", F.col("n") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("_x") * F.col("_x")).over(Window.partitionBy(*keys)))
    return (
        weighed.filter(F.col("_x") != 0)
        .withColumn("weight", F.col("_x") / length)
        .select(*keys, "word", "weight")
    )


def _repeated(rows: DataFrame, id_col: str) -> DataFrame | None:
    """The ids that several rows have, null among them, as ``_id``; nothing if there are none."""
    counted = rows.groupBy(id_col).agg(F.count("*").alias("_n")).where("_n > 1")
    found = written(counted.select(F.col(id_col).alias("_id")))
    return None if found.isEmpty() else found


def _sent(weights: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The weights of the most frequent words, ``most`` at most, and of all others, if there are any.

    A frequent word has a small idf. Words are counted by steps of it, so that no order over all of them is needed.
    """
    usable = weights.select("word", "idf").where("word IS NOT NULL AND idf IS NOT NULL")
    step = F.floor(F.least(F.greatest(F.col("idf"), F.lit(-100.0)), F.lit(100.0)) * 100)
    total, bound = 0, None
    for row in usable.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy("step").collect():
        total += row["n"]
        if total > most:
            bound = row["step"]
            break
    if bound is None:
        return usable, None
    return usable.where(step < bound), usable.where(step >= bound)


def _in_row(
    rows: DataFrame, weights: DataFrame, id_col: str, words: Column, size: int | None, stride: int | None, sent_words: int
) -> DataFrame:
    """``id, word, weight`` of ``rows`` of different ids: the mean vector of a row's chunks of ``words``.

    Without a size the row is one chunk. The weights of frequent words are sent to the tasks; those of the
    others come to their row by a join, which only words that were not sent take part in.
    """
    frequent, others = _sent(weights, sent_words)
    table = frequent.toArrow()
    known = dict(zip(table["word"].to_pylist(), table["idf"].to_pylist()))
    shared = rows.sparkSession.sparkContext.broadcast(known)
    columns = [words]
    if others is not None:
        distinct = rows.select(id_col, F.explode(F.array_distinct(words)).alias("word"))
        joined = distinct.join(F.broadcast(frequent.select("word")), "word", "left_anti").join(others, "word")
        own = joined.groupBy(F.col(id_col).alias("_id")).agg(F.collect_list(F.struct("word", "idf")).alias("_own"))
        # A text is smaller than its words, which are made behind the join.
        rows = rows.join(own, F.col(id_col).eqNullSafe(F.col("_id")), "left")
        columns += [F.col("_own.word"), F.col("_own.idf")]

    def weigh(found_words: list, own_words: list | None = None, own_idf: list | None = None) -> list[list[tuple]]:
        sent, out = shared.value, []
        for i, row in enumerate(found_words):
            row = row or []
            own = dict(zip(own_words[i], own_idf[i])) if own_words and own_words[i] else {}
            starts = range(0, len(row), stride) if size else [0]
            mean: dict[str, float] = {}
            for start in starts:
                found = {}
                for word, n in Counter(row[start : start + size] if size else row).items():
                    idf = sent.get(word) or own.get(word)
                    if idf:
                        found[word] = n * idf
                length = math.sqrt(sum(x * x for x in found.values()))
                for word, x in found.items():
                    mean[word] = mean.get(word, 0.0) + x / length
            out.append([(word, x / len(starts)) for word, x in mean.items()])
        return out

    kind = pa.list_(pa.struct([("word", pa.string()), ("weight", pa.float64())]))
    vectors = batches.by_parts(lambda: weigh, "array<struct<word:string,weight:double>>", kind, *columns)
    return rows.select(id_col, F.inline(vectors))


def embed(
    texts: DataFrame, weights: DataFrame, id_col: str, text_col: str, sent_words: int = SENT_WORDS
) -> DataFrame:
    """``id, word, weight``: the unit-length TF-IDF vector of each text, a row for each word in it.

    No word is left out or merged, so a vector is as long as the text has weighted words. Texts
    of the same id are one text. ``weights`` (``word, idf``) has a word once. A text of an id of its own is weighed
    in its row, which is not shuffled; only texts of ids that repeat are dealt by id.
    """
    rows = texts.select(id_col, text_col)
    repeated = _repeated(rows, id_col)
    if repeated is None:
        single = rows
    else:
        same = F.col(id_col).eqNullSafe(F.col("_id"))
        single, rows = rows.join(repeated, same, "left_anti"), rows.join(repeated, same, "left_semi")
    found = _in_row(single, weights, id_col, T.words(F.col(text_col)), None, None, sent_words)
    if repeated is None:
        return found
    # Dealt by id first: a text is smaller than its words, and counting them needs no other shuffle.
    dealt = rows.repartition(F.col(id_col))
    counted = (
        dealt.select(id_col, F.explode(T.words(F.col(text_col))).alias("word"))
        .groupBy(id_col, "word")
        .agg(F.count("*").alias("n"))
    )
    return found.unionByName(_unit_weights(counted, weights, [id_col]))


def chunks(words: Column, size: int = CHUNK_TOKENS, stride: int = CHUNK_STRIDE) -> Column:
    """Windows of ``size`` words from every ``stride``-th start; short tails are windows too."""
    starts = F.sequence(F.lit(0), F.size(words) - 1, F.lit(stride))
    return F.when(
        F.size(words) > 0, F.transform(starts, lambda i: F.slice(words, i + 1, F.lit(size)))
    )


def embed_long_texts(
    texts: DataFrame,
    weights: DataFrame,
    id_col: str,
    text_col: str,
    size: int = CHUNK_TOKENS,
    stride: int = CHUNK_STRIDE,
    sent_words: int = SENT_WORDS,
) -> DataFrame:
    """``id, word, weight``: the mean of the chunk vectors of the whole text; blank text gives no row.

    A chunk is of words, or of tokens if the column holds arrays of them. ``weights`` (``word, idf``) has a word
    once. A text of an id of its own is weighed in its row; only texts of ids that repeat are dealt by id.
    """
    usable = texts.select(id_col, text_col).filter(_filled(texts, text_col))
    repeated = _repeated(usable, id_col)
    if repeated is None:
        single = usable
    else:
        same = F.col(id_col).eqNullSafe(F.col("_id"))
        single, usable = usable.join(repeated, same, "left_anti"), usable.join(repeated, same, "left_semi")
    means = _in_row(single, weights, id_col, _words(texts, text_col), size, stride, sent_words)
    if repeated is None:
        return means
    # Words are a column of their own, or every chunk would split the text again.
    dealt = usable.repartition(F.col(id_col))
    split = dealt.select(id_col, _words(texts, text_col).alias("_all"))
    parts = split.select(
        id_col,
        F.ceil(F.size("_all") / stride).alias("_chunks"),
        F.posexplode(chunks(F.col("_all"), size, stride)).alias("_chunk", "_words"),
    )
    counted = (
        parts.select(id_col, "_chunks", "_chunk", F.explode("_words").alias("word"))
        .groupBy(id_col, "_chunks", "_chunk", "word")
        .agg(F.count("*").alias("n"))
    )
    units = _unit_weights(counted, weights, [id_col, "_chunks", "_chunk"])
    pooled = units.groupBy(id_col, "word").agg(
        (F.sum("weight") / F.max("_chunks")).alias("weight")
    )
    return means.unionByName(pooled)


_SENTENCE_END = re.compile(r"([.!?])[ \t\n\x0b\f\r]+")


def best_sentences(text: str | None, min_words: int, max_words: int) -> str:
    """The best sentences of one text, in text order, within the word budget."""
    parts = (x.strip(" ") for x in re.split(r"\n+", _SENTENCE_END.sub(r"\1\n", text or "")))
    found = [x for x in parts if x]
    words = [words_of(x) for x in found]
    counts = Counter(w for sentence in words for w in sentence)
    scores = {
        i: sum(counts[w] for w in sentence if len(w) > 3) / len(sentence)
        for i, sentence in enumerate(words)
        if sentence
    }
    taken, chosen = 0, []
    for i in sorted(scores, key=lambda i: (-scores[i], i)):
        if taken + len(words[i]) <= max_words or taken < min_words:
            chosen.append(i)
        taken += len(words[i])
    return " ".join(found[i] for i in sorted(chosen))


def summary(
    text: Column, min_words: int = SUMMARY_MIN_WORDS, max_words: int = SUMMARY_MAX_WORDS
) -> Column:
    """The best sentences of a text, in text order, within the word budget.

    A sentence scores the mean count, in its own text, of its words of four
    letters or more. The whole text takes part. Only the text column passes to
    the Python workers, in parts of Arrow batches, and the row stays where it is. Blank text gives ``""``.
    """

    def summarize(texts: list[str | None]) -> list[str]:
        return [best_sentences(t, min_words, max_words) for t in texts]

    return batches.by_parts(lambda: summarize, "string", pa.string(), text)


ModelFn = Callable[[Iterable[pd.DataFrame]], Iterable[pd.DataFrame]]


def apply_model(df: DataFrame, model_fn: ModelFn, schema: str) -> DataFrame:
    """Run a user's text model over pandas batches (an embedder, summarizer or translator)."""
    return df.mapInPandas(model_fn, schema)


def keep_failed(model_fn: ModelFn) -> ModelFn:
    """``model_fn`` that hands a row on unchanged when it raises, as the rows are tried alone."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                yield pd.concat(list(model_fn(iter([batch]))))
            except Exception:
                for i in range(len(batch)):
                    row = batch.iloc[i : i + 1]
                    try:
                        yield pd.concat(list(model_fn(iter([row]))))
                    except Exception:
                        yield row

    return run


def transform_source(
    articles: DataFrame, source: str, model_fn: ModelFn, columns: tuple[str, ...] = ("title", "content")
) -> DataFrame:
    """Rewrite the text columns of one source; blank and failed texts keep the original.

    ``model_fn`` maps an iterator of pandas frames to an iterator of frames of
    the same shape. Other sources never reach Python.
    """
    mine = F.coalesce(F.col("source") == source, F.lit(False)) & ~T.is_blank(
        F.concat_ws("", *columns)
    )
    changed = apply_model(articles.filter(mine), keep_failed(model_fn), _ddl(articles))
    restored = changed.select(*articles.columns)
    return articles.filter(~mine).unionByName(restored)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)
