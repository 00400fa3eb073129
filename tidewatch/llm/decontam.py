"""Benchmark decontamination by a positional inverted index.

The documents' words that occur in a benchmark are kept as postings, term and position.
A benchmark window asks the index for its rarest term; in the documents that have it the
positions of its terms, each less the term's place in the window, are intersected from
the rarest term on. What is left are the starts of exact occurrences. A near match has the
window's rarest terms within some words of their places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.bytewords import ALPHANUMERIC, lowered, words_of_all
from tidewatch.llm.shared import fresh
from tidewatch.session import written

WINDOW = 10
# Terms that a near match must have, and how far each may stand from its place.
NEAR_TERMS, SLOP = 5, 3
# Bits of the filter of benchmark terms that is sent to all tasks: 4 MB, whatever the
# benchmark's size. A filter that is too full lets more postings through and loses none.
FILTER_BITS = 1 << 25
_BLOCK_BITS = 1 << 16


def windows_of(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """``item, w, place, term``: the terms of each window of the items, one row each.

    An item of fewer words than ``window`` is one window; one without words, or null, has none.
    Equal windows of an item row count once.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [lowered(t) for t in batch["text"]]
            names = batch["item"].tolist()
            for begin, end, words in words_of_all(texts, ALPHANUMERIC):
                for k in range(begin, end):
                    terms = words.numbers[words.first[k - begin] : words.first[k - begin + 1]].view(np.int64)
                    size = min(window, len(terms))
                    if size:
                        runs = np.unique(np.lib.stride_tricks.sliding_window_view(terms, size), axis=0)
                        yield pd.DataFrame(
                            {
                                "item": names[k],
                                "w": np.repeat(np.arange(len(runs)), size),
                                "place": np.tile(np.arange(size, dtype=np.int32), len(runs)),
                                "term": runs.ravel(),
                            }
                        )

    texts = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    found = texts.where("text is not null").mapInPandas(cut, "item string, w long, place int, term long")
    # Rows of one id with other texts have windows of their own.
    return found.withColumn("w", F.xxhash64("item", "w"))


def _filter_of(terms: DataFrame) -> np.ndarray:
    """A bit for every term, gathered in blocks of 65,536 bits; at most ``FILTER_BITS`` in all."""
    bits = np.zeros(FILTER_BITS, dtype=bool)
    bit = F.pmod("term", F.lit(FILTER_BITS))
    blocks = (
        terms.select(F.floor(bit / _BLOCK_BITS).cast("int").alias("block"), (bit % _BLOCK_BITS).cast("int").alias("at"))
        .groupBy("block")
        .agg(F.collect_set("at").alias("at"))
    )
    for row in blocks.toLocalIterator():
        bits[row["block"] * _BLOCK_BITS + np.array(row["at"], dtype=np.int64)] = True
    return np.packbits(bits, bitorder="little")


def index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text_hash, n_words, terms, places`` for each row of ``docs``, written out.

    The two arrays hold a document's postings, by term and then place, for all
    words that are among the benchmark's ``terms`` (or share a bit of the filter with one).
    """
    known = docs.sparkSession.sparkContext.broadcast(_filter_of(terms))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = known.value
        for batch in batches:
            texts = [lowered(t) for t in batch.column("text").to_pylist()]
            counts, sizes, all_terms, all_places = [], [], [], []
            for _, _, words in words_of_all(texts, ALPHANUMERIC):
                total = np.diff(words.first)
                owner = np.repeat(np.arange(len(total)), total)
                bit = (words.numbers.view(np.int64) % FILTER_BITS).astype(np.int64)
                kept = np.flatnonzero(bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                place = kept - words.first[owner[kept]]
                term = words.numbers.view(np.int64)[kept]
                order = np.lexsort((place, term, owner[kept]))
                counts.append(total)
                sizes.append(np.bincount(owner[kept], minlength=len(total)))
                all_terms.append(term[order])
                all_places.append(place[order].astype(np.int32))
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1)
            offsets = pa.array(offsets.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("text_hash"),
                    pa.array(np.concatenate(counts).astype(np.int64) if counts else [], pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(all_terms) if all_terms else [], pa.int64())),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(all_places) if all_places else [], pa.int32())),
                ],
                names=["id", "text_hash", "n_words", "terms", "places"],
            )

    texts = docs.select(
        F.col(id_col).cast("string").alias("id"),
        F.xxhash64(text_col).alias("text_hash"),
        F.col(text_col).alias("text"),
    )
    return written(
        texts.mapInArrow(post, "id string, text_hash long, n_words long, terms array<long>, places array<int>")
    )


def _same_doc(left: DataFrame, right: DataFrame) -> Column:
    return left["id"].eqNullSafe(right["id"]) & (left["text_hash"] == right["text_hash"])


def matches(
    docs_index: DataFrame, windows: DataFrame, slop: int = SLOP, near_terms: int = NEAR_TERMS
) -> DataFrame:
    """``id, text_hash, exact, near`` for the indexed documents that have any match.

    ``exact`` is an array of (item, start, size), one for each occurrence of a window; ``near``
    the items with a near but no exact match in the document. Repeated rows of a document give
    one row.
    """
    frequency = docs_index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    order = Window.partitionBy("item", "w").orderBy("n", "place")
    # A window whose words are not all in the index cannot occur, nor is it near if a rare one is missing.
    by_rarity = written(
        windows.distinct()
        .join(frequency, "term", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("rank", F.row_number().over(order))
        .groupBy("item", "w")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "term", "place"))).alias("ranked"))
        .select(
            "item",
            F.get("ranked.term", F.lit(0)).alias("term"),
            F.col("ranked.term").alias("terms"),
            F.col("ranked.place").alias("places"),
        )
    )
    rarest = docs_index.sparkSession.sparkContext.broadcast(_filter_of(by_rarity.select("term")))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of all postings only the rarest terms of windows go on to the join.
        for batch in batches:
            lists = batch.column("terms")
            terms = lists.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
            bit = terms % FILTER_BITS
            asks = rarest.value[bit >> 3] >> (bit & 7).astype(np.uint8) & 1
            # A document's postings stand by term, so a term's first is the one to keep.
            new = np.ones(len(terms), dtype=bool)
            new[1:] = (terms[1:] != terms[:-1]) | (owner[1:] != owner[:-1])
            kept = np.flatnonzero(asks.astype(bool) & new)
            rows = pa.array(owner[kept])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(rows), batch.column("text_hash").take(rows), pa.array(terms[kept], pa.int64())],
                names=["id", "text_hash", "term"],
            )

    asked = (
        docs_index.select("id", "text_hash", "terms")
        .mapInArrow(ask, "id string, text_hash long, term long")
        .join(by_rarity, "term")
        .groupBy("id", "text_hash")
        .agg(F.collect_set(F.struct("item", "terms", "places")).alias("windows"))
    )
    lists = docs_index.select("id", "text_hash", "terms", "places")
    both = asked.join(lists, _same_doc(asked, lists)).select(
        asked["id"], asked["text_hash"], "windows", "terms", "places"
    )

    def intersect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text_hash, windows, terms, places in zip(*(batch[c] for c in batch.columns)):
                cuts = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]]))
                lists = dict(zip(terms[cuts].tolist(), np.split(places, cuts[1:])))
                exact, near = [], set()
                for window in windows:
                    asked_terms, at = (np.asarray(window[c]) for c in ("terms", "places"))
                    starts, close = _occurrences(lists, asked_terms, at, slop, near_terms)
                    exact += [(window["item"], int(s), len(at)) for s in starts]
                    if close:
                        near.add(window["item"])
                if exact or near:
                    exact = sorted(set(exact), key=str)
                    out.append((doc, text_hash, exact, sorted(near - {e[0] for e in exact}, key=str)))
            yield pd.DataFrame(out, columns=["id", "text_hash", "exact", "near"], dtype=object)

    found = both.mapInPandas(
        intersect,
        "id string, text_hash long, exact array<struct<item:string,start:int,size:int>>, near array<string>",
    )
    return found.dropDuplicates(["id", "text_hash"])


def _occurrences(
    lists: dict[int, np.ndarray], terms: np.ndarray, places: np.ndarray, slop: int, near_terms: int
) -> tuple[np.ndarray, bool]:
    """Starts of exact occurrences, and whether the rarest terms stand near their places."""
    none = np.empty(0, dtype=np.int32)
    starts = near = None
    for rank, (term, place) in enumerate(zip(terms.tolist(), places.tolist())):
        at = lists.get(term, none) - place
        starts = at if starts is None else np.intersect1d(starts, at, assume_unique=True)
        if rank < near_terms:
            if near is None:
                near = at
            elif len(at):
                # The closest place of this term to each start that is left.
                right = np.clip(np.searchsorted(at, near), 0, len(at) - 1)
                gap = np.minimum(np.abs(at[right] - near), np.abs(at[np.maximum(right - 1, 0)] - near))
                near = near[gap <= slop]
            else:
                near = none
        if not len(starts) and not len(near):
            return none, False
    return starts[starts >= 0], bool(len(near)) and len(terms) > near_terms


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
    slop: int = SLOP, near_terms: int = NEAR_TERMS,
) -> DataFrame:
    """For every row of ``docs``: ``id, text_hash, n_words, exact, near``.

    ``exact`` lists the occurrences (item, start, size) of benchmark windows, ``near`` the items with
    a near match only; both are null without any. A null text has no words. Null
    item ids are not told apart from rows without one: their windows match, under a null item. Repeated
    rows get equal results; other columns are not read.
    """
    windows = written(windows_of(items, item_col, item_text_col, window))
    indexed = index(docs, windows.select("term"), id_col, text_col)
    found = matches(indexed, windows, slop, near_terms)
    counts = indexed.select("id", "text_hash", "n_words")
    joined = counts.join(found, _same_doc(counts, found), "left")
    return joined.select(
        counts["id"].cast(docs.schema[id_col].dataType).alias(id_col), counts["text_hash"],
        "n_words", "exact", "near",
    )


def hit_words(exact: Column) -> Column:
    """Number of words inside any of the occurrences."""
    covered = F.array_distinct(
        F.flatten(F.transform(exact, lambda e: F.sequence(e["start"], e["start"] + e["size"] - 1)))
    )
    return F.coalesce(F.size(covered), F.lit(0)).cast("long")


def uncontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` (columns as they are) without an exact match of any window."""
    found = contamination(docs.select("doc_id", "text"), items, window=window)
    doc, text_hash = fresh(docs, "_bad_doc"), fresh(docs, "_bad_text")
    bad = found.where(F.size("exact") > 0).select(
        F.col("doc_id").alias(doc), F.col("text_hash").alias(text_hash)
    )
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(text_hash))
    return docs.join(bad, same, "left_anti")
