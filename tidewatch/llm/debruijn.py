"""Removal of repeated spans by a compacted De Bruijn graph of word windows.

Windows of k words are the graph's edges, their first and last k - 1 words its nodes. An edge that
stands in several documents is repeated; the first document that has it is its source, and the edge's place
there its source coordinates. Edges that follow each other in a document, with source coordinates that
follow each other too, are one span. Where a span begins or ends inside a source the graph branches, so
sources are cut at all such places: what lies between two cuts is a nonbranching path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.bytewords import UNSPACED, Words, words_of_all
from tidewatch.llm.shared import bit_filter, fresh
from tidewatch.session import written

WINDOW = 13
# Words of a minimizer: each window names the one of its short runs whose hash is least, so windows with
# equal words name equal runs, and neighbours mostly the same one.
SHORT = 4
# Bits of the set of minimizers that several documents have: 16 MB in every task, whatever the table's
# size. If it is full, more windows are compared and none is lost.
FILTER_BITS = 1 << 27
_BLOCK_BITS = 1 << 16
# Bits of the set of rows that have spans: 4 MB in every task. Rows without their bit need no join.
ROW_BITS = 1 << 25
# Equal windows, more than this (and than a 2**20th of all), would fill a task by themselves, so they are
# not dealt; at most 2**20 windows can be such, and their sources are sent to all tasks.
HOT_WINDOWS = 20_000
HOT_MOST = 1 << 20

_ODD = np.uint64(0x2545F4914F6CDD1D)
_OTHER = np.uint64(0x9E6C63D0876A9A35)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _runs(numbers: np.ndarray, size: int, base: np.uint64 = _ODD) -> np.ndarray:
    """A hash of each run of ``size`` numbers."""
    total = np.zeros(max(0, len(numbers) - size + 1), dtype=np.uint64)
    for i in range(size):
        total = total * base + numbers[i : i + len(total)]
    total = (total ^ (total >> np.uint64(32))) * _MIX
    return total ^ (total >> np.uint64(29))


def _least(numbers: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` neighbours, by doubling."""
    width, out = 1, numbers
    while width < size:
        step = min(width, size - width)
        out = np.minimum(out[:-step], out[step:])
        width += step
    return out


def _checks(words: Words, window: int, places: np.ndarray) -> np.ndarray:
    """32 more bits for the windows that begin at some words: with its edge, a window has 96.

    So of ten million million windows, some pair is taken for equal wrongly with a chance of one in a thousand.
    """
    return (_runs(words.numbers, window, _OTHER)[places] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _windows(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``text, place, edge, minimizer`` of all windows of some texts' words."""
    total = np.diff(words.first)
    short = min(SHORT, window)
    edges = _runs(words.numbers, window)
    least = _least(_runs(words.numbers, short), window - short + 1)
    owner = np.repeat(np.arange(len(total)), total)
    # Windows that begin in a text and end in it.
    inside = np.flatnonzero(owner[: len(edges)] == owner[window - 1 :])
    text = owner[inside]
    return text, (inside - words.first[text]).astype(np.int32), edges[inside], least[inside]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _encoded(batch: pa.RecordBatch) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]


def minimizers(texts: DataFrame, window: int) -> DataFrame:
    """``minimizer, n``: those that several documents have, and how many windows name them; written out.

    Windows of a document that name the same one in a row are one row.
    """
    kind = dict(texts.dtypes)["doc"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column("doc")
            for begin, _, words in words_of_all(_encoded(batch), UNSPACED):
                text, _, _, least = _windows(words, window)
                new = np.ones(len(least), dtype=bool)
                new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
                new = np.flatnonzero(new)
                size = np.diff(np.append(new, len(least))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(least[new].view(np.int64)), doc.take(pa.array(text[new] + begin)), pa.array(size)],
                    names=["minimizer", "doc", "size"],
                )

    counted = (
        texts.select("doc", "text")
        .mapInArrow(cut, f"minimizer long, doc {kind}, size int")
        .groupBy("minimizer")
        .agg(
            F.min("doc").alias("first"), F.max("doc").alias("last"), F.sum("size").alias("n"),
            F.bool_or(F.col("doc").isNull()).alias("unnamed"),
        )
    )
    # Rows without an id come after all others, and are not compared with each other.
    return written(counted.where("first < last OR (first IS NOT NULL AND unnamed)").select("minimizer", "n"))


def _filter(shared: DataFrame) -> np.ndarray:
    """A bit for each minimizer, gathered in blocks of 65,536 bits; ``FILTER_BITS`` in all."""
    bits = np.zeros(FILTER_BITS, dtype=bool)
    bit = F.pmod("minimizer", F.lit(FILTER_BITS))
    blocks = (
        shared.select(F.floor(bit / _BLOCK_BITS).cast("int").alias("block"), (bit % _BLOCK_BITS).cast("int").alias("at"))
        .groupBy("block")
        .agg(F.collect_set("at").alias("at"))
    )
    for row in blocks.toLocalIterator():
        bits[row["block"] * _BLOCK_BITS + np.array(row["at"], dtype=np.int64)] = True
    return np.packbits(bits, bitorder="little")


def _often(shared: DataFrame, least: int) -> np.ndarray:
    """Minimizers of more windows than ``least``, in order."""
    rows = shared.where(F.col("n") > least).select("minimizer").collect()
    return np.sort(np.array([r[0] for r in rows], dtype=np.int64))


def _edges(texts: DataFrame, window: int, schema: str, keep) -> DataFrame:
    """Rows ``doc, text_hash, place, edge, check`` of some windows, with more columns if ``keep`` adds any.

    ``keep(edge, check, minimizer)`` says which windows are kept and gives the columns that it adds.
    """
    kind = dict(texts.dtypes)["doc"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, text_hash = batch.column("doc"), batch.column("text_hash")
            for begin, _, words in words_of_all(_encoded(batch), UNSPACED):
                text, place, edge, least = _windows(words, window)
                check = _checks(words, window, place + words.first[text])
                kept, more = keep(edge.view(np.int64), check, least.view(np.int64))
                rows = pa.array(text[kept] + begin)
                columns = {
                    "doc": doc.take(rows),
                    "text_hash": text_hash.take(rows),
                    "place": pa.array(place[kept]),
                    "edge": pa.array(edge[kept].view(np.int64)),
                    "check": pa.array(check[kept]),
                } | more
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return texts.mapInArrow(cut, f"doc {kind}, text_hash long, place int, edge long, check int{schema}")


def _source() -> Column:
    """The first place, in the first document; rows without an id are no source."""
    return F.min(F.when(F.col("doc").isNotNull(), F.struct("doc", "text_hash", "place")))


@dataclass
class _Hot:
    """Windows of so many copies that a task is not to hold them all, with their sources."""

    edge: np.ndarray
    check: np.ndarray
    sources: pa.Table

    def at(self, edge: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Where each window stands here, -1 where it does not."""
        # Sorted by edge and then check; edges are distinct but for a chance that checks settle.
        first, last = (np.searchsorted(self.edge, edge, side) for side in ("left", "right"))
        found = np.full(len(edge), -1, dtype=np.int64)
        for step in range(int((last - first).max(initial=0))):
            near = np.flatnonzero(first + step < last)
            same = near[self.check[first[near] + step] == check[near]]
            found[same] = first[same] + step
        return found


def _hot(texts: DataFrame, window: int, minimizers: np.ndarray, least: int) -> _Hot:
    """The windows that stand more than ``least`` times, by a count of those with often-named minimizers."""
    shared = texts.sparkSession.sparkContext.broadcast(minimizers)

    def keep(edge: np.ndarray, check: np.ndarray, minimizer: np.ndarray) -> tuple[np.ndarray, dict]:
        return np.flatnonzero(np.isin(minimizer, shared.value)), {}

    counted = (
        _edges(texts, window, "", keep).groupBy("edge", "check").agg(F.count("*").alias("n"), _source().alias("source"))
    )
    rows = counted.where(F.col("n") > least).where("source IS NOT NULL")
    table = rows.select(
        "edge", "check", F.col("source.doc").alias("source_doc"), F.col("source.place").alias("source_place")
    ).toArrow().sort_by([("edge", "ascending"), ("check", "ascending")])
    names = ["source_doc", "source_place"]
    return _Hot(table["edge"].to_numpy(), table["check"].to_numpy(), table.select(names).combine_chunks())


def repeated_edges(texts: DataFrame, window: int, hot_windows: int) -> DataFrame:
    """``doc, text_hash, place, source_doc, source_place``: the windows that an earlier document has.

    With where it has them first. Windows are dealt by their edge, once; those of very many copies are counted
    before and meet their source where texts are read.
    """
    context = texts.sparkSession.sparkContext
    shared = minimizers(texts, window)
    bits = context.broadcast(_filter(shared))
    least = max(hot_windows, (shared.agg(F.sum("n")).first()[0] or 0) // HOT_MOST)
    often = _often(shared, least)
    hot = context.broadcast(_hot(texts, window, often, least) if len(often) else None)

    def cold_ones(edge: np.ndarray, check: np.ndarray, minimizer: np.ndarray) -> tuple[np.ndarray, dict]:
        bit = minimizer % FILTER_BITS
        kept = (bits.value[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
        if hot.value:
            kept &= hot.value.at(edge, check) < 0
        return np.flatnonzero(kept), {}

    def hot_ones(edge: np.ndarray, check: np.ndarray, minimizer: np.ndarray) -> tuple[np.ndarray, dict]:
        found = hot.value.at(edge, check)
        kept = np.flatnonzero(found >= 0)
        sources = hot.value.sources.take(pa.array(found[kept]))
        return kept, {n: sources[n].combine_chunks() for n in sources.column_names}

    names = ["doc", "text_hash", "place", "source_doc", "source_place"]
    source = _source().over(Window.partitionBy("edge", "check"))
    found = _edges(texts, window, "", cold_ones).withColumn("s", source).where("s IS NOT NULL")
    found = found.select(*names[:3], F.col("s.doc").alias(names[3]), F.col("s.place").alias(names[4]))
    if len(often):
        more = f", source_doc {dict(texts.dtypes)['doc']}, source_place int"
        found = found.unionByName(_edges(texts, window, more, hot_ones).select(*names))
    return found.where(F.col("doc").isNull() | (F.col("source_doc") < F.col("doc")))


def spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    hot_windows: int = HOT_WINDOWS,
) -> DataFrame:
    """``doc, text_hash, first, windows, source_doc, source_first``, written out.

    A span is ``windows`` windows from word ``first`` of a document on, that stand in the same order from word
    ``source_first`` of an earlier document: so ``windows + window - 1`` words. Together the spans of a
    document cover all windows that a document of smaller id has, and no others; two spans may overlap in words. Of
    several rows of the source's id that have a window, the one of least text hash gives the place.

    Words are runs of anything but ASCII white space. Rows of one id are not compared with each other, nor are rows
    without one, which come after all others. Repeated rows have equal spans, given once. Null and empty texts, and those of
    fewer words than a window, have none, and a table without rows gives none. Other columns are not read.
    """
    steps = repeated_edges(_texts(docs, id_col, text_col), window, hot_windows)
    shift = F.col("source_place") - F.col("place")
    # Neighbours of one diagonal have places that rise with their rank; repeated rows have equal ranks.
    diagonal = ["doc", "text_hash", "source_doc", "shift"]
    rank = F.dense_rank().over(Window.partitionBy(*diagonal).orderBy("place"))
    return written(
        steps.select("doc", "text_hash", "place", "source_doc", shift.alias("shift"))
        .withColumn("island", F.col("place") - rank)
        .groupBy(*diagonal, "island")
        .agg(F.min("place").alias("first"), (F.max("place") - F.min("place") + 1).alias("windows"))
        .select(
            "doc", "text_hash", "first", "windows", "source_doc", (F.col("first") + F.col("shift")).alias("source_first")
        )
    )


def paths(found: DataFrame) -> DataFrame:
    """``source_doc, first, windows, spans``: the nonbranching paths of the repeated graph.

    A source is cut wherever a span of it begins or ends; of the pieces those are paths that a span covers,
    and ``spans`` says how many cover them whole. Cuts are distinct before they are put in order, so a source with
    very many spans has no more of them than words.
    """
    ends = found.select(
        "source_doc",
        F.explode(
            F.array(
                F.struct(F.col("source_first").alias("at"), F.lit(1).alias("step")),
                F.struct((F.col("source_first") + F.col("windows")).alias("at"), F.lit(-1).alias("step")),
            )
        ).alias("e"),
    )
    cuts = ends.groupBy("source_doc", F.col("e.at").alias("first")).agg(F.sum("e.step").alias("change"))
    along = Window.partitionBy("source_doc").orderBy("first")
    return (
        cuts.withColumn("spans", F.sum("change").over(along))
        .withColumn("windows", F.lead("first").over(along) - F.col("first"))
        .where("spans > 0")
        .select("source_doc", "first", "windows", "spans")
    )


def _kept(text: str | None, firsts: list | None, lasts: list | None) -> tuple[int, int, bytes]:
    """Words of a text, how many the spans (first to last word) cover, and the others joined by spaces."""
    # bytes.split cuts at the ASCII white space and nothing else.
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not firsts:
        return len(words), 0, b" ".join(words)
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(depth, np.array(firsts, dtype=np.int64), 1)
    np.add.at(depth, np.array(lasts, dtype=np.int64) + 1, -1)
    gone = np.cumsum(depth[:-1]) > 0
    return len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone) if not g)


def _with_spans(docs: DataFrame, id_col: str, text_col: str, window: int, hot_windows: int) -> tuple[DataFrame, str]:
    """``docs`` and a column of each row's spans of words, or null."""
    found = spans(docs, id_col, text_col, window, hot_windows)
    doc, text_hash, cuts = (fresh(docs, c) for c in ("_span_doc", "_span_text", "_spans"))
    gathered = found.groupBy(F.col("doc").alias(doc), F.col("text_hash").alias(text_hash)).agg(
        F.collect_list(F.struct("first", (F.col("first") + F.col("windows") + window - 2).alias("last"))).alias(cuts)
    )
    own_hash = F.xxhash64(F.coalesce(text_col, F.lit("")))
    same = F.col(id_col).eqNullSafe(F.col(doc)) & (own_hash == F.col(text_hash))
    # Texts without spans stay where they are read.
    known = docs.sparkSession.sparkContext.broadcast(
        bit_filter(found.select(F.xxhash64("doc", "text_hash").alias("row")), "row", ROW_BITS)
    )

    def has_bit(rows: pa.Array) -> pa.Array:
        bit = rows.to_numpy() % ROW_BITS
        return pa.array((known.value[bit >> 6] >> (bit & 63) & 1).astype(bool))

    held = F.arrow_udf(has_bit, "boolean")(F.xxhash64(F.col(id_col), own_hash))
    joined = docs.where(held).join(gathered, same, "left").drop(doc, text_hash)
    none = F.lit(None).cast(joined.schema[cuts].dataType).alias(cuts)
    return joined.unionByName(docs.where(~held).select("*", none)), cuts


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, hot_windows: int = HOT_WINDOWS
) -> DataFrame:
    """``docs`` with the words of repeated spans taken out; texts without any stay as they are, to the letter.

    Of the others the words that are left are joined by single spaces; a text that only repeats others becomes empty.
    Rows stay, and so do other columns. See ``spans`` for odd rows.
    """
    joined, cuts = _with_spans(docs, id_col, text_col, window, hot_windows)

    def work(texts: pa.Array, firsts: pa.Array, lasts: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), firsts.to_pylist(), lasts.to_pylist())
        return pa.array([_kept(*row)[2].decode("utf-8", "surrogatepass") if row[1] else row[0] for row in rows], pa.string())

    text = F.arrow_udf(work, "string")(F.col(text_col), F.col(cuts)["first"], F.col(cuts)["last"])
    return joined.withColumn(text_col, text).select(*docs.columns)


def removals(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, hot_windows: int = HOT_WINDOWS
) -> DataFrame:
    """``id, n_words, n_removed, kept_sha256`` for every row, the hash of what ``without_repeats`` leaves as joined words."""
    joined, cuts = _with_spans(docs.select(id_col, text_col), id_col, text_col, window, hot_windows)
    kind = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def work(texts: pa.Array, firsts: pa.Array, lasts: pa.Array) -> pa.Array:
        out = []
        for row in zip(texts.to_pylist(), firsts.to_pylist(), lasts.to_pylist()):
            n, removed, kept = _kept(*row)
            out.append({"n_words": n, "n_removed": removed, "kept_sha256": hashlib.sha256(kept).hexdigest()})
        return pa.array(out, kind)

    found = F.arrow_udf(work, "n_words long, n_removed long, kept_sha256 string")(
        F.col(text_col), F.col(cuts)["first"], F.col(cuts)["last"]
    )
    return joined.select(id_col, found.alias("r")).select(id_col, "r.*")
