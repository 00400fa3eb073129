"""Near-duplicates by SimHash: fingerprints of word shingles, compared bit-sliced in blocks.

Two fingerprints within the radius agree on all but ``radius`` of ``radius + 3``
pieces of their bits, so each is sent to one block for every choice of agreeing
pieces. Inside a block the fingerprints stand as bit planes: one machine word
holds the same bit of 64 fingerprints, distances of a query to all of them grow
together in carry-save counters, and a stretch of fingerprints is given up once
every one of them lies beyond the radius. Blocks above a size are cut once more
by the remaining bits, after which no block can hold more than some thousand
different fingerprints, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.shared import components, fresh
from tidewatch.session import written

BITS = 64
SEED = 42
# A block with more fingerprints is cut again by the bits its members may differ in.
BLOCK_ROWS = 4_096
# Shingles whose bits are counted at once, and cells of a comparison held at once.
SHINGLES_AT_ONCE = 1 << 16
WORDS_AT_ONCE = 1 << 20
# Bit planes added between two looks at what is left to compare.
PLANES_BETWEEN = 8


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of every run of ``shingle`` words, repeats included, as big-endian numbers.

    A-Z are lower-cased and words end at ASCII white space. Fewer words than
    ``shingle`` give one hash of them all; no word gives none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=">u8")
    line = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_digest
    last = min(shingle, len(words)) - 1
    parts = [digest(line[s : e - 1], SEED) for s, e in zip(starts, ends[last:])]
    return np.frombuffer(b"".join(parts), dtype=">u8")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit fingerprint: a bit is set if it is set in over half of the hashes."""
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(hashes), SHINGLES_AT_ONCE):
        raw = hashes[start : start + SHINGLES_AT_ONCE].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprint_column(text: Column, shingle: int) -> Column:
    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return prints(text)


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of 64-bit numbers: row b holds bit b of all of them, 64 to a word."""
    bits = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    width = -(-len(values) // 64) * 64
    padded = np.zeros((BITS, width), dtype=np.uint8)
    padded[:, : len(values)] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def _beyond(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose bit-sliced count is greater than ``radius`` or has overflowed."""
    greater, equal = np.zeros_like(over), ~np.zeros_like(over)
    for place in reversed(range(len(counters))):
        if radius >> place & 1:
            equal &= counters[place]
        else:
            greater |= equal & counters[place]
            equal &= ~counters[place]
    return over | greater


def pairs_within(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions i < j of all pairs of ``values`` (unsigned 64-bit) at most ``radius`` bits apart."""
    table = planes(values)
    differing = int(np.bitwise_or.reduce(values ^ values[0]))
    varying = [b for b in range(BITS) if differing >> (63 - b) & 1]
    words = table.shape[1]
    # A query is compared with the words from its own on; earlier ones have met it.
    step = max(64, WORDS_AT_ONCE // max(1, words) // 64 * 64)
    left, right = [], []
    for first in range(0, len(values), step):
        query = np.arange(first, min(first + step, len(values)))
        begin = first // 64
        rows, cols = (x.ravel() for x in np.meshgrid(query, np.arange(begin, words), indexing="ij"))
        keep = cols >= rows // 64
        rows, cols = rows[keep], cols[keep]
        counters = [np.zeros(len(rows), dtype=np.uint64) for _ in range(max(1, radius.bit_length()))]
        over = np.zeros(len(rows), dtype=np.uint64)
        full = ~np.uint64(0)
        for at in range(0, len(varying), PLANES_BETWEEN):
            for b in varying[at : at + PLANES_BETWEEN]:
                own = np.where(values[rows] >> np.uint64(63 - b) & np.uint64(1), full, np.uint64(0))
                carry = table[b][cols] ^ own
                for place, counter in enumerate(counters):
                    counters[place], carry = counter ^ carry, counter & carry
                over |= carry
            over = _beyond(counters, over, radius)
            alive = over != full
            if not alive.all():
                rows, cols, over = rows[alive], cols[alive], over[alive]
                counters = [c[alive] for c in counters]
        near = np.unpackbits((~_beyond(counters, over, radius)).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        hit, lane = np.nonzero(near)
        i, j = rows[hit], cols[hit] * 64 + lane
        true = (i < j) & (j < len(values))
        left.append(i[true])
        right.append(j[true])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, int), np.empty(0, int))


def _smallest_linked(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n items the smallest item it is linked to, directly or not."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, j, label[i])
        np.minimum.at(new, i, label[j])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _block_links(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Links of sorted blocks: within each, every linked fingerprint and the smallest it reaches."""
    rest = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if not len(rows):
            continue
        last = (rows["part"] == rows["part"].iloc[-1]) & (rows["key"] == rows["key"].iloc[-1])
        rest = rows[last]
        yield from _links_of(rows[~last], radius)
    if rest is not None:
        yield from _links_of(rest, radius)


def _links_of(rows: pd.DataFrame, radius: int) -> Iterator[pd.DataFrame]:
    if not len(rows):
        return
    part, key = rows["part"].to_numpy(), rows["key"].to_numpy()
    cuts = np.flatnonzero((part[1:] != part[:-1]) | (key[1:] != key[:-1])) + 1
    found = []
    for block in np.split(rows["fp"].to_numpy(), cuts):
        if len(block) < 2:
            continue
        values = np.unique(block)
        i, j = pairs_within(values.view(np.uint64), radius)
        label = _smallest_linked(len(values), i, j)
        moved = np.flatnonzero(label != np.arange(len(values)))
        found.append(pd.DataFrame({"a": values[moved], "b": values[label[moved]]}))
    if found:
        yield pd.concat(found, ignore_index=True)


def _masks(bits: list[int], radius: int) -> list[int]:
    """Masks of the bits that two values within ``radius`` must share, one for each way."""
    pieces = [p for p in np.array_split(np.array(bits, dtype=int), radius + 3) if len(p)]
    kept = max(1, len(pieces) - radius)
    return [sum(1 << int(b) for p in some for b in p) for some in combinations(pieces, kept)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _blocks(prints: DataFrame, parts: Column) -> DataFrame:
    """One row for each fingerprint and block, with the block's size; rows of a block stand together."""
    spread = prints.select("fp", F.explode(parts).alias("p")).select("fp", "p.part", "p.key")
    return spread.withColumn("n", F.count("*").over(Window.partitionBy("part", "key"))).where("n > 1")


def links(prints: DataFrame, radius: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``a, b``: links that connect all fingerprints (distinct, column ``fp``) within ``radius``.

    Only links that join what a block has not joined yet are returned, fewer than
    there are fingerprints in it.
    """
    masks = _masks(list(range(BITS)), radius)

    def part(number: int, mask: int) -> Column:
        return F.struct(
            F.lit(number).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key")
        )

    first = _blocks(prints, F.array(*[part(k, m) for k, m in enumerate(masks)]))
    # Blocks above the size: the bits that may still differ are cut in the same way.
    finer = []
    for k, mask in enumerate(masks):
        free = [b for b in range(BITS) if not mask >> b & 1]
        more = [mask | m for m in _masks(free, radius)]
        number = (k + 1) * 1_000
        finer.append(F.array(*[part(number + x, m) for x, m in enumerate(more)]))
    large = first.where(F.col("n") > block_rows).select("fp", "part")
    second = _blocks(large, F.element_at(F.array(*finer), F.col("part") + 1))

    def compare(blocks: DataFrame) -> DataFrame:
        return blocks.select("part", "key", "fp").mapInPandas(
            lambda batches: _block_links(batches, radius), "a long, b long"
        )

    return compare(first.where(F.col("n") <= block_rows)).union(compare(second))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    radius: int = 2,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``id, text_hash, fingerprint, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest id that is linked to the row over any number
    of links of at most ``radius`` differing bits. A null or blank text has
    fingerprint zero and is linked like any other. Repeated rows are repeated in the
    result. A null id is never the smallest; a group of null ids only has none.
    ``text_hash`` (64 bits) tells rows of the same id apart. Other columns are not read.
    """
    prints = _prints(docs, id_col, text_col, shingle)
    rooted = _rooted(prints, radius, block_rows)
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.select("fp", "root").join(smallest, "root")
    return prints.join(classes, "fp").select(
        F.col("id").alias(id_col),
        "text_hash",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def _prints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``id, text_hash, fp`` of every row, written."""
    return written(
        docs.select(
            F.col(id_col).alias("id"),
            F.xxhash64(text_col).alias("text_hash"),
            fingerprint_column(F.col(text_col), shingle).alias("fp"),
        )
    )


def _rooted(prints: DataFrame, radius: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``fp, least, root``: each different fingerprint, its smallest id and its component."""
    least = written(prints.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(least.select("fp"), radius, block_rows)).withColumnRenamed("node", "fp")
    return least.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def one_of_each(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """The rows of ``docs`` (columns as they are) that are first of their group, by ``doc_id``.

    Of equal ids the one with the smallest text hash stays, and of repeated rows one.
    A group of null ids only keeps one row too.
    """
    prints = _prints(docs, "doc_id", "text", shingle)
    # The first row of each fingerprint is found before components are joined, so that a fingerprint
    # that very many rows share is one row there.
    row = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")
    by_print = prints.groupBy("fp").agg(F.min(row).alias("row"))
    doc, text_hash = fresh(docs, "_first_doc"), fresh(docs, "_first_text")
    first = (
        by_print.join(_rooted(prints, radius).select("fp", "root"), "fp")
        .groupBy("root")
        .agg(F.min("row").alias("row"))
        .select(F.col("row.id").alias(doc), F.col("row.text_hash").alias(text_hash))
    )
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(text_hash))
    kept, mark = docs.join(first, same, "left_semi"), fresh(docs, "_text_hash")
    return kept.withColumn(mark, F.xxhash64("text")).dropDuplicates(["doc_id", mark]).drop(mark)
