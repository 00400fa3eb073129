"""Document fingerprints by context-triggered piecewise hashing, and their likeness.

A rolling hash of the last seven bytes ends a piece wherever it hits a value that
depends on the block size; each piece gives one character. Signatures are kept for
a block size fitting the text's length and for twice that, so that texts of up to
twice the length can still be compared.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import written

WINDOW = 7
LEAST_BLOCK = 3
SIGNATURE = 64
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
# Two signatures are alike only if they share a run of this many characters.
COMMON_RUN = 5
# Odd multiplier of the rolling hash.
_FACTOR = 0x9E3779B1


def boundary_values(data: bytes) -> np.ndarray:
    """At each byte the mixed hash of the seven bytes that end there."""
    padded = np.frombuffer(b"\0" * (WINDOW - 1) + data, dtype=np.uint8).astype(np.uint32)
    rolling = np.zeros(len(data), dtype=np.uint32)
    for k in range(WINDOW):
        rolling = rolling * np.uint32(_FACTOR) + padded[k : k + len(data)] + np.uint32(1)
    rolling ^= rolling >> np.uint32(15)
    return rolling * np.uint32(0x85EBCA6B) >> np.uint32(3)


def _signature(data: bytes, ends: np.ndarray) -> str:
    """A character for each piece; past the last allowed piece the rest is one."""
    cuts = ends[: SIGNATURE - 1].tolist()
    signs, start = [], 0
    for end in cuts:
        signs.append(ALPHABET[zlib.crc32(data[start : end + 1]) & 63])
        start = end + 1
    if start < len(data):
        signs.append(ALPHABET[zlib.crc32(data[start:]) & 63])
    return "".join(signs)


def fingerprint(text: str | None) -> str:
    """``block size:signature:signature at twice the block size``; a null text counts as empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    values = boundary_values(data)
    block = LEAST_BLOCK
    while block * SIGNATURE < len(data):
        block *= 2
    while True:
        # Values that end a piece at twice the block size also end one at the block size.
        ends = np.flatnonzero(values % np.uint32(block) == block - 1)
        if block == LEAST_BLOCK or len(ends) >= SIGNATURE // 2 - 1:
            break
        block //= 2
    coarse = ends[values[ends] % np.uint32(2 * block) == 2 * block - 1]
    return f"{block}:{_signature(data, ends)}:{_signature(data, coarse)}"


def likeness(first: str, second: str) -> float:
    """0 to 1: the best likeness of signatures at an equal block size, 0 if none is equal.

    Likeness falls from 1 with the insertions and deletions needed, as a share of both lengths.
    """
    (a, a1, a2), (b, b1, b2) = (_parsed(x) for x in (first, second))
    if a == b:
        if (a1, a2) == (b1, b2):
            return 1.0
        return max(_alike(a1, b1), _alike(a2, b2))
    if a == 2 * b:
        return _alike(a1, b2)
    if b == 2 * a:
        return _alike(a2, b1)
    return 0.0


def _parsed(print_: str) -> tuple[int, str, str]:
    block, fine, coarse = print_.split(":")
    return int(block), fine, coarse


def _alike(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    run = min(COMMON_RUN, len(a), len(b))
    pieces = {a[i : i + run] for i in range(len(a) - run + 1)}
    if not any(b[i : i + run] in pieces for i in range(len(b) - run + 1)):
        return 0.0
    return 1.0 - edit_distance(a, b) / (len(a) + len(b))


def edit_distance(a: str, b: str) -> int:
    """Insertions and deletions that turn ``a`` into ``b``, all columns of a row in one number."""
    places: dict[str, int] = {}
    for i, sign in enumerate(a):
        places[sign] = places.get(sign, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for sign in b:
        match = row & places.get(sign, 0)
        row = (row + match | row - match) & full
    common = len(a) - row.bit_count()
    return len(a) + len(b) - 2 * common


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by the first half of ``following``, as long or shorter."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_column(text: Column) -> Column:
    """Fingerprint of a text column; equal texts have equal ones, a null text that of the empty text."""

    @F.pandas_udf("string")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in texts], dtype=object)

    return prints(text)


# Ids travel as text: a column of numbers with nulls would pass through floating point.
_RESULT = (
    "id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _judge(doc: str | None, text: str, following: str, own: str, next_print: str) -> tuple:
    changed = edited(text, following)
    other = fingerprint(changed)
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return doc, len(text), digest, own, other, likeness(own, other), likeness(own, next_print)


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how alike they are.

    Documents are ordered by descending id, then by text hash; null ids come last. The
    last is followed by the first; a single document follows itself. A null text counts as
    empty. Ordering deals rows out by range, so texts move once; a task reads its
    rows in order, and what it cannot finish, its last row, meets the first row of the
    next task in a second step over two rows a task.
    """
    texts = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    key = [F.desc_nulls_last("id"), F.xxhash64("text").asc()]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.repartitionByRange(parts, *key).sortWithinPartitions(*key)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = []
            for part, doc, text in zip(batch["part"], batch["id"], batch["text"]):
                own = fingerprint(text)
                if held is None:
                    # The first row serves the task before this one.
                    rows.append((doc, None, None, own, None, None, None, part, True, text))
                else:
                    rows.append((*_judge(*held[:2], text, held[2], own), None, None, None))
                held = (doc, text, own, part)
            yield frame(rows)
        if held is not None:
            yield frame([(held[0], None, None, held[2], None, None, None, held[3], False, held[1])])

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names, dtype=object)

    schema = f"{_RESULT}, part int, head boolean, text string"
    names = [x.split()[0] for x in schema.split(", ")]
    found = written(
        dealt.select(
            F.spark_partition_id().alias("part"), F.col("id").cast("string").alias("id"), "text"
        ).mapInPandas(walk, schema)
    )
    done = found.where("part is null")
    edges = found.where("part is not null")
    # Two rows a task, so one window over them is as small as the number of tasks.
    order = Window.orderBy("part")
    heads = edges.where("head").select(
        "part", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print")
    )
    tails = edges.where("not head").withColumn(
        "next_part", F.coalesce(F.lead("part").over(order), F.min("part").over(Window.partitionBy()))
    )

    @F.pandas_udf(_RESULT)
    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        out = [
            _judge(r.id, r.text, r.next_text, r.fingerprint, r.next_print)
            for r in rows.itertuples()
        ]
        return pd.DataFrame(out, columns=names[:7], dtype=object)

    ends = tails.join(heads.withColumnRenamed("part", "next_part"), "next_part").select(
        finish(F.struct("id", "text", "fingerprint", "next_text", "next_print")).alias("r")
    ).select("r.*")
    return done.select(*names[:7]).union(ends).select(
        F.col("id").cast("long").alias(id_col), *names[1:7]
    )
