"""Packing documents into sequences of equal cost.

A document's cost is linear in its tokens plus quadratic, for attention within it.
Descending documents go to the cheapest sequence that still has room. Where none has
room for a whole document it is cut, so that every sequence is filled to its end.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewatch.llm.bytewords import Words, words_of_all

LENGTH = 2_048
END_ID = 1
# Cost of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 1_024
# Tokens packed together, so a task holds the pieces of some million tokens at most
# (more only for a single document that is longer).
BLOCK_TOKENS = 4_000_000
# Words whose ids a task remembers.
REMEMBERED = 500_000


@dataclass(frozen=True)
class Piece:
    """``length`` tokens of document number ``doc`` from ``start``, at ``offset`` of a sequence."""

    doc: int
    start: int
    length: int
    sequence: int
    offset: int


class Encoder:
    """Ids of texts by a tokenizer's file or its content, with the ids of words remembered.

    If the file lower-cases, cuts a text into words, digits and runs of signs, and encodes each
    on its own (``CUTTING``), texts of ASCII and Western European letters are cut here in the same way, many at
    once, and only words not met before are encoded, those of a portion in one call. Other texts,
    those with a shortened English verb, and all texts of other tokenizers go to the tokenizer whole.
    """

    def __init__(self, path: str | None = None, content: str | None = None):
        if content is None:
            with open(path, encoding="utf-8") as file:
                content = file.read()
        self._tokenizer = Tokenizer.from_str(content)
        self.cuts = _cuts_words(json.loads(content))
        self._forget()

    def _forget(self) -> None:
        # Known words in order of their numbers; ids of word k are flat[first[k]:first[k] + size[k]].
        self._numbers = np.empty(0, dtype=np.uint64)
        self._first, self._size = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        self._flat = np.empty(0, dtype="<u4")

    def ids(self, text: str) -> np.ndarray:
        return self.ids_of_all([text])[0]

    def ids_of_all(self, texts: list[str]) -> list[np.ndarray]:
        plain = [k for k, t in enumerate(texts) if self.cuts and _is_plain(t)]
        found: list[np.ndarray] = [None] * len(texts)
        data = [texts[k].lower().encode("latin-1") for k in plain]
        for begin, end, words in words_of_all(data, _KINDS, _DIGIT):
            ids, bounds = self._ids_of(words)
            for k in range(begin, end):
                found[plain[k]] = ids[bounds[k - begin] : bounds[k - begin + 1]]
        for k, ids in enumerate(found):
            if ids is None:
                encoded = self._tokenizer.encode(texts[k], add_special_tokens=False)
                found[k] = np.array(encoded.ids, dtype="<u4")
        return found

    def _ids_of(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and where those of each text begin."""
        at, known = self._find(words.numbers)
        if not known.all():
            self._learn(words, np.flatnonzero(~known))
            at, _ = self._find(words.numbers)
        size = self._size[at]
        ends = np.cumsum(size)
        take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self._first[at] - ends + size, size)
        return self._flat[take], np.concatenate([[0], ends])[words.first]

    def _find(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self._numbers):
            return np.zeros(len(numbers), dtype=np.int64), np.zeros(len(numbers), dtype=bool)
        at = np.minimum(np.searchsorted(self._numbers, numbers), len(self._numbers) - 1)
        return at, self._numbers[at] == numbers

    def _learn(self, words: Words, new: np.ndarray) -> None:
        if len(self._numbers) + len(new) > REMEMBERED:
            # Start again with this portion's words.
            self._forget()
            new = np.arange(len(words.numbers))
        numbers, first = np.unique(words.numbers[new], return_index=True)
        data, new = words.data.tobytes(), new[first]
        starts, ends = words.starts[new], words.ends[new]
        parts = [data[s:e] for s, e in zip(starts.tolist(), ends.tolist())]
        # Words of ASCII letters are what the model itself takes; the rest passes through all steps.
        plain = [p.isalpha() and p.isascii() for p in parts]
        tokenize, encode = self._tokenizer.model.tokenize, self._tokenizer.encode
        ids = [
            [t.id for t in tokenize(p.decode())] if x
            else encode(p.decode("latin-1"), add_special_tokens=False).ids
            for p, x in zip(parts, plain)
        ]
        sizes = np.array([len(x) for x in ids], dtype=np.int64)
        first = len(self._flat) + np.cumsum(sizes) - sizes
        self._flat = np.concatenate([self._flat, np.fromiter(chain.from_iterable(ids), "<u4", sizes.sum())])
        merged = np.concatenate([self._numbers, numbers])
        order = np.argsort(merged)
        self._numbers = merged[order]
        self._first = np.concatenate([self._first, first])[order]
        self._size = np.concatenate([self._size, sizes])[order]


# How a tokenizer's file says that it cuts texts as is done here (fixed values).
CUTTING = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [
            {"type": "NFC"},
            {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
            {"type": "Lowercase"},
        ],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def _cuts_words(file: dict) -> bool:
    """Whether a tokenizer's steps are those of ``CUTTING``, none goes over words, and added tokens can be told."""
    same = all(file.get(step) == how for step, how in CUTTING.items())
    plain = file.get("truncation") is None and file.get("padding") is None and file["model"].get("type") == "BPE"
    return same and plain and all(t["content"].startswith("<|") for t in file.get("added_tokens", ()))


# Signs of plain texts, as Latin-1 bytes: ASCII and Western European letters.
_PLAIN = bytes([*range(0x09, 0x0E), *range(0x20, 0x7F), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])
# An apostrophe with the letters that the tokenizer splits off.
_SHORTENED = re.compile("'(?:[stmd]|re|ve|ll)", re.IGNORECASE)


def _is_plain(text: str) -> bool:
    """Whether a text can be cut here: no other signs, nothing that may be a special token, no shortened verb."""
    try:
        data = text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return not (data.translate(None, _PLAIN) or b"<|" in data or (b"'" in data and _SHORTENED.search(text)))


# Classes of Latin-1 bytes after lower-casing, as the tokenizer cuts: letters, digits one by one, other signs.
_LETTER, _DIGIT, _SIGN = 1, 2, 3
_KINDS = np.full(256, _SIGN, dtype=np.uint8)
_KINDS[[0x20, *range(0x09, 0x0E)]] = 0
_KINDS[[*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100)]] = _LETTER
_KINDS[0x30:0x3A] = _DIGIT


def powers(tokens: int, length: int = LENGTH) -> list[int]:
    """Sequence lengths for so many tokens: full ones, then the rest as descending powers of two."""
    full, rest = divmod(tokens, length)
    return [length] * full + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def pack(lengths: list[int], length: int = LENGTH) -> list[Piece]:
    """Assign documents of ``lengths`` tokens to sequences; each token to one place, no place empty."""
    sizes = powers(sum(lengths), length)
    room = sizes.copy()
    # Longest first, of equals the first; long documents are cut to whole sequences.
    waiting = [(-min(n - s, length), doc, s) for doc, n in enumerate(lengths) for s in range(0, n, length)]
    heapq.heapify(waiting)
    cheapest = [(0.0, k) for k in range(len(sizes))]
    cost = [0.0] * len(sizes)
    tight: list[tuple[int, int]] = []
    pieces = []

    def place(doc: int, start: int, n: int, k: int) -> None:
        pieces.append(Piece(doc, start, n, k, sizes[k] - room[k]))
        room[k] -= n
        cost[k] += LINEAR * n + QUADRATIC * n * n
        if room[k]:
            heapq.heappush(cheapest, (cost[k], k))

    while waiting:
        negative, doc, start = heapq.heappop(waiting)
        n = -negative
        # Documents shrink as we go, so a sequence that had too little room may fit again.
        while tight and -tight[0][0] >= n:
            _, k = heapq.heappop(tight)
            heapq.heappush(cheapest, (cost[k], k))
        while cheapest:
            _, k = heapq.heappop(cheapest)
            if room[k] >= n:
                place(doc, start, n, k)
                break
            heapq.heappush(tight, (-room[k], k))
        else:
            _, k = heapq.heappop(tight)
            part = room[k]
            place(doc, start, part, k)
            heapq.heappush(waiting, (part - n, doc, start + part))
    return pieces


_PIECE = (
    "id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
_NAMES = [x.split()[0] for x in _PIECE.split(", ")]


def packed(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    end_id: int = END_ID,
    block_tokens: int = BLOCK_TOKENS,
    with_ids: bool = False,
) -> DataFrame:
    """One row for each piece of a document in a sequence; with ``ids``, its tokens, if asked for.

    A document's ids end with ``end_id``; a null text is one end. Documents are packed
    where they are read, some million tokens together, so nothing is shuffled. Sequences
    have ``length`` tokens, but for the rest of a block, which fills sequences of powers of two:
    no sequence needs padding. ``sequence_id`` is unique over all tasks. Null ids
    and repeated rows are packed like others; a table without rows gives none, and other columns are not read.
    """
    schema = _PIECE + (", ids array<int>" if with_ids else "")

    # Read here once and sent along: executors need not have the file, whose size does not depend on the documents.
    with open(tokenizer_path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(content=shared.value)
        sequences = 0
        names, tokens, total = [], [], 0
        for batch in batches:
            encoded = encoder.ids_of_all([t or "" for t in batch["text"]])
            for part, doc, ids in zip(batch["part"], batch["id"], encoded):
                base = int(part) << 33
                names.append(doc)
                tokens.append(np.append(ids, np.uint32(end_id)))
                total += len(tokens[-1])
                if total >= block_tokens:
                    yield from rows(names, tokens, base + sequences)
                    sequences += len(powers(total, length))
                    names, tokens, total = [], [], 0
        if tokens:
            yield from rows(names, tokens, base + sequences)

    def rows(names: list, tokens: list[np.ndarray], base: int) -> Iterator[pd.DataFrame]:
        found = pack([len(t) for t in tokens], length)
        for first in range(0, len(found), 10_000):
            out = []
            for p in found[first : first + 10_000]:
                ids = tokens[p.doc][p.start : p.start + p.length]
                row = (
                    names[p.doc], p.start, p.length, zlib.crc32(ids.astype("<u4").tobytes()),
                    len(tokens[p.doc]), base + p.sequence, p.offset,
                )
                out.append((*row, ids.astype(np.int32)) if with_ids else row)
            yield pd.DataFrame(out, columns=_NAMES + ["ids"] * with_ids)

    texts = docs.select(
        F.spark_partition_id().alias("part"),
        F.col(id_col).cast("string").alias("id"),
        F.col(text_col).alias("text"),
    )
    found = texts.mapInPandas(work, schema)
    rest = [c for c in found.columns if c != "id"]
    return found.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), *rest)
