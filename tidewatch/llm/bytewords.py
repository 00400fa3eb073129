"""Words of many texts at once, as 64-bit numbers, by arithmetic over their bytes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

# Bytes of text worked on together; a longer text is worked on alone.
BYTES_AT_ONCE = 1 << 20
_ODD = np.uint64(0x9FB21C651E98DF25)
_MIX = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Words:
    """Words of some texts: byte ``starts`` and ``ends``, ``numbers``, and where each text's words begin.

    Words of text t are those from ``first[t]`` to ``first[t + 1]``. Equal words have equal numbers;
    different ones have different numbers but for a chance of about 1 in 2**64 a pair.
    """

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    numbers: np.ndarray
    first: np.ndarray

    def word(self, at: int) -> bytes:
        return self.data[self.starts[at] : self.ends[at]].tobytes()


def table(members: Sequence[int]) -> np.ndarray:
    """A class for each byte: 1 for ``members``, 0 for bytes that part words."""
    kinds = np.zeros(256, dtype=np.uint8)
    kinds[list(members)] = 1
    return kinds


def _byte_values() -> np.ndarray:
    """A fixed number for each byte."""
    x = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for _ in range(2):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


_VALUES = _byte_values()


def powers(base: int, length: int) -> np.ndarray:
    """1, base, base squared and so on, without what goes over 64 bits."""
    steps = np.full(length, base, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def words_in(
    data: np.ndarray, bounds: np.ndarray, kinds: np.ndarray, alone: int,
    up: np.ndarray, down: np.ndarray,
) -> Words:
    """Words of texts that stand one after the other in ``data``, text t from ``bounds[t]``.

    A word is a run of bytes of one class other than 0; bytes of class ``alone`` are
    words of their own. No word reaches over a text's end. ``up`` and ``down`` are powers of
    one odd number and of its inverse, as many as there are bytes and one more.
    """
    kind = kinds[data]
    edge = np.ones(len(data) + 1, dtype=bool)
    edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == alone)
    edge[bounds] = True
    cuts = np.flatnonzero(edge)
    inside = kind[np.minimum(cuts[:-1], max(0, len(data) - 1))] != 0 if len(data) else np.empty(0, bool)
    starts, ends = cuts[:-1][inside], cuts[1:][inside]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=sums[1:])
    numbers = (sums[ends] - sums[starts]) * down[starts]
    numbers = (numbers ^ (numbers >> np.uint64(32)) ^ (ends - starts).astype(np.uint64)) * _MIX
    numbers ^= numbers >> np.uint64(29)
    return Words(data, starts, ends, numbers, np.searchsorted(starts, bounds))


def portions(texts: Sequence[bytes], most: int = BYTES_AT_ONCE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together, one text at least."""
    begin, held = 0, 0
    for at, text in enumerate(texts):
        if held and held + len(text) > most:
            yield begin, at
            begin, held = at, 0
        held += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def words_of_all(texts: Sequence[bytes], kinds: np.ndarray, alone: int = 255) -> Iterator[tuple[int, int, Words]]:
    """``from, to, words`` for ranges of texts, all together in order."""
    longest = max((sum(map(len, texts[b:e])) for b, e in portions(texts)), default=0) + 1
    up, down = powers(int(_ODD), longest), powers(pow(int(_ODD), -1, 1 << 64), longest)
    for begin, end in portions(texts):
        some = texts[begin:end]
        data = np.frombuffer(b"".join(some), dtype=np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in some])]).astype(np.int64)
        yield begin, end, words_in(data, bounds, kinds, alone, up, down)


def lowered(text: str | None) -> bytes:
    """UTF-8 of a text with A-Z lower-cased; a null text is empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


# Everything but the ASCII white space (space and 0x09 to 0x0D).
UNSPACED = table([b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D])
# Digits, small letters and every byte beyond ASCII.
ALPHANUMERIC = table([b for b in range(256) if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80])
