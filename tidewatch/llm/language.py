"""Language identification by rank-order profiles of character n-grams.

A profile is the list of a text's most frequent n-grams, most frequent first. A
document is given the language whose profile has the smallest out-of-place
distance: the sum, over the document's n-grams, of how far each stands from its
place in the language's profile, or the profile's length if it is not in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Longest n-gram and length of a profile.
MAX_GRAM = 3
PROFILE = 400
UNDETERMINED = "und"
# A text further than this share of the largest possible distance from every language
# is in none of them.
FARTHEST = 0.9
# Bits of a code point inside the number of an n-gram.
_SHIFT = 21
# Characters of a language whose n-grams are counted at once.
CHARS_AT_ONCE = 4_000_000


# For each code point whether it is a letter.
_LETTERS = np.array([chr(i).isalpha() for i in range(0x110000)])


def letters_of(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text, with zero for what is no letter, between zeros."""
    raw = (text or "").lower().encode("utf-32-le", "surrogatepass")
    points = np.frombuffer(raw, dtype="<u4").astype(np.int64)
    points[~_LETTERS[points]] = 0
    return np.concatenate([[0], points, [0]])


def grams_of(points: np.ndarray, max_gram: int = MAX_GRAM) -> np.ndarray:
    """Numbers of all n-grams of 1 to ``max_gram`` signs; a word's edges count as a sign.

    Runs of non-letters count as one edge, and an n-gram that has an edge inside is left out.
    """
    before = np.concatenate([[1], points[:-1]])
    points = points[(points != 0) | (before != 0)]
    letter = points != 0
    found = [points[letter]]
    # As a sign an edge is 1, or an n-gram that begins with one would look like a shorter one.
    points = np.where(letter, points, 1)
    code = points
    for n in range(2, max_gram + 1):
        code = (code[:-1] << _SHIFT) | points[n - 1 :]
        inside = np.ones(len(code), dtype=bool)
        for k in range(1, n - 1):
            inside &= letter[k : k + len(code)]
        if n == 2:
            inside &= letter[:-1] | letter[1:]
        found.append(code[inside])
    return np.concatenate(found)


def counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ordered = np.sort(grams)
    if not len(ordered):
        return ordered, ordered
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[starts], np.diff(np.append(starts, len(ordered)))


def profile_of(grams: np.ndarray, length: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, most frequent first; of equals the smaller number."""
    codes, counts = counted(grams)
    return codes[np.argsort(-counts, kind="stable")[:length]]


@dataclass(frozen=True)
class Profiles:
    """Profiles of all languages, at most ``length`` n-grams each."""

    languages: tuple[str, ...]
    grams: tuple[np.ndarray, ...]
    length: int = PROFILE
    max_gram: int = MAX_GRAM

    def judge(self, text: str | None, farthest: float = FARTHEST) -> tuple[str, float, float]:
        """Language, score and distance (a share of the largest possible) of a text."""
        points = letters_of(text)
        if not self.languages or not points.any():
            return UNDETERMINED, 0.0, 1.0
        own = profile_of(grams_of(points, self.max_gram), self.length)
        place = np.arange(len(own))
        distances = []
        for sorted_grams, ranks in self._sorted:
            at = np.minimum(np.searchsorted(sorted_grams, own), len(sorted_grams) - 1)
            known = sorted_grams[at] == own
            gaps = np.where(known, np.abs(ranks[at] - place), self.length)
            distances.append(float(gaps.sum()) / (len(own) * self.length))
        order = np.argsort(distances, kind="stable")
        best = distances[order[0]]
        if best > farthest:
            return UNDETERMINED, 0.0, best
        near = np.exp(-(np.array(distances) - best) * len(own) ** 0.5)
        return self.languages[order[0]], float(1.0 / near.sum()), best

    @property
    def _sorted(self) -> list[tuple[np.ndarray, np.ndarray]]:
        key = "_by_code"
        if key not in self.__dict__:
            by_code = []
            for grams in self.grams:
                order = np.argsort(grams)
                by_code.append((grams[order], order))
            self.__dict__[key] = by_code
        return self.__dict__[key]


def fit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
    max_gram: int = MAX_GRAM, length: int = PROFILE,
) -> Profiles:
    """Profiles of every language in ``docs``, counted over all its texts.

    Rows without a language or text teach nothing. N-grams are counted per batch and
    language in the tasks and summed by Spark; the driver gets ``length`` rows a
    language. Of equally frequent n-grams the smaller number comes first.
    """
    usable = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                for part in _portions(texts):
                    signs = np.concatenate([letters_of(t) for t in part])
                    codes, counts = counted(grams_of(signs, max_gram))
                    yield pd.DataFrame({"lang": lang, "gram": codes, "n": counts})

    counts = (
        usable.where("lang is not null and text is not null")
        .mapInPandas(count, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= length)
    rows = sorted(top.select("lang", "place", "gram").collect())
    languages = sorted({r["lang"] for r in rows})
    grams = tuple(
        np.array([r["gram"] for r in rows if r["lang"] == x], dtype=np.int64) for x in languages
    )
    return Profiles(tuple(languages), grams, length, max_gram)


def _portions(texts: pd.Series) -> Iterator[list[str]]:
    """Texts in lists of some million characters."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= CHARS_AT_ONCE:
            yield held
            held, size = [], 0
    if held:
        yield held


def judged(profiles: Profiles, text: Column, farthest: float = FARTHEST) -> Column:
    """``struct<lang, score, distance>`` of a text.

    Null, blank and letterless texts, and texts too far from every language, are ``und`` with
    score 0. The score of others is the share of the nearest language among weights that
    fall with its distance, between 0 and 1; equal distances go to the language first by name.
    """

    @F.pandas_udf("lang string, score double, distance double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        rows = [profiles.judge(t, farthest) for t in texts]
        return pd.DataFrame(rows, columns=["lang", "score", "distance"])

    return judge(text)
