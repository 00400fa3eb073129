"""Language model: hierarchical Pitman-Yor process, sampled by Gibbs.

Words are dishes. A restaurant stands for a context: the last two bytes of the word
before; its parent is that of the last byte, and theirs the one root restaurant, which draws
from equally likely words. A dish's tables in a restaurant are its customers in the parent.
Each sweep takes the customers of every dish out and seats them again, given the tables of
all other dishes; predictive probabilities are averaged over sweeps.

The contexts are bounded (65,536, 256 and 1), so what restaurants share is of fixed
size; all that is kept by word is dealt out by word. Documents are read in portions (some
thousand rows of a file), which send their distinct words and contexts to the words' owners
and get back a probability for each.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.bytewords import UNSPACED, Words, lowered, words_of_all
from tidewatch.session import written

FINE, COARSE = 1 << 16, 1 << 8
# Discount and strength of the fine, coarse and root restaurants (fixed values).
DISCOUNT, STRENGTH = (0.8, 0.75, 0.7), (1.0, 1.0, 1.0)
# Exchanges of the restaurants' totals between all words, and sweeps in the last: those
# that are thrown away and those that are averaged.
EXCHANGES, BURN_IN, AVERAGED = 2, 2, 4
# Customers of a dish that are seated one by one; further ones are seated in groups that
# double in size, each with the chance of a new table at its middle.
SEATED_SINGLY = 48
SEED = 42
# Number of the end of a text; no word has it but for a chance of 1 in 2**64.
END = np.uint64(0xE4D0F7E87)
# Base model: added count.
ADDED = 0.1
# Rows of a portion.
PORTION_ROWS = 4_096


@dataclass
class Tokens:
    """Tokens of texts, an end after each text's words: number, context, and the text they are in."""

    number: np.ndarray
    context: np.ndarray
    text: np.ndarray


def _tokens(words: Words) -> Tokens:
    """The context of a word is the last two bytes of the word before it, 0 for a text's first."""
    total = np.diff(words.first)
    owner = np.repeat(np.arange(len(total)), total)
    at = np.arange(len(owner)) + owner
    ends = words.first[1:] + np.arange(len(total))
    size = len(owner) + len(total)
    number, last, text = np.empty(size, np.uint64), np.zeros(size, np.int64), np.empty(size, np.int64)
    number[at], number[ends] = words.numbers, END
    text[at], text[ends] = owner, np.arange(len(total))
    data = words.data
    if len(at):
        second = np.where(words.ends - words.starts > 1, data[np.maximum(words.ends - 2, 0)], 0)
        last[at] = data[words.ends - 1].astype(np.int64) << 8 | second
    # An end has no last bytes, so the word after it has context 0.
    return Tokens(number, np.concatenate([[0], last[:-1]])[:size], text)


def _pairs(number: np.ndarray, context: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (word, context) in order with the sums of their weights."""
    order = np.lexsort((context, number))
    number, context, weight = number[order], context[order], weight[order]
    new = np.ones(len(number), dtype=bool)
    new[1:] = (number[1:] != number[:-1]) | (context[1:] != context[:-1])
    at = np.flatnonzero(new)
    return number[at], context[at], np.add.reduceat(weight, at) if len(at) else weight


def seat(
    customers: np.ndarray, others: np.ndarray, dish: np.ndarray,
    discount: float, strength: float, random: np.random.Generator,
) -> np.ndarray:
    """Tables of each dish after its customers have taken seats, one after the other.

    ``others`` are the restaurant's tables of other dishes and ``dish`` the parent's
    probability of the dish. A customer opens a table with weight (strength + discount *
    all tables) * dish, or joins one of the dish with weight (its customers so far - discount * its
    tables).
    """
    tables = np.minimum(customers, 1).astype(np.float64)
    active = np.flatnonzero(customers > 1)
    seated, group = 1, 1
    while len(active):
        take = np.minimum(group, customers[active] - seated)
        open_weight = (strength + discount * (others[active] + tables[active])) * dish[active]
        join_weight = seated + (take - 1) / 2 - discount * tables[active]
        chance = open_weight / (open_weight + np.maximum(join_weight, 1e-12))
        if group == 1:
            tables[active] += random.random(len(active)) < chance
        else:
            tables[active] += random.binomial(take.astype(np.int64), np.minimum(chance, 1.0))
        seated += group
        if seated >= SEATED_SINGLY:
            group = seated
        active = active[customers[active] > seated]
    return tables


@dataclass
class Totals:
    """What restaurants share over all words: customers and tables of each, by level."""

    customers: tuple[np.ndarray, np.ndarray, np.ndarray]
    tables: tuple[np.ndarray, np.ndarray, np.ndarray]

    def predict(self, level: int, context: np.ndarray, own: np.ndarray, tables: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """Probability of dishes with ``own`` customers and ``tables`` in restaurants ``context``."""
        d, s = DISCOUNT[level], STRENGTH[level]
        all_customers, all_tables = self.customers[level][context], self.tables[level][context]
        return (own - d * tables + (s + d * all_tables) * parent) / (s + all_customers)


@dataclass
class Counts:
    """Training counts of some words: sorted (word, fine context) pairs and their coarse and word groups."""

    number: np.ndarray
    context: np.ndarray
    count: np.ndarray

    def __post_init__(self) -> None:
        coarse = self.context >> 8
        new_word = np.ones(len(self.number), dtype=bool)
        new_word[1:] = self.number[1:] != self.number[:-1]
        new_coarse = new_word.copy()
        new_coarse[1:] |= coarse[1:] != coarse[:-1]
        self.coarse_at, self.word_at = np.flatnonzero(new_coarse), np.flatnonzero(new_word)
        self.coarse_of = np.cumsum(new_coarse) - 1
        self.coarse = coarse[self.coarse_at]
        self.word_of = np.cumsum(new_word[self.coarse_at]) - 1
        self.words = self.number[self.word_at]

    def sums(self, values: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(groups, weights=values, minlength=n)


class State:
    """Tables of some words in all restaurants, and the probabilities they give."""

    def __init__(self, counts: Counts, totals: Totals | None, words: int):
        self.counts, self.totals = counts, totals
        self.base = 1.0 / (words + 1)
        n = len(counts.coarse), len(counts.words)
        # To begin with every dish has one table in each restaurant.
        self.fine = np.ones(len(counts.number))
        self.coarse_customers = counts.sums(self.fine, counts.coarse_of, n[0])
        self.coarse = np.ones(n[0])
        self.root_customers = counts.sums(self.coarse, counts.word_of, n[1])
        self.root = np.ones(n[1])

    def probabilities(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word at the root, each (word, coarse) and each pair."""
        c, t = self.counts, self.totals
        root = t.predict(2, np.zeros(len(self.root), int), self.root_customers, self.root, np.full(len(self.root), self.base))
        coarse = t.predict(1, c.coarse, self.coarse_customers, self.coarse, root[c.word_of])
        fine = t.predict(0, c.context, c.count, self.fine, coarse[c.coarse_of])
        return root, coarse, fine

    def sweep(self, random: np.random.Generator) -> None:
        """Seat the customers of every dish anew, from the fine restaurants to the root."""
        c, t = self.counts, self.totals
        root, coarse, _ = self.probabilities()
        others = t.tables[0][c.context] - self.fine
        self.fine = seat(c.count, np.maximum(others, 0), coarse[c.coarse_of], DISCOUNT[0], STRENGTH[0], random)
        self.coarse_customers = c.sums(self.fine, c.coarse_of, len(c.coarse))
        others = t.tables[1][c.coarse] - self.coarse
        self.coarse = seat(self.coarse_customers, np.maximum(others, 0), root[c.word_of], DISCOUNT[1], STRENGTH[1], random)
        self.root_customers = c.sums(self.coarse, c.word_of, len(c.words))
        others = np.maximum(t.tables[2][0] - self.root, 0)
        self.root = seat(self.root_customers, others, np.full(len(self.root), self.base), DISCOUNT[2], STRENGTH[2], random)

    def shares(self) -> pd.DataFrame:
        """This part's share of the totals, by level and restaurant."""
        c = self.counts
        rows = []
        for level, context, own, tables in (
            (0, c.context, c.count, self.fine),
            (1, c.coarse, self.coarse_customers, self.coarse),
            (2, np.zeros(len(self.root), int), self.root_customers, self.root),
        ):
            n = (FINE, COARSE, 1)[level]
            own, tables = (np.bincount(context, weights=x, minlength=n) for x in (own, tables))
            used = np.flatnonzero(own)
            rows.append(pd.DataFrame({"level": level, "context": used, "customers": own[used], "tables": tables[used]}))
        return pd.concat(rows)


def _portioned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``portion, id, text``: rows with a number for their stretch of their file.

    Files and the rows' places in them stay the same however a scan is split, so
    reading twice gives equal portions. A frame that is not read from files is written first.
    """
    place = F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / PORTION_ROWS))
    columns = F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")
    try:
        return docs.select(place.alias("portion"), *columns)
    except AnalysisException:
        return written(docs.select(*columns)).select(place.alias("portion"), "id", "text")


_ROWS = "owner int, portion long, words binary, sizes binary, contexts binary, counts binary"
_NAMES = [x.split()[0] for x in _ROWS.split(", ")]


def _send(owners: int, taught: Callable[[pd.Series], np.ndarray]) -> Callable:
    """Portions' distinct (word, context) pairs with their training counts, by the words' owners.

    A portion that a scan splits is sent in parts.
    """

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        portion = None
        for batch in batches:
            for key, rows in batch.groupby("portion", sort=False):
                if portion is not None and key != portion:
                    yield from parts(portion, held)
                    held = []
                portion = key
                held.append(_pairs_of_texts(rows["text"].tolist(), taught(rows["id"])))
        if held:
            yield from parts(portion, held)

    def parts(portion: int, held: list[tuple]) -> Iterator[pd.DataFrame]:
        number, context, count = _pairs(*(np.concatenate(x) for x in zip(*held)))
        owner = _owner(number, owners)
        rows = []
        for k in np.unique(owner):
            mine = np.flatnonzero(owner == k)
            words, at = np.unique(number[mine], return_index=True)
            sizes = np.diff(np.append(at, len(mine)))
            data = words, sizes.astype("<u4"), context[mine].astype("<u2"), count[mine].astype("<u8")
            rows.append((k, portion, *(x.tobytes() for x in data)))
        yield pd.DataFrame(rows, columns=_NAMES)

    return send


def _owner(number: np.ndarray, owners: int) -> np.ndarray:
    return ((number >> np.uint64(33)) % np.uint64(owners)).astype(np.int64)


def _pairs_of_texts(texts: list[str | None], taught: np.ndarray) -> tuple[np.ndarray, ...]:
    held = []
    for begin, end, words in words_of_all([lowered(t) for t in texts], UNSPACED):
        tokens = _tokens(words)
        held.append(_pairs(tokens.number, tokens.context, taught[begin:end][tokens.text].astype(np.int64)))
    return _pairs(*(np.concatenate(x) for x in zip(*held)))


def _received(words: bytes, sizes: bytes, contexts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return (
        np.repeat(np.frombuffer(words, dtype=np.uint64), np.frombuffer(sizes, dtype="<u4")),
        np.frombuffer(contexts, dtype="<u2").astype(np.int64),
    )


_OWNED = (
    "owner int, number binary, context binary, count binary, "
    "asked array<struct<portion:long,words:binary,sizes:binary,contexts:binary>>"
)


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    """An owner's training counts over all portions, and what each portion asks."""
    pairs = [_received(*x) for x in zip(rows["words"], rows["sizes"], rows["contexts"])]
    counts = [np.frombuffer(x, dtype="<u8").astype(np.int64) for x in rows["counts"]]
    number, context, count = _pairs(
        *(np.concatenate(x) for x in zip(*pairs)), np.concatenate(counts)
    )
    kept = count > 0
    asked = rows[["portion", "words", "sizes", "contexts"]].to_dict("records")
    return pd.DataFrame(
        {
            "owner": [int(rows["owner"].iloc[0])],
            "number": [number[kept].tobytes()],
            "context": [context[kept].astype("<u2").tobytes()],
            "count": [count[kept].astype("<u8").tobytes()],
            "asked": [asked],
        }
    )


def _counts(row) -> Counts:
    return Counts(
        np.frombuffer(row.number, dtype=np.uint64),
        np.frombuffer(row.context, dtype="<u2").astype(np.int64),
        np.frombuffer(row.count_, dtype="<u8").astype(np.float64),
    )


def _owned_rows(batches: Iterator[pd.DataFrame]) -> Iterator:
    for batch in batches:
        yield from batch.rename(columns={"count": "count_"}).itertuples(index=False)


def _totals_of(parts: DataFrame) -> Totals:
    """Sum of all owners' shares; at most 65,793 rows reach the driver, whatever the input."""
    sums = parts.groupBy("level", "context").agg(F.sum("customers").alias("c"), F.sum("tables").alias("t")).toPandas()
    found = []
    for column in ("c", "t"):
        levels = []
        for level, n in enumerate((FINE, COARSE, 1)):
            rows = sums[sums["level"] == level]
            values = np.zeros(n)
            values[rows["context"].to_numpy()] = rows[column].to_numpy()
            levels.append(values)
        found.append(tuple(levels))
    return Totals(found[0], found[1])


def scored(
    docs: DataFrame, held_out: Callable[[pd.Series], np.ndarray],
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Each document's log10 probability under the model and under a unigram model.

    ``held_out`` tells from a batch of ids, as text (null: no id), which documents teach nothing. Returns
    ``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row, repeated ones too; a null
    text is empty and has its end as the only token. Words that training lacks share the root's
    chance of an unseen word. ``docs`` is read twice. Other columns are not read.
    """
    spark = docs.sparkSession
    owners = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = _portioned(docs, id_col, text_col)
    sent = texts.mapInPandas(_send(owners, lambda ids: ~held_out(ids)), _ROWS)
    owned = written(sent.groupBy("owner").applyInPandas(_merge, _OWNED))
    counts_only = owned.drop("asked")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in _owned_rows(batches):
            counts = _counts(row)
            yield pd.DataFrame({"words": [len(counts.words)], "tokens": [int(counts.count.sum())]})

    size = counts_only.mapInPandas(measure, "words long, tokens long").agg(
        F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))
    ).first()
    words, train_tokens = int(size[0]), int(size[1])

    def exchanged(number: int, totals: Totals | None) -> Totals:
        shared = spark.sparkContext.broadcast(totals and (totals.customers, totals.tables))

        def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for row in _owned_rows(batches):
                state = State(_counts(row), shared.value and Totals(*shared.value), words)
                random = np.random.default_rng((SEED, row.owner, number))
                for _ in range(BURN_IN if number else 0):
                    state.sweep(random)
                yield state.shares()

        shares = "level int, context int, customers double, tables double"
        return _totals_of(counts_only.mapInPandas(move, shares))

    totals = exchanged(0, None)
    for number in range(1, EXCHANGES + 1):
        totals = exchanged(number, totals)
    shared = spark.sparkContext.broadcast((totals.customers, totals.tables))

    def reply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in _owned_rows(batches):
            yield _answers(row, Totals(*shared.value), words)

    answers = owned.mapInPandas(reply, _ANSWER)

    def score(docs: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        return _score(docs, answer, held_out, train_tokens, words)

    result = "id string, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    found = texts.groupBy("portion").cogroup(answers.groupBy("portion")).applyInPandas(score, result)
    return found.select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "held_out", "n_tokens", "n_known",
        F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )


_ANSWER = "portion long, words binary, sizes binary, contexts binary, known binary, logs binary"


def _answers(row, totals: Totals, words: int) -> pd.DataFrame:
    """To each portion that asked: the words' counts and the averaged log10 probabilities."""
    counts = _counts(row)
    state = State(counts, totals, words)
    random = np.random.default_rng((SEED, row.owner, EXCHANGES + 1))
    for _ in range(BURN_IN):
        state.sweep(random)
    pairs = [_received(x["words"], x["sizes"], x["contexts"]) for x in row.asked]
    finders = [_Finder(counts, *p) for p in pairs]
    sums = [np.zeros(len(p[0])) for p in pairs]
    for _ in range(AVERAGED):
        state.sweep(random)
        found = state.probabilities()
        for total, finder in zip(sums, finders):
            total += finder.values(state, found)
    by_word = counts.sums(counts.count, counts.word_of[counts.coarse_of], len(counts.words))
    out = []
    for asked, (number, _), finder, total in zip(row.asked, pairs, finders, sums):
        first = np.ones(len(number), dtype=bool)
        first[1:] = number[1:] != number[:-1]
        known = np.where(finder.known, _at(by_word, finder.word), 0)[first]
        logs = np.log10(total / AVERAGED)
        out.append(
            (asked["portion"], asked["words"], asked["sizes"], asked["contexts"],
             known.astype("<u8").tobytes(), logs.astype("<f4").tobytes())
        )
    return pd.DataFrame(out, columns=[x.split()[0] for x in _ANSWER.split(", ")])


class _Finder:
    """Where asked pairs stand among an owner's training pairs, on each level."""

    def __init__(self, counts: Counts, number: np.ndarray, context: np.ndarray):
        self.context = context
        self.word, self.known = _places(counts.words, number)
        word_of_coarse = counts.word_of.astype(np.uint64)
        self.coarse, self.in_coarse = _places(
            word_of_coarse << np.uint64(8) | counts.coarse.astype(np.uint64),
            self.word.astype(np.uint64) << np.uint64(8) | (context >> 8).astype(np.uint64),
        )
        self.in_coarse &= self.known
        word_of_fine = counts.word_of[counts.coarse_of].astype(np.uint64) if len(counts.word_of) else word_of_coarse
        self.fine, self.in_fine = _places(
            word_of_fine << np.uint64(16) | counts.context.astype(np.uint64),
            self.word.astype(np.uint64) << np.uint64(16) | context.astype(np.uint64),
        )
        self.in_fine &= self.known

    def values(self, state: State, found: tuple[np.ndarray, ...]) -> np.ndarray:
        """Probability of each asked word in its context; an unseen dish has what its parent gives it."""
        totals = state.totals
        none = np.zeros(1)
        unseen = totals.predict(2, np.zeros(1, int), none, none, np.full(1, state.base))[0]
        root = np.where(self.known, _at(found[0], self.word), unseen)
        passed = totals.predict(1, self.context >> 8, 0.0, 0.0, root)
        coarse = np.where(self.in_coarse, _at(found[1], self.coarse), passed)
        passed = totals.predict(0, self.context, 0.0, 0.0, coarse)
        return np.where(self.in_fine, _at(found[2], self.fine), passed)


def _at(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    return values[places] if len(values) else np.zeros(len(places))


def _places(known: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``asked`` in sorted ``known``, and whether they are there."""
    if not len(known):
        return np.zeros(len(asked), dtype=np.int64), np.zeros(len(asked), dtype=bool)
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return at, known[at] == asked


def _score(docs: pd.DataFrame, answer: pd.DataFrame, held_out, train_tokens: int, words: int) -> pd.DataFrame:
    if not len(docs):
        return pd.DataFrame(columns=["id", "held_out", "n_tokens", "n_known", "base_score", "score"])
    numbers, contexts, known, logs = [], [], [], []
    for row in answer.itertuples():
        number, context = _received(row.words, row.sizes, row.contexts)
        numbers.append(number)
        contexts.append(context)
        known.append(np.repeat(np.frombuffer(row.known, dtype="<u8"), np.frombuffer(row.sizes, dtype="<u4")))
        logs.append(np.frombuffer(row.logs, dtype="<f4"))
    number, context, known, logs = (np.concatenate(x) for x in (numbers, contexts, known, logs))
    # A pair that two parts of the portion asked for stands twice, with the same answer.
    order = np.lexsort((context, number))
    number, context = number[order], context[order]
    known, logs = known[order].astype(np.float64), logs[order].astype(np.float64)
    new = np.ones(len(number), dtype=bool)
    new[1:] = number[1:] != number[:-1]
    word_numbers, known = number[new], known[new]
    pair_key = (np.cumsum(new) - 1) << 16 | context
    base = np.log10((known + ADDED) / (train_tokens + ADDED * (words + 1)))
    out = []
    texts = [lowered(t) for t in docs["text"]]
    for begin, end, some in words_of_all(texts, UNSPACED):
        tokens = _tokens(some)
        word, there = _places(word_numbers, tokens.number)
        pair, asked = _places(pair_key, word << 16 | tokens.context)
        if not (there & asked).all():
            raise ValueError("docs changed between two readings")
        n = end - begin
        out.append(
            pd.DataFrame(
                {
                    "n_tokens": np.bincount(tokens.text, minlength=n),
                    "n_known": np.bincount(tokens.text, weights=known[word] > 0, minlength=n).astype(np.int64),
                    "base_score": np.bincount(tokens.text, weights=base[word], minlength=n),
                    "score": np.bincount(tokens.text, weights=logs[pair], minlength=n),
                }
            )
        )
    scores = pd.concat(out, ignore_index=True)
    scores.insert(0, "id", docs["id"].to_numpy())
    scores.insert(1, "held_out", held_out(docs["id"]))
    return scores


def one_in(number: int, modulus: int) -> Callable[[pd.Series], np.ndarray]:
    """Whether the CRC-32 of an id's text leaves ``number``; a null id does not."""

    def chosen(ids: pd.Series) -> np.ndarray:
        return np.array([x is not None and zlib.crc32(x.encode()) % modulus == number for x in ids], dtype=bool)

    return chosen
