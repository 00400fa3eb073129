"""Helpers of the text operators: names, places of matches inside a row, components of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import written

# Rows of numbers summed at a time when running totals are built inside a row.
BLOCK = 64


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it in inner functions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_totals(numbers: Column) -> Column:
    """Sum of all numbers before each one, for an array of integers, inside the row.

    Totals of blocks of 64 are built first, so a row with n numbers costs about
    64 n steps and not n squared.
    """

    def totals(numbers: Column) -> Column:
        last = F.floor((F.size(numbers) - 1) / BLOCK).cast("int")
        blocks = F.transform(
            F.sequence(F.lit(0), last),
            lambda b: _total(F.slice(numbers, b * BLOCK + 1, F.lit(BLOCK))),
        )
        before = F.aggregate(
            blocks,
            F.array(F.lit(0).cast("long")),
            lambda sums, x: F.array_append(sums, F.element_at(sums, -1) + x),
        )
        return bound(before, lambda known: F.transform(numbers, lambda _, i: _before(numbers, known, i)))

    return bound(
        numbers,
        lambda x: F.when(F.size(x) > 0, totals(x)).otherwise(F.array().cast("array<bigint>")),
    )


def _before(numbers: Column, known: Column, i: Column) -> Column:
    block = F.floor(i / BLOCK).cast("int")
    return F.get(known, block) + _total(F.slice(numbers, block * BLOCK + 1, i - block * BLOCK))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda total, x: total + x)


def pattern_matches(text: Column, pattern: str) -> Column:
    """Matches of a Java pattern: ``array<struct<start, end, match>>``, in code points, end exclusive.

    A text is cut at the matches, so lengths of what lies between give the places.
    The pattern must not match an empty string.
    """
    pieces = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, match: F.struct(
            F.length(gap).alias("gap"), F.length(match).alias("size"), match.alias("match")
        ),
    )
    found = F.filter(pieces, lambda x: x["match"].isNotNull())
    return bound(
        found,
        lambda rows: F.zip_with(
            rows,
            running_totals(F.transform(rows, lambda x: x["gap"] + x["size"])),
            lambda x, before: F.struct(
                (before + x["gap"]).alias("start"),
                (before + x["gap"] + x["size"]).alias("end"),
                x["match"].alias("match"),
            ),
        ),
    )


def bit_filter(rows: DataFrame, key: str, bits: int) -> np.ndarray:
    """Longs with a bit for each value of the long ``key``, ``bits`` bits in all whatever the table's size.

    The driver gets a long for each 64 bits at most. Values that share a bit cannot be told apart.
    """
    bit = F.pmod(key, F.lit(bits))
    parts = rows.groupBy(F.floor(bit / 64).cast("int").alias("at")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))).alias("bits")
    )
    found = parts.toArrow()
    known = np.zeros(max(1, bits // 64), dtype=np.int64)
    known[found["at"].to_numpy()] = found["bits"].to_numpy()
    return known


def may_hold(known: np.ndarray, key: Column, bits: int) -> Column:
    """Whether a small filter, a literal of the plan, has the bit of a value; true for all that it was made of."""
    bit = F.pmod(key, F.lit(bits))
    return F.getbit(F.get(F.lit(known), F.floor(bit / 64).cast("int")), (bit % 64).cast("int")) == 1


def components(links: DataFrame) -> DataFrame:
    """``node, root``: the smallest node reachable over ``links(a, b)``, for every linked node.

    Alternates the large-star and small-star steps, each of which points nodes at
    the smallest neighbour they know. Smallest neighbours are found by grouping with
    partial sums and joined back, so a node with very many links is split like any
    skewed join key. Each round is written to the shared folder; the driver sees two
    numbers a round.
    """
    edges = written(
        links.where("a <> b").select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        ).distinct()
    )
    before = None
    while True:
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if after == before or not after[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
        edges = written(_small_star(_large_star(edges)))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("least"))
    return both.where("v > u").join(least, "u").select(
        F.col("v").alias("a"), F.least("u", "least").alias("b")
    )


def _small_star(edges: DataFrame) -> DataFrame:
    # All edges point down here: ``b`` is smaller than ``a``.
    down = edges.distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()
