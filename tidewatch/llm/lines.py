"""Removal of repeated passages by winnowed line hashes.

A text is cut at line ends and after sentences. From each line the shortest stretch of lines with
enough words that begins there is a window, and the shortest that ends there. A window's fingerprint is the line
of least hash in it, so equal windows have equal fingerprints, and neighbours mostly the same one. Fingerprints of
several documents are joined first; only windows around those are compared. A match extends both ways as
far as windows that begin or end in it are equal too: whatever repeats and is long enough is covered by such windows, so the
later copies of them all go, and none is missed. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import bit_filter, bound, fresh, may_hold
from tidewatch.session import written

# Words of a run that is removed.
LEAST_WORDS = 25
# A line: up to and with a line end, or the blank after a sentence's last sign (and up to three other signs).
_END = r"[.!?][^\p{L}\p{N}\s]{0,3}[ \t]"
LINE = r"(?:[^\n.!?]++|[.!?](?![^\p{L}\p{N}\s]{0,3}[ \t]))*+(?:\n|" + _END + r"|\z)"
# Bits of the set of fingerprints that several documents have: 512 KB in a plan, whatever the table's
# size. If it is full, more windows are compared and none is lost.
FILTER_BITS = 1 << 22

_RUNS = "array<struct<first:int,last:int>>"


def lines_of(text: Column) -> Column:
    """The lines of a text with their ends; joined they are the text again."""
    return F.filter(F.regexp_extract_all(text, F.lit(LINE), F.lit(0)), lambda line: line != "")


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\n"))


def _words(line: Column) -> Column:
    """Words of a bare line: runs of other signs than blanks."""
    # Without neighbouring blanks their number tells, which is much quicker.
    single = F.when(line == "", 0).otherwise(
        F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    )
    return F.when(F.contains(line, F.lit("  ")), F.regexp_count(line, F.lit("[^ ]++"))).otherwise(single)


def _windows(hashes: Column, words: Column, least_words: int) -> Column:
    """``array<struct<h, first, last>>``, sorted: the shortest stretches of lines with enough words.

    From each line the shortest such stretch that begins there, and the shortest that ends there. Both depend on the
    lines inside alone, and those inside a run of enough words cover it: so a line is in a run that stands
    at another place exactly if it is in such a stretch that does. Blank lines at an edge are counted, not hashed.
    """
    lines = F.transform(words, lambda w, i: F.array_repeat(i, w))
    firsts = F.transform(
        F.filter(words, lambda w: w > 0), lambda w: F.concat(F.array(F.lit(True)), F.array_repeat(F.lit(False), w - 1))
    )

    def begins(first: Column) -> Column:
        """Words that a stretch begins with, told by which words are a line's first."""
        over = F.size(first) - least_words

        def edge(k: Column) -> Column:
            return F.get(first, k) | F.coalesce(F.get(first, k + least_words), F.lit(True))

        places = F.filter(F.sequence(F.lit(0), over), edge)
        return F.when(over >= 0, places).otherwise(F.array().cast("array<int>"))

    def place(of: Column, k: Column, blanks: bool) -> Column:
        """A stretch's lines with words, and how many blank lines stand before and after it."""
        first, last = F.get(of, k), F.get(of, k + least_words - 1)
        if not blanks:
            return F.struct(first.alias("first"), last.alias("last"))
        low, high = F.coalesce(F.get(of, k - 1), F.lit(-1)), F.coalesce(F.get(of, k + least_words), F.size(words))
        return F.struct(
            first.alias("first"),
            last.alias("last"),
            F.greatest(first - low - 1, F.lit(0)).alias("leads"),
            F.greatest(high - last - 1, F.lit(0)).alias("trails"),
        )

    def window(h: Column, first: Column, last: Column) -> Column:
        return F.struct(h.alias("h"), first.alias("first"), last.alias("last"))

    def alone(x: Column, h: Column) -> Column:
        return window(F.xxhash64(F.slice(h, x["first"] + 1, x["last"] - x["first"] + 1)), x["first"], x["last"])

    def with_blanks(x: Column, h: Column) -> Column:
        return bound(
            alone(x, h),
            lambda w: F.concat(
                F.array(w),
                F.transform(
                    F.filter(F.sequence(F.lit(0), x["leads"]), lambda n: n > 0),
                    lambda n: window(F.xxhash64(w["h"], n, F.lit(0)), w["first"] - n, w["last"]),
                ),
                F.transform(
                    F.filter(F.sequence(F.lit(0), x["trails"]), lambda n: n > 0),
                    lambda n: window(F.xxhash64(w["h"], F.lit(0), n), w["first"], w["last"] + n),
                ),
            ),
        )

    def stretches(of: Column, blanks: bool) -> Column:
        return F.transform(bound(F.flatten(firsts), begins), lambda k: place(of, k, blanks))

    def hashed(h: Column) -> Column:
        def of_lines(of: Column) -> Column:
            plain = F.transform(stretches(of, False), lambda x: alone(x, h))
            wider = F.flatten(F.transform(stretches(of, True), lambda x: with_blanks(x, h)))
            # Blank lines are rare, and without them a stretch is one window.
            return F.when(F.array_contains(words, 0), wider).otherwise(plain)

        return F.sort_array(bound(F.flatten(lines), of_lines))

    return bound(hashes, hashed)


def _before(rows: Column, i: Column) -> Column:
    return F.get(rows, i - 1)


def _repeats_inside(windows: Column) -> Column:
    """Runs of lines that stand earlier in the same text: sorted windows with an equal one before them."""
    return bound(
        windows,
        lambda rows: merged(
            F.transform(
                F.filter(
                    rows,
                    lambda x, i: F.coalesce(
                        (_before(rows, i)["h"] == x["h"]) & (_before(rows, i)["first"] != x["first"]), F.lit(False)
                    ),
                ),
                lambda x: F.struct(x["first"], x["last"]),
            )
        ),
    )


def _first_places(windows: Column, hashes: Column) -> Column:
    """A text's distinct windows, each where it first stands; later ones repeat that place already.

    With ``f``, the fingerprint: the least hash of a line inside.
    """
    first = bound(
        windows,
        lambda rows: F.filter(rows, lambda x, i: F.coalesce(_before(rows, i)["h"] != x["h"], F.lit(True))),
    )
    return F.transform(
        first,
        lambda x: F.struct(
            x["h"], x["first"], x["last"],
            F.array_min(F.slice(hashes, x["first"] + 1, x["last"] - x["first"] + 1)).alias("f"),
        ),
    )


def repeated_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS
) -> DataFrame:
    """``id, text_hash, n_lines, words, runs`` for every row: the runs of lines that repeat earlier ones.

    Earlier is what stands before in the same text, or in a document of smaller id. Rows of
    one id are not compared with each other, nor are rows without one, which come after
    all others. Documents are judged as they came: a run goes if an earlier document had it, also where that one loses
    part of it to a third, so of a run made of two others its first copy may go piece by piece. A null text
    has no lines. Repeated rows get equal results; other columns are not read; a table without rows gives none.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), lines_of(text).alias("lines")
    ).select("id", "text_hash", F.transform("lines", _bare).alias("lines"))
    hashed = cut.select(
        "id",
        "text_hash",
        F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"),
        F.transform("lines", _words).alias("words"),
    )
    placed = bound(
        _windows(F.col("hashes"), F.col("words"), least_words),
        lambda rows: F.struct(_repeats_inside(rows).alias("inside"), _first_places(rows, F.col("hashes")).alias("windows")),
    )
    numbered = written(
        hashed.select("id", "text_hash", "words", placed.alias("p")).select(
            "id", "text_hash", "words", "p.inside", "p.windows"
        )
    )
    prints = F.array_distinct(F.transform("windows", lambda w: w["f"]))
    known = bit_filter(_of_several(numbered.select("id", F.explode(prints).alias("f")), "f"), "f", FILTER_BITS)
    compared = F.filter("windows", lambda w: may_hold(known, w["f"], FILTER_BITS))
    windows = numbered.select("id", "text_hash", F.explode(compared).alias("p")).select("id", "text_hash", "p.*")
    # The first document of a window; those of a single document need no partner.
    sources = _of_several(windows, "h")
    across = (
        windows.join(sources, "h")
        .where("id IS NULL OR source < id")
        .groupBy(F.col("id").alias("_id"), F.col("text_hash").alias("_text_hash"))
        .agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    )
    none = F.array().cast(_RUNS)
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_text_hash"))
    return numbered.drop("windows").join(across, same, "left").select(
        F.col("id").alias(id_col),
        "text_hash",
        F.size("words").alias("n_lines"),
        "words",
        merged(F.concat("inside", F.coalesce("runs", none))).alias("runs"),
    )


def _of_several(rows: DataFrame, key: str) -> DataFrame:
    """``key, source``: the keys that rows of several documents have, and the first of these documents."""
    return (
        rows.groupBy(key)
        .agg(
            F.min("id").alias("source"), F.max("id").alias("latest"), F.bool_or(F.col("id").isNull()).alias("unnamed")
        )
        .where("source < latest OR (source IS NOT NULL AND unnamed)")
        .select(key, "source")
    )


def merged(runs: Column) -> Column:
    """Runs in order, with those that overlap or touch joined."""
    none = F.array().cast(_RUNS)

    def add(done: Column, run: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["first"].alias("first"), F.greatest(last["last"], run["last"]).alias("last"))
        return F.when(
            (F.size(done) > 0) & (run["first"] <= F.try_element_at(done, F.lit(-1))["last"] + 1),
            F.array_append(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), joined),
        ).otherwise(F.array_append(done, run))

    return F.aggregate(F.array_sort(runs), none, add)


def covered(runs: Column) -> Column:
    """All places inside the runs."""
    return F.flatten(F.transform(runs, lambda r: F.sequence(r["first"], r["last"])))


def without_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the repeated runs cut out of ``text``; other columns stay as they are.

    A text that only repeats earlier ones becomes empty; the row stays. ``n_chars``, where there is
    such a column, becomes the new length. Texts without a repeat are not touched.
    """
    runs = repeated_runs(docs.select("doc_id", "text"), least_words=least_words)
    doc, text_hash, cuts = (fresh(docs, c) for c in ("_cut_doc", "_cut_text", "_cuts"))
    touched = (
        runs.where(F.size("runs") > 0)
        .select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text_hash), F.col("runs").alias(cuts))
        .dropDuplicates([doc, text_hash])
    )
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(text_hash))
    kept = F.filter(
        lines_of(F.col("text")),
        lambda line, i: ~F.exists(cuts, lambda r: i.between(r["first"], r["last"])),
    )
    text = F.when(F.col(cuts).isNull(), F.col("text")).otherwise(F.array_join(kept, ""))
    changed = docs.join(touched, same, "left").withColumn("text", text)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        changed = changed.withColumn("n_chars", F.when(F.col(cuts).isNull(), F.col("n_chars")).otherwise(length))
    return changed.select(*docs.columns)
