"""Repair of conversations: the cheapest edits after which speakers take turns.

A conversation may begin with the system; then user and assistant alternate, the assistant last. The edits are
found by a backward table of costs, four states a row, of which only checkpoints are stored; the walk
forward works a block out again from the checkpoint behind it and takes the least letter that keeps the
cost. Blocks of a long conversation are worked on in different tasks: each gives the cost
between any two states, these give the checkpoints, and the walks of the blocks are chained by their states.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import written

# Costs of the edits, and what a kept row with a cut-off end adds.
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
# Rows of a block are those whose places agree but for the last 12 bits.
BLOCK_BITS = 12
WHITE = " \t\n\x0b\x0c\r"

# States: nothing yet, after the system, after a user, after an assistant. The next speaker is fixed
# in each, but that the system may begin.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = (USER, USER, ASSISTANT, USER)
_SPEAKER = ("", "", "user", "assistant")
_NEVER = 1 << 40
_ENDS = (0, _NEVER, _NEVER, 0)
# A row's code: four times its fault, and its speaker: 0 other, 1 system, 2 user, 3 assistant.
BLANK, REPEATED, CUT = 1, 2, 3


def _kept(state: int, speaker: int) -> int:
    """The state after a row kept as it is, -1 where it may not stand."""
    if speaker == SYSTEM:
        return SYSTEM if state == START else -1
    return speaker if speaker and _NEXT[state] == speaker else -1


def _with_inserts(costs: list[int]) -> list[int]:
    """Costs where rows may be put in first."""
    user = min(costs[USER], INSERT + costs[ASSISTANT])
    assistant = min(costs[ASSISTANT], INSERT + costs[USER])
    return [min(costs[START], INSERT + user), min(costs[SYSTEM], INSERT + user), user, assistant]


def _before(code: int, after: Sequence[int]) -> list[int]:
    """Costs before a row, from those after it."""
    fault, speaker = divmod(code, 4)
    costs = [DELETE + after[s] for s in range(4)]
    if fault not in (BLANK, REPEATED):
        more = TRUNCATED if fault == CUT else 0
        for s in range(4):
            kept = _kept(s, speaker)
            if kept >= 0:
                costs[s] = min(costs[s], more + after[kept])
            costs[s] = min(costs[s], REROLE + more + after[_NEXT[s]])
    return _with_inserts(costs)


def between(codes: Sequence[int]) -> list[int]:
    """Least cost from each state before some rows to each state after them, 16 numbers."""
    columns = []
    for t in range(4):
        costs = [0 if s == t else _NEVER for s in range(4)]
        for code in reversed(codes):
            costs = _before(code, costs)
        columns.append(costs)
    return [min(columns[t][s], _NEVER) for s in range(4) for t in range(4)]


def ends(blocks: Sequence[Sequence[int]]) -> list[list[int]]:
    """The costs behind each block of a conversation, from the blocks' ``between``."""
    costs, out = _with_inserts(list(_ENDS)), []
    for m in reversed(blocks):
        out.append(costs)
        costs = [min(m[4 * s + t] + costs[t] for t in range(4)) for s in range(4)]
    return out[::-1]


def walk(codes: Sequence[int], end: Sequence[int], state: int, last: bool) -> tuple[int, int, str]:
    """State after the rows, cost and letters of the cheapest edits from ``state``; of equals the ASCII-least.

    Costs are stored at every square root of the rows and worked out again between two such places.
    ``last`` adds what must be put in after the last row.
    """
    n = len(codes)
    step = isqrt(n) + 1
    stored = {n: list(end)}
    costs = stored[n]
    for i in reversed(range(n)):
        costs = _before(codes[i], costs)
        if i % step == 0:
            stored[i] = costs
    total, letters = 0, []
    for first in range(0, n, step):
        stop = min(n, first + step)
        rows = [stored[stop]]
        for i in reversed(range(first, stop)):
            rows.append(_before(codes[i], rows[-1]))
        rows.reverse()
        for i in range(first, stop):
            here, after = rows[i - first], rows[i - first + 1]
            fault, speaker = divmod(codes[i], 4)
            more = TRUNCATED if fault == CUT else 0
            while True:
                left = here[state]
                if DELETE + after[state] == left:
                    letters.append("D")
                    total += DELETE
                    break
                if INSERT + here[_NEXT[state]] == left:
                    letters.append("I")
                    total += INSERT
                    state = _NEXT[state]
                    continue
                kept = _kept(state, speaker)
                if fault not in (BLANK, REPEATED) and kept >= 0 and more + after[kept] == left:
                    letters.append("K")
                    total += more
                    state = kept
                else:
                    letters.append("R")
                    total += REROLE + more
                    state = _NEXT[state]
                break
    while last and state not in (START, ASSISTANT):
        letters.append("I")
        total += INSERT
        state = _NEXT[state]
    return state, total, "".join(letters)


def edits(letters: str, codes: Sequence[int], state: int) -> list[dict]:
    """``at, edit, role`` of each letter: the row it is about, -1 for a new one, and a new or changed role."""
    out, at = [], 0
    for letter in letters:
        row = -1 if letter == "I" else at
        if letter == "K":
            state = _kept(state, codes[at] % 4)
        elif letter != "D":
            state = _NEXT[state]
        out.append({"at": row, "edit": letter, "role": _SPEAKER[state] if letter in "IR" else None})
        at += letter != "I"
    return out


_WALK = pa.list_(pa.struct([("exit", pa.int32()), ("cost", pa.int64()), ("letters", pa.string())]))
_EDIT = pa.list_(pa.struct([("at", pa.int32()), ("edit", pa.string()), ("role", pa.string())]))
_PLACED = "array<struct<block:long,{}>>"


def _by_row(function, schema: str, kind: pa.DataType, *columns: Column) -> Column:
    """``function`` of each row's plain values, over Arrow batches."""

    def work(*arrays: pa.Array) -> pa.Array:
        return pa.array([function(*row) for row in zip(*(a.to_pylist() for a in arrays))], kind)

    return F.arrow_udf(work, schema)(*columns)


def ordered(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``conv, turn, role, text, place``, written out: rows in the order of their conversations.

    By turn, null turns first; rows of one turn by role and text. Null roles and texts become one
    space. ``place`` rises with the order over the whole table. A conversation of many rows is dealt to many tasks.
    """
    keys = ["conv", "turn", "role"]
    plain = rows.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(role_col, F.lit(" ")).alias("role"),
        F.coalesce(text_col, F.lit(" ")).alias("text"),
    )
    # The first letters stand for the text where ranges are drawn up, so long texts are not sampled.
    dealt = plain.repartitionByRange(*keys, F.substring("text", 1, 32)).sortWithinPartitions(*keys, "text")
    return written(dealt.withColumn("place", F.monotonically_increasing_id()))


def faults(lines: DataFrame) -> DataFrame:
    """``conv, turn, place, code`` of ordered rows: the first fault of blank, repeated, cut off; and the speaker."""
    firsts = lines.groupBy("conv", "role", F.sha2("text", 256)).agg(F.min("place").alias("place"))
    text = F.rtrim("text", F.lit(WHITE))
    speaker = F.left("role", F.lit(1))
    kind = (
        F.when(speaker == "s", SYSTEM).when(speaker == "u", USER).when(speaker == "a", ASSISTANT).otherwise(0)
    )
    marked = lines.select(
        "conv", "turn", "place", kind.alias("speaker"), F.length(text).alias("size"), F.right(text, F.lit(1)).alias("end")
    ).join(firsts.select("place", F.lit(True).alias("first")), "place", "left")
    fault = (
        F.when(F.col("size") == 0, BLANK)
        .when(F.col("first").isNull(), REPEATED)
        .when(~F.col("end").isin(".", "!", "?"), CUT)
        .otherwise(0)
    )
    return marked.select("conv", "turn", "place", (fault * 4 + F.col("speaker")).alias("code"))


def _blocks(coded: DataFrame) -> DataFrame:
    """``conv, block, places, codes, between, illegal, opens, closes``: at most 4,096 rows of a conversation each.

    ``illegal`` counts neighbours that may not follow each other; ``opens`` and ``closes`` are the outer speakers.
    """
    rows = (
        coded.groupBy("conv", F.shiftright("place", BLOCK_BITS).alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct("place", "code"))).alias("rows"))
        .select("conv", "block", F.col("rows.place").alias("places"), F.col("rows.code").alias("codes"))
    )
    speakers = F.transform("codes", lambda c: c % 4)
    pairs = F.zip_with(
        speakers, F.slice(speakers, F.lit(2), F.greatest(F.size("codes") - 1, F.lit(0))), lambda a, b: a * 4 + b
    )
    return rows.select(
        "*",
        _by_row(between, "array<long>", pa.list_(pa.int64()), F.col("codes")).alias("between"),
        F.size(F.filter(pairs, lambda p: ~_may_follow(p))).cast("long").alias("illegal"),
        (F.get("codes", F.lit(0)) % 4).alias("opens"),
        (F.element_at("codes", -1) % 4).alias("closes"),
    )


def _may_follow(pair: Column) -> Column:
    # A missing speaker after the last row makes a null pair, which counts as none.
    return pair.isNull() | pair.isin(SYSTEM * 4 + USER, USER * 4 + ASSISTANT, ASSISTANT * 4 + USER)


def _by_block(of: DataFrame, *columns: str) -> DataFrame:
    """``conv, blocks``: a conversation's blocks in order, with the named columns of each."""
    return of.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", *columns))).alias("blocks"))


def _with_block(left: DataFrame, right: DataFrame, *columns: str) -> DataFrame:
    """``left`` with some columns of the row of ``right`` that is about the same block."""
    named = right.select(F.col("conv").alias("_conv"), F.col("block").alias("_block"), *columns)
    same = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block"))
    return left.join(named, same).drop("_conv", "_block")


def _behind(blocks: list[dict]) -> list[dict]:
    costs = ends([b["between"] for b in blocks])
    return [
        {"block": b["block"], "end": c, "first": k == 0, "last": k == len(blocks) - 1}
        for k, (b, c) in enumerate(zip(blocks, costs))
    ]


def _walks(codes: list[int], end: list[int], first: bool, last: bool) -> list[dict]:
    # Only the first block is sure to be entered in one state.
    found = [walk(codes, end, s, last) for s in range(1 if first else 4)]
    return [{"exit": s, "cost": c, "letters": x} for s, c, x in found]


def _entered(blocks: list[dict]) -> list[dict]:
    state, out = START, []
    for b in blocks:
        out.append({"block": b["block"], "state": state})
        state = b["exits"][state]
    return out


def plans(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The blocks of all conversations with their edits, and the faults they were found from.

    The blocks are ``conv, block, places, state, cost, letters, codes, illegal, opens, closes``, written out. A conversation
    is never in one row as a whole, but for 20 numbers of each of its blocks.
    """
    coded = written(faults(lines))
    blocks = written(_blocks(coded))
    behind = _by_row(
        _behind,
        _PLACED.format("end:array<long>,first:boolean,last:boolean"),
        pa.list_(
            pa.struct(
                [("block", pa.int64()), ("end", pa.list_(pa.int64())), ("first", pa.bool_()), ("last", pa.bool_())]
            )
        ),
        F.col("blocks"),
    )
    checkpoints = _by_block(blocks, "between").select("conv", F.inline(behind))
    walked = written(
        _with_block(blocks.drop("between"), checkpoints, "end", "first", "last").select(
            "conv", "block", "places", "codes", "illegal", "opens", "closes",
            _by_row(
                _walks, "array<struct<exit:int,cost:long,letters:string>>", _WALK,
                F.col("codes"), F.col("end"), F.col("first"), F.col("last"),
            ).alias("walks"),
        )
    )
    entered = _by_row(
        _entered,
        _PLACED.format("state:int"),
        pa.list_(pa.struct([("block", pa.int64()), ("state", pa.int32())])),
        F.col("blocks"),
    )
    exits = walked.select("conv", "block", F.col("walks.exit").alias("exits"))
    states = _by_block(exits, "exits").select("conv", F.inline(entered))
    taken = F.get("walks", F.col("state"))
    found = _with_block(walked, states, "state").select(
        "conv", "block", "places", "codes", "illegal", "opens", "closes", "state",
        taken["cost"].alias("cost"), taken["letters"].alias("letters"),
    )
    return written(found), coded


def repaired(lines: DataFrame, found: DataFrame) -> DataFrame:
    """``conv, block, k, edit, role, text``: an edit a row, in order by block and k; deleted rows stand with theirs.

    New rows have an empty text.
    """
    letters = _by_row(
        edits, "array<struct<at:int,edit:string,role:string>>", _EDIT,
        F.col("letters"), F.col("codes"), F.col("state"),
    )
    steps = found.select("conv", "block", "places", F.posexplode(letters).alias("k", "e")).select(
        "conv", "block", "k", "e.edit", F.col("e.role").alias("new"),
        F.when(F.col("e.at") >= 0, F.get("places", F.col("e.at"))).alias("place"),
    )
    new = steps.where("place is null").select(
        "conv", "block", "k", "edit", F.col("new").alias("role"), F.lit("").alias("text")
    )
    old = steps.where("place is not null").join(lines.select("place", "role", "text"), "place")
    return old.select("conv", "block", "k", "edit", F.coalesce("new", "role").alias("role"), "text").unionByName(new)


def summary(found: DataFrame, coded: DataFrame) -> DataFrame:
    """``conv, gaps, blank, duplicate, truncated, illegal, cost, audit`` of each conversation that has rows.

    ``gaps`` counts the whole numbers that no turn has between the least and the greatest turn; null if a long
    cannot hold it.
    """
    wide = F.col("turn").cast("decimal(38,0)")
    turns = coded.groupBy("conv", "turn").agg(
        *[F.count_if(F.floor(F.col("code") / 4) == k).alias(n) for k, n in ((1, "blank"), (2, "duplicate"), (3, "truncated"))]
    )
    counts = turns.groupBy("conv").agg(
        F.when(F.count("turn") == 0, 0)
        .otherwise((F.max(wide) - F.min(wide) + 1 - F.count("turn")).try_cast("long"))
        .alias("gaps"),
        *[F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated")],
    )
    parts = _by_block(found, "opens", "closes", "letters", "illegal", "cost")
    seams = F.zip_with(
        F.col("blocks.closes"),
        F.slice("blocks.opens", F.lit(2), F.greatest(F.size("blocks") - 1, F.lit(0))),
        lambda a, b: a * 4 + b,
    )

    def total(of: str) -> Column:
        return F.aggregate(f"blocks.{of}", F.lit(0).cast("long"), lambda n, x: n + x)

    chained = parts.select(
        F.col("conv").alias("_conv"),
        (total("illegal") + F.size(F.filter(seams, lambda p: ~_may_follow(p)))).alias("illegal"),
        total("cost").alias("cost"),
        F.array_join("blocks.letters", "").alias("audit"),
    )
    joined = counts.join(chained, F.col("conv").eqNullSafe(F.col("_conv")))
    return joined.drop("_conv")


def digests(edited: DataFrame) -> DataFrame:
    """``conv, repaired_sha256``: of the repaired rows as ``role:text``, joined by line ends.

    A hash needs its whole input, so here a conversation's texts are one row.
    """
    kept = edited.where("edit <> 'D'")
    line = F.concat("role", F.lit(":"), "text").alias("line")
    texts = kept.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", "k", line))).alias("rows"))
    return texts.select("conv", F.sha2(F.array_join("rows.line", "\n"), 256).alias("repaired_sha256"))


def repairs(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """The summary of each conversation with its ``repaired_sha256``, and the edits themselves.

    ``turn`` is a whole number or null. Rows without a conversation are one conversation. Null roles and texts
    count as one space, so such rows are blank or of an unknown speaker; roles are told apart
    by their first letter, and an empty one has none. Repeated rows are duplicates. Columns other than the four are not read;
    a table without rows gives none.
    """
    lines = ordered(rows, conv_col, turn_col, role_col, text_col)
    found, coded = plans(lines)
    edited = repaired(lines, found)
    whole, texts = summary(found, coded), digests(edited).withColumnRenamed("conv", "_conv")
    joined = whole.join(texts, F.col("conv").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    nothing = F.sha2(F.lit(""), 256)
    return joined.withColumn("repaired_sha256", F.coalesce("repaired_sha256", nothing)), edited
