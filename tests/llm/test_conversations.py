"""Repairs against a search over all edits by a plain table of (cost, letters), rows beside rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pandas as pd
import pytest

from tests.llm.conftest import SF_DIR
from tidewatch.llm import conversations, queries


def best(rows):
    """Cost, letters and repaired rows by a backward table that keeps whole answers."""
    # What each state still needs: nothing yet, s, u, a; s only at the start.
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def put_in(table):
        for _ in range(3):
            for state in table:
                for c in follow[state].replace("s", ""):
                    cost, letters, out = table[c]
                    table[state] = min(table[state], (cost + 2, "I" + letters, ((names[c], ""), *out)), key=lambda x: x[:2])
        return table

    never = (10**9, "", ())
    table = put_in({"": (0, "", ()), "s": never, "u": never, "a": (0, "", ())})
    for role, text, fault in reversed(rows):
        now = {}
        for state in table:
            ways = [(table[state][0] + 3, "D" + table[state][1], table[state][2])]
            if fault not in ("blank", "duplicate"):
                more = int(fault == "truncated")
                if role[:1] and role[:1] in follow[state]:
                    cost, letters, out = table[role[0]]
                    ways.append((cost + more, "K" + letters, ((role, text), *out)))
                for c in follow[state].replace("s", ""):
                    cost, letters, out = table[c]
                    ways.append((cost + more + 2, "R" + letters, ((names[c], text), *out)))
            now[state] = min(ways, key=lambda x: x[:2])
        table = put_in(now)
    return table[""]


def expected(rows):
    """The digest columns of one conversation's rows (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, marked = set(), []
    for _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        fault = (
            "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        )
        seen.add((role, text))
        marked.append((role, text, fault))
    cost, audit, out = best(marked)
    turns = [r[0] for r in rows if r[0] is not None]
    kinds = [m[2] for m in marked]
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(marked, marked[1:])]
    text = "\n".join(f"{r}:{t}" for r, t in out)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *[kinds.count(k) for k in ("blank", "duplicate", "truncated")],
        sum(p not in ("su", "ua", "au") for p in pairs),
        cost,
        audit,
        hashlib.sha256(text.encode()).hexdigest(),
    )


NAMES = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def plain(rows):
    found = {}
    for r in rows:
        conv = r["conv"] if "conv" in r else r["conv_id"]
        found[None if conv is None or conv != conv else conv] = tuple(r[n] for n in NAMES)
    return found


def damage(conv, turn, role, text):
    show = [" " if v is None else str(v) for v in (conv, turn)]
    way = zlib.crc32(":".join(show).encode()) % 20
    role, text = (" " if v is None else v for v in (role, text))
    role = "user" if way == 4 else role
    text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
    return [(turn, role, text)] * (0 if way == 0 else 2 if way == 3 else 1)


def test_conversations_equal_the_plain_table(spark):
    got = plain(map(lambda r: r.asDict(), queries.QUERIES["op12_conversations"](spark, SF_DIR).collect()))
    table = pd.read_parquet(f"{SF_DIR}/conversations.parquet")
    groups = {}
    for conv, turn, role, text in table[["conv_id", "turn", "role", "text"]].itertuples(index=False):
        groups.setdefault(conv, []).extend(damage(conv, turn, role, text))
    assert got == {conv: expected(rows) for conv, rows in groups.items()}
    assert len({v[6] for v in got.values()}) > 10


def drawn(seed, conversations_, longest):
    draw = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", "a", None]
    texts = ["Yes.", "No!", "Why", "", " \n", "Well. ", "é?", "Yes. \t", None]
    rows = []
    for conv in range(conversations_):
        for _ in range(draw.randint(1, longest)):
            text = draw.choice(texts)
            if text and draw.random() < 0.7:
                text = f"{draw.randint(0, 999)} {text}"
            rows.append((conv or None, draw.choice([None, *range(30)]), draw.choice(roles), text))
    return rows


@pytest.mark.parametrize("bits", [12, 1])
def test_odd_rows_in_long_and_short_blocks(spark, monkeypatch, bits):
    monkeypatch.setattr(conversations, "BLOCK_BITS", bits)
    rows = drawn(4, 60, 25)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    summary, edited = conversations.repairs(frame.selectExpr("*", "'x' AS conv", "1 AS place", "2 AS block"))
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert plain(map(lambda r: r.asDict(), summary.collect())) == {c: expected(r) for c, r in groups.items()}
    kept = edited.where("edit <> 'D'").orderBy("conv", "block", "k").collect()
    for conv in groups:
        roles = "".join(r["role"][0] for r in kept if r["conv"] == conv)
        assert re.fullmatch("(s?(ua)+)?", roles)


def test_extreme_turns_strings_and_no_rows(spark):
    big = (1 << 63) - 1
    rows = [("x", -big, "user", "Hi."), ("x", big, "assistant", "Ho."), ("y", None, "user", "x" * 300_000)]
    frame = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    summary = {r["conv"]: r for r in conversations.repairs(frame)[0].collect()}
    assert summary["x"]["cost"] == 0 and summary["x"]["gaps"] is None
    assert (summary["y"]["cost"], summary["y"]["audit"]) == (3, "D")
    assert conversations.repairs(frame.limit(0))[0].count() == 0


def test_walk_of_many_rows_equals_one_table():
    draw = random.Random(1)
    codes = [draw.choice([0, 1, 2, 3, 4, 10, 13, 14, 15]) for _ in range(700)]
    end = conversations.ends([conversations.between(codes)])[0]
    state, cost, letters = conversations.walk(codes, end, 0, True)
    kinds = {0: "", 1: "blank", 2: "duplicate", 3: "truncated"}
    rows = [("?sua"[c % 4], "t", kinds[c // 4]) for c in codes]
    assert (cost, letters) == best(rows)[:2] and state in (0, 3)
