"""Personal data: wide generators propose spans, boosted trees choose among them.

Base rules find what is certain. Generators propose more, overlapping spans of the same
kinds. Gradient-boosted trees, taught by which proposals the base rules confirm, judge a proposal by
its form and its surroundings alone, so they also know look-alikes that a check digit or a
range rejects. A threshold for each kind, set on proposals kept out of training, decides.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import bound, pattern_matches
from tidewatch.session import written

KINDS = ("email", "ip", "card", "phone")

# Base rules (fixed formats). A match starts where one of the pattern's can start: at the
# start of a run of its first signs, or right after the match before.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A sign that a text must hold for its kind.
NEEDS = {"email": "[@(\\[]", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}
# Generators: anything that looks like the kind.
PROPOSED = {
    "email": r"(?:(?<![\p{L}0-9._%+-])|\G)[\p{L}0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[\p{L}0-9-]++"
    r"(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[\p{L}0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){2,}+",
    "card": r"[0-9](?:[\x20./-]?[0-9]){11,}+",
    "phone": r"[+(]?[0-9](?:[\x20()./-]{0,3}[0-9]){6,}+",
}
# Words before a span that speak for personal data.
CUES = r"(?i)(?:tel|phone|fon|call|fax|mobile|mail|write|contact|card|visa|credit|pay|ip|host|address|server)[^\p{L}]*$"
# Code points of the surroundings that are looked at.
AROUND = 24
# Bound of the sample: documents whose proposals teach the trees.
SAMPLE_DOCS = 40_000
# One in so many sampled proposals is kept for the thresholds, beside all that are not sampled.
KEPT_OUT = 3
# Trees, their depth, the share of confirmed proposals a threshold must reach, and the least
# number of proposals it must rest on.
TREES, DEPTH, PRECISION, LEAST_CASES = 10, 4, 0.9, 20
SEED = 42

_SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """Luhn's check of a string of digits."""

    def add(total: Column, i: Column) -> Column:
        digit = F.ascii(F.substring(digits, -1 - i, F.lit(1))) - 48
        doubled = digit * 2
        return total + F.when(i % 2 == 0, digit).otherwise(
            F.when(doubled > 9, doubled - 9).otherwise(doubled)
        )

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"


def confirmed(kind: Column, text: Column) -> Column:
    """Whether a span's text is of its kind by the base rules, as a whole."""

    def card(digits: Column) -> Column:
        return F.length(digits).between(16, 19) & passes_luhn(digits)

    return (
        F.when(kind == "email", text.rlike(rf"^{_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++\z"))
        .when(kind == "ip", text.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}\z"))
        .when(
            kind == "card", text.rlike(r"^[0-9](?:[\x20-]?[0-9]){15,}+\z") & card(_digits(text))
        )
        .otherwise(
            text.rlike(r"^\+[0-9][\x20().0-9-]+[0-9]\z") & F.length(_digits(text)).between(8, 15)
        )
    )


def _spans(text: Column, kind: str, pattern: str) -> Column:
    """``array<struct<kind, start, end, match>>`` of a pattern."""
    found = F.transform(
        pattern_matches(text, pattern),
        lambda m: F.struct(F.lit(kind).alias("kind"), m["start"], m["end"], m["match"]),
    )
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,match:string>>")
    return F.when(text.rlike(NEEDS[kind]), found).otherwise(none)


def base_spans(text: Column) -> Column:
    """Spans of the base rules, by kind and then start."""
    every = F.concat(*[_spans(text, k, BASE[k]) for k in KINDS])
    return F.transform(
        F.filter(every, lambda s: confirmed(s["kind"], s["match"])),
        lambda s: F.struct(s["kind"], s["start"], s["end"]),
    )


def proposals(text: Column) -> Column:
    """Spans of the generators; those of different kinds may overlap."""
    return F.concat(*[_spans(text, k, PROPOSED[k]) for k in KINDS])


def _count(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, signs, ""))


def features(text: Column, span: Column) -> dict[str, Column]:
    """Form and surroundings of a span, as numbers."""
    match = span["match"]
    before = F.substring(text, F.greatest(span["start"] - AROUND, F.lit(0)).cast("int") + 1, F.least(span["start"], F.lit(AROUND)).cast("int"))
    after = F.substring(text, span["end"].cast("int") + 1, F.lit(2))
    groups = F.filter(F.split(match, "[^0-9]+"), lambda g: g != "")
    widths = F.transform(groups, lambda g: F.length(g))
    form = {
        "kind": F.array_position(F.array(*[F.lit(k) for k in KINDS]), span["kind"]),
        "length": F.length(match),
        "digits": _count(match, "[0-9]"),
        "letters": _count(match, r"\p{L}"),
        "blanks": _count(match, r"\x20"),
        "dots": _count(match, r"\."),
        "dashes": _count(match, "-"),
        "brackets": _count(match, r"[()\[\]]"),
        "plus": match.startswith("+"),
        "at": match.contains("@"),
        "groups": F.size(groups),
        "widest": F.coalesce(F.array_max(widths), F.lit(0)),
        "narrowest": F.coalesce(F.array_min(widths), F.lit(0)),
        "first_group": F.coalesce(F.get(widths, F.lit(0)), F.lit(0)),
        "last_part": F.length(F.substring_index(match, ".", -1)),
        "after_letter": before.rlike(r"[\p{L}_]\z"),
        "after_sign": before.rlike(r"[^\p{L}\s]\z"),
        "cue": before.rlike(CUES),
        "before_letter": after.rlike(r"^[\p{L}_]"),
        "before_part": after.rlike(r"^[./:@-][\p{L}0-9]"),
    }
    return {name: x.cast("double") for name, x in form.items()}


def described(text: Column) -> Column:
    """Proposals with their features: ``array<struct<kind, start, end, match, f>>``."""
    return F.transform(
        proposals(text),
        lambda s: F.struct(
            s["kind"], s["start"], s["end"], s["match"],
            F.struct(*[x.alias(name) for name, x in features(text, s).items()]).alias("f"),
        ),
    )


@dataclass(frozen=True)
class Chooser:
    """Boosted trees as nested choices, and the least score of each kind (over 1: none is chosen)."""

    names: tuple[str, ...]
    trees: tuple[tuple[float, tuple], ...]
    least: dict[str, float]

    def score(self, f: Column) -> Column:
        """Probability that a proposal with features ``f`` is personal data."""
        if not self.trees:
            return F.lit(0.0)
        margin = reduce(lambda a, b: a + b, (self._grown(t, f) * w for w, t in self.trees))
        return 1.0 / (1.0 + F.exp(-2.0 * margin))

    def _grown(self, node: tuple, f: Column) -> Column:
        if len(node) == 1:
            return F.lit(node[0])
        feature, limit, low, high = node
        test = f[self.names[feature]] <= limit
        return F.when(test, self._grown(low, f)).otherwise(self._grown(high, f))

    def least_score(self, kind: Column) -> Column:
        found = F.lit(2.0)
        for name, limit in self.least.items():
            found = F.when(kind == name, F.lit(limit)).otherwise(found)
        return found


_SPLIT = re.compile(r"If \(feature (\d+) <= (\S+)\)")


def _tree(lines: list[str]) -> tuple:
    """A tree from the lines of its printed form, which are taken from the list."""
    line = lines.pop(0).strip()
    if line.startswith("Predict:"):
        return (float(line.split(":")[1]),)
    feature, limit = _SPLIT.match(line).groups()
    low = _tree(lines)
    lines.pop(0)
    return int(feature), float(limit), low, _tree(lines)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> Chooser:
    """Trees from the proposals of about ``sample_docs`` documents, chosen by hash; thresholds from all others.

    A proposal counts as personal data if the base rules confirm it; no feature tells what
    they check beyond the form. Without proposals of both sorts nothing is ever chosen. Proposals that do
    not teach are scored and counted over the whole table, so a rare kind has all its cases.
    """
    total = docs.count()
    share = F.pmod(F.xxhash64(id_col, text_col), F.lit(1_000_000)) < F.lit(1_000_000 * sample_docs // max(1, total))
    texts = docs.select(share.alias("sampled"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kept_out = F.pmod(F.xxhash64("s.match", "s.start"), F.lit(KEPT_OUT)) == 0
    right = confirmed(F.col("s.kind"), F.col("s.match")).cast("double").alias("label")
    rows = written(
        texts.where("sampled").select(F.explode(described(F.col("text"))).alias("s"))
        .where(~kept_out).select(right, "s.f.*").coalesce(4)
    )
    names = tuple(c for c in rows.columns if c != "label")
    taught = VectorAssembler(inputCols=list(names), outputCol="features").transform(rows).select("features", "label")
    if taught.select("label").distinct().count() < 2:
        return Chooser(names, (), {})
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED).fit(taught)
    trees = tuple(
        (float(w), _tree(t.toDebugString.strip().splitlines()[1:]))
        for w, t in zip(model.treeWeights, model.trees)
    )
    # Per kind and percent of score: how many proposals, and how many confirmed.
    score = Chooser(names, trees, {}).score(F.col("s.f"))
    steps = (
        texts.select("sampled", F.explode(described(F.col("text"))).alias("s"))
        .where(~F.col("sampled") | kept_out)
        .select(F.col("s.kind").alias("which"), F.floor(score * 100).alias("step"), right)
        .groupBy("which", "step")
        .agg(F.count("*").alias("n"), F.sum("label").alias("right"))
        .collect()
    )
    return Chooser(names, trees, {k: _threshold([s for s in steps if s["which"] == k]) for k in KINDS})


def _threshold(steps: list) -> float:
    """The least score above which enough of the kept-out proposals are confirmed; 2 if there is none."""
    found, n, right = 2.0, 0, 0
    for step in sorted(steps, key=lambda s: -s["step"]):
        n, right = n + step["n"], right + step["right"]
        if n >= LEAST_CASES and right >= PRECISION * n:
            found = step["step"] / 100
    return found


def redactions(
    docs: DataFrame, chooser: Chooser | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, base, added`` for each row: spans (kind, start, end) by kind and then start.

    ``base`` are the base rules' spans. ``added`` are proposals that score their kind's threshold, touch
    no base span, and overlap no better proposal (of equal scores the first by place and kind stays). A null
    text is empty. Each row is worked on by itself, so nothing is shuffled; null ids and repeated
    rows stay. Other columns are not read.
    """
    chooser = chooser or fit(docs, id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col), text.alias("text")).select(id_col, "text", base_spans(F.col("text")).alias("base"))
    if not chooser.trees:
        return base.select(id_col, "base", F.array().cast(_SPAN).alias("added"))
    scored = F.transform(
        described(F.col("text")),
        lambda s: F.struct(
            chooser.score(s["f"]).alias("score"), chooser.least_score(s["kind"]).alias("least"),
            s["start"], s["end"], s["kind"],
        ),
    )
    over = F.filter(scored, lambda s: (s["score"] >= s["least"]) & ~F.exists("base", lambda b: _touch(b, s)))

    def best(rows: Column) -> Column:
        return F.filter(rows, lambda s: ~F.exists(rows, lambda o: _touch(o, s) & _better(o, s)))

    order = F.array(*[F.lit(k) for k in KINDS])
    added = F.transform(
        F.array_sort(
            F.transform(
                bound(over, best),
                lambda s: F.struct(F.array_position(order, s["kind"]).alias("place"), s["start"], s["end"], s["kind"]),
            )
        ),
        lambda s: F.struct(s["kind"], s["start"], s["end"]),
    )
    return base.select(id_col, "base", added.alias("added"))


def _touch(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _better(a: Column, b: Column) -> Column:
    return (a["score"] > b["score"]) | (
        (a["score"] == b["score"])
        & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["kind"] < b["kind"])))
    )


def in_order(base: Column, added: Column) -> Column:
    """All spans by kind, in the order of the kinds, and then start."""
    order = F.array(*[F.lit(k) for k in KINDS])
    return F.transform(
        F.array_sort(
            F.transform(
                F.concat(base, added),
                lambda s: F.struct(F.array_position(order, s["kind"]).alias("place"), s["start"], s["end"], s["kind"]),
            )
        ),
        lambda s: F.struct(s["kind"], s["start"], s["end"]),
    )


def listed(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )
