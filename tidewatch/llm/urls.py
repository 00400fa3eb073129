"""URL filter: rules first, then host word segmentation and naive Bayes.

Names of hosts run words together. Each distinct label is split by a unigram Viterbi
search whose word counts come from the pages' own texts; the words of the host and
the path are then scored by multinomial naive Bayes, learned from the urls that the rules decide.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import written

# Rules of the filter: (host, path, verdict). A rule fits its host and all subdomains where
# the url's path starts with the rule's; the longest fits best (fixed values).
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
ALLOW, BLOCK = "allow", "block"


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/ ? #``, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #``; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """``struct<rule, verdict>`` of the longest rule that fits, or null; of equals the first by name."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in reversed(ordered):
        inside = (host == name) | host.endswith("." + name)
        fits = inside & path.startswith(start)
        found = F.when(
            fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        ).otherwise(found)
    return found


def word_counts(texts: DataFrame, text_col: str) -> DataFrame:
    """``word, n`` over all texts: runs of letters outside tags, lower-cased."""
    plain = F.lower(F.regexp_replace(F.col(text_col), r"<[^>]*>", " "))
    words = F.filter(F.split(plain, r"[^\p{L}]+"), lambda w: w != "")
    return texts.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def best_split(label: str, known: dict[str, int], total: int) -> list[str]:
    """Most probable split of ``label`` into words; an unknown stretch costs more the longer it is.

    Of equally probable splits the one with the longer last word wins. Words of any length are found: known ones
    by the lengths that they have, and of unknown stretches to a place the best begins where it did for the place before, or
    right there.
    """
    sizes = sorted({len(w) for w in known}, reverse=True)
    # An unseen word of so many letters: one in ten for each letter.
    unseen = -math.log(total + 1.0)
    best: list[tuple[float, int]] = [(0.0, 0)]
    # Score of what stands before an unknown stretch, and where the best one begins.
    before, begins = 0.0, 0
    for end in range(1, len(label) + 1):
        score, start = before + unseen - 2.303 * end, begins
        for size in sizes:
            if size <= end and (n := known.get(label[end - size : end])):
                chance = best[end - size][0] + math.log(n / total)
                if (chance, size) > (score, end - start):
                    score, start = chance, end - size
        best.append((score, start))
        if score + 2.303 * end > before:
            before, begins = score + 2.303 * end, end
    words, end = [], len(label)
    while end:
        words.append(label[best[end][1] : end])
        end = best[end][1]
    return words[::-1]


def segmented(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """``label, words`` for distinct labels, the words by ``counts(word, n)``.

    A label's substrings, of the lengths that words have, are joined to the counts, so no dictionary is sent around.
    """
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sizes = [r[0] for r in counts.select(F.length("word")).distinct().collect()]
    lengths = F.lit(np.array(sorted(sizes), dtype=np.int32))
    spans = F.transform(
        F.sequence(F.lit(1), F.length("label")),
        lambda at: F.transform(
            F.filter(lengths, lambda n: n <= F.length("label") - at + 1),
            lambda n: F.substring(F.col("label"), at, n),
        ),
    )
    # A label's hash stands for it while its pieces travel, since it may be long.
    keyed = labels.withColumn("key", F.unhex(F.sha2("label", 256)))
    pieces = keyed.where("label <> ''").select("key", F.explode(F.array_distinct(F.flatten(spans))).alias("word"))
    known = pieces.join(counts, "word").groupBy("key").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    @F.pandas_udf("array<string>")
    def split(labels: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series(
            [
                best_split(label, {r["word"]: r["n"] for r in (() if rows is None else rows)}, max(1, total))
                for label, rows in zip(labels, known)
            ],
            dtype=object,
        )

    return keyed.join(known, "key", "left").select("label", split("label", "known").alias("words"))


def tokens_of_urls(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """``host, path, tokens`` for distinct (host, path): words of the host's labels, then of the path."""
    hosts = urls.select("host").distinct()
    labels = F.filter(F.split("host", r"[^\p{L}]+"), lambda x: x != "")
    placed = hosts.select("host", F.posexplode(labels).alias("place", "label"))
    split = segmented(placed.select("label").distinct(), counts)
    named = (
        placed.join(split, "label")
        .groupBy("host")
        .agg(F.array_sort(F.collect_list(F.struct("place", "words"))).alias("parts"))
        .select("host", F.flatten(F.col("parts.words")).alias("host_words"))
    )
    path_words = F.filter(F.split(F.lower("path"), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    tokens = F.concat(
        F.coalesce(
            F.transform("host_words", lambda w: F.concat(F.lit("h:"), w)), F.array().cast("array<string>")
        ),
        F.transform(path_words, lambda w: F.concat(F.lit("p:"), w)),
    )
    return urls.select("host", "path").distinct().join(named, "host", "left").select(
        "host", "path", tokens.alias("tokens")
    )


def naive_bayes(tokens: DataFrame, labelled: DataFrame) -> DataFrame:
    """``host, path, blocked`` (log odds of block) for all ``tokens(host, path, tokens)``.

    ``labelled`` is ``host, path, verdict, n`` with n urls each. Token weights are log ratios
    with one added count; a token that no labelled url has weighs nothing. Without both
    classes the odds are those of the classes' counts, each with one added.
    """
    seen = labelled.join(tokens, ["host", "path"]).select(
        F.explode("tokens").alias("token"), (F.col("verdict") == BLOCK).alias("block"), "n"
    )
    by_token = written(
        seen.groupBy("token").agg(
            F.sum(F.when(F.col("block"), F.col("n")).otherwise(0)).alias("b"),
            F.sum(F.when(~F.col("block"), F.col("n")).otherwise(0)).alias("a"),
        )
    )
    sums = by_token.agg(
        F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("a"), F.lit(0)), F.count("*")
    ).first()
    blocked, allowed = (
        labelled.agg(
            F.coalesce(F.sum(F.when(F.col("verdict") == BLOCK, F.col("n"))), F.lit(0)),
            F.coalesce(F.sum(F.when(F.col("verdict") == ALLOW, F.col("n"))), F.lit(0)),
        ).first()
    )
    prior = math.log((blocked + 1) / (allowed + 1))
    scale = math.log((sums[1] + sums[2] or 1) / (sums[0] + sums[2] or 1))
    weights = by_token.select(
        "token", (F.log((F.col("b") + 1) / (F.col("a") + 1)) + F.lit(scale)).alias("weight")
    )
    scored = (
        tokens.select("host", "path", F.explode("tokens").alias("token"))
        .join(weights, "token")
        .groupBy("host", "path")
        .agg(F.sum("weight").alias("weight"))
    )
    return tokens.select("host", "path").join(scored, ["host", "path"], "left").select(
        "host", "path", (F.coalesce("weight", F.lit(0.0)) + F.lit(prior)).alias("blocked")
    )


def judged_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    text_col: str = "html",
    rules: tuple = RULES,
) -> DataFrame:
    """``id, host, path, rule, verdict, log_odds`` for every row of ``pages``.

    The verdict is the longest fitting rule's; without a rule it is block if the log odds are
    above zero. Rows with a null or odd url have an empty host and path and the verdict
    of the classes' counts. Repeated rows and null ids stay as they are.
    """
    urls = pages.select(
        F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")
    )
    ruled = urls.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    pairs = written(ruled.groupBy("host", "path", "r").agg(F.count("*").alias("n")))
    counts = written(word_counts(pages, text_col))
    tokens = written(tokens_of_urls(pairs, counts))
    labelled = pairs.where("r is not null").select("host", "path", F.col("r.verdict").alias("verdict"), "n")
    odds = naive_bayes(tokens, labelled)
    verdict = F.coalesce("r.verdict", F.when(F.col("blocked") > 0, BLOCK).otherwise(ALLOW))
    return ruled.join(odds, ["host", "path"]).select(
        F.col("id").alias(id_col), "host", "path", F.col("r.rule").alias("rule"),
        verdict.alias("verdict"), F.col("blocked").alias("log_odds"),
    )
