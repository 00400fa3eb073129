"""The operators over the given tables, and the SQL that checks those that SQL can express."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import (
    conversations,
    ctph,
    debruijn,
    decontam,
    language,
    lines,
    packing,
    pii,
    pitman_yor,
    secrets,
    simhash,
    urls,
    whitening,
)

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def checked(sql: str):
    """Register a query with the SQL that must give the same rows."""

    def add(function):
        ORACLES[function.__name__] = sql.strip()
        return query(function)

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The tokenizer file: a setting of the environment, else the public package's."""
    named = os.environ.get("TIDEWATCH_TOKENIZER")
    if named:
        return named
    place = importlib.util.find_spec("public_tokenizers")
    return os.path.join(os.path.dirname(place.origin), "word_bpe_49k.json")


def fold(modulus: int, id_col: str = "doc_id"):
    """What the CRC-32 of an id's text leaves."""
    return F.crc32(F.col(id_col).cast("string")) % modulus


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", "fingerprint", "component_id")


@query
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language.fit(docs.where(F.coalesce(fold(4) != 2, F.lit(True))))
    judged = docs.select(
        "doc_id",
        F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"),
        language.judged(profiles, F.col("text"), farthest=1.0).alias("j"),
    )
    return judged.select("doc_id", "held_out", F.col("j.lang").alias("lang_pred"), "j.score", "j.distance")


@query
def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.scored(table(spark, sf_dir, "documents"), pitman_yor.one_in(0, 10))


@query
def op7_ctph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.compare_with_next(table(spark, sf_dir, "documents"))


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged_urls(table(spark, sf_dir, "pages"))


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x{0}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+')"""


@checked(
    f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item, ws[s : s + least(10, len(ws)) - 1] AS w
  FROM (SELECT item, ws, unnest(generate_series(1, greatest(len(ws) - 10, 0) + 1)) AS s FROM i WHERE len(ws) > 0)
), term AS (SELECT item, w, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS place FROM win),
used AS (
  SELECT * FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM d)
  WHERE word IN (SELECT word FROM term)
), freq AS (SELECT word, count(*) AS n FROM used GROUP BY word),
ranked AS (
  SELECT item, w, word, place, len(w) AS size,
    row_number() OVER (PARTITION BY item, w ORDER BY coalesce(n, 0), place) AS rk
  FROM term LEFT JOIN freq USING (word)
), start AS (SELECT doc_id, item, w, pos - place AS s FROM ranked JOIN used USING (word) WHERE rk = 1),
exact AS (
  SELECT t.doc_id, t.item, t.s, r.size FROM start t JOIN ranked r ON r.item = t.item AND r.w = t.w
  JOIN used u ON u.doc_id = t.doc_id AND u.word = r.word AND u.pos = t.s + r.place
  WHERE t.s >= 0 GROUP BY t.doc_id, t.item, t.w, t.s, r.size HAVING count(*) = r.size
), near AS (
  SELECT DISTINCT doc_id, item FROM (
    SELECT t.doc_id, t.item FROM start t JOIN ranked r ON r.item = t.item AND r.w = t.w AND r.rk <= 5 AND r.size > 5
    JOIN used u ON u.doc_id = t.doc_id AND u.word = r.word AND abs(u.pos - r.place - t.s) <= 3
    GROUP BY t.doc_id, t.item, t.w, t.s HAVING count(DISTINCT r.rk) = 5)
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(s, s + size - 1)) AS p FROM exact)
  GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, item FROM exact) GROUP BY doc_id
), close AS (
  SELECT doc_id, count(*) AS n FROM (SELECT doc_id, item FROM near EXCEPT SELECT doc_id, item FROM exact) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(hits.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items.list, '')) AS items_sha256,
  coalesce(hits.n, 0) > 0 AS contaminated, CAST(coalesce(close.n, 0) AS BIGINT) AS n_near_items
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN close USING (doc_id)
"""
)
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.coalesce(F.col("exact.item"), F.array().cast("array<string>"))))
    n_hit = decontam.hit_words(F.col("exact"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.coalesce(F.size("near"), F.lit(0)).cast("long").alias("n_near_items"),
    )


def _spans_sql(place: int, rule: str, pattern: str, least: int = 0) -> str:
    """Spans of one rule: a text is cut at the matches, so lengths give the places."""
    kept = f"WHERE length(regexp_replace(m, '^{_ASSIGN_SQL}', '')) >= {least}" if least else ""
    return f"""
  SELECT doc_id, {place} AS place, '{rule}' AS rule, before + gap AS start, before + gap + length(m) AS stop
  FROM (
    SELECT doc_id, m, gap, sum(gap + length(m)) OVER (PARTITION BY doc_id ORDER BY k) - gap - length(m) AS before
    FROM (
      SELECT doc_id, unnest(ms) AS m, unnest(list_transform(gaps[:len(ms)], lambda g: length(g))) AS gap,
        generate_subscripts(ms, 1) AS k
      FROM (
        SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS gaps
        FROM documents WHERE regexp_matches(text, '{pattern}'))
    )
  ) {kept}"""


_ASSIGN_SQL = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?"""
_RULES_SQL = [
    ("assign", _ASSIGN_SQL + "[A-Za-z0-9+/_.=-]+", 6),
    ("access", "AKIA[A-Z0-9]{16,}", 0),
    ("hex", "[0-9a-f]{24,}", 0),
    ("private_key", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0),
    ("code_host", "gh[pousr]_[A-Za-z0-9]{36,}", 0),
    ("chat", "xox[abprs]-[A-Za-z0-9-]{10,}", 0),
    ("url_login", r"://[^\s:/@]{1,256}:[^\s:/@]{1,256}@", 0),
]


@checked(
    "WITH spans AS ("
    + " UNION ALL ".join(_spans_sql(k, r, p, n) for k, (r, p, n) in enumerate(_RULES_SQL))
    + """
), listed AS (
  SELECT doc_id, count(*) FILTER (WHERE place = 0) AS n_assign, count(*) FILTER (WHERE place = 1) AS n_access,
    count(*) FILTER (WHERE place = 2) AS n_hex,
    string_agg(rule || ':' || start || ':' || stop, ',' ORDER BY start, place) AS spans,
    string_agg(rule || ':' || start || ':' || stop, ',' ORDER BY start, place) FILTER (WHERE place < 3) AS base
  FROM spans GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN listed USING (doc_id)
"""
)
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secrets.findings(table(spark, sf_dir, "documents"))
    count = {r: F.size(F.filter("findings", lambda f: f["rule"] == r)).cast("long") for r in secrets.BASE}
    base = F.filter("findings", lambda f: f["rule"].isin(*secrets.BASE))
    return found.select(
        "doc_id",
        *[n.alias(f"n_{r}") for r, n in count.items()],
        F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed(F.col("findings")).alias("spans"),
    )


@query
def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.repeated_runs(table(spark, sf_dir, "documents"))
    removed = F.transform("runs", lambda r: F.concat_ws("-", r["first"], r["last"]))
    return found.select(
        "doc_id",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + w).alias("n_words"),
        F.size(lines.covered(F.col("runs"))).cast("long").alias("n_removed"),
        F.aggregate(
            lines.covered(F.col("runs")), F.lit(0).cast("long"), lambda n, i: n + F.get("words", i)
        ).alias("n_removed_words"),
        F.array_join(removed, ",").alias("removed"),
    )


@query
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.redactions(table(spark, sf_dir, "documents"))
    count = {k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long") for k in pii.KINDS}
    return found.select(
        "doc_id",
        *[n.alias(f"n_{k}") for k, n in count.items()],
        F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"),
        pii.listed(pii.in_order(F.col("base"), F.col("added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation that does not fit a long is null here; the operator has it as a decimal."""
    found = whitening.whitened(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return found.withColumn("deviation", F.expr("try_cast(deviation AS long)"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults put in by the CRC-32 of ``conv_id:turn``; nulls are one space there and in texts."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    way = F.crc32(F.concat_ws(":", *named)) % 20
    text, role = (F.coalesce(c, F.lit(" ")) for c in ("text", "role"))
    changed = rows.select(
        "conv_id",
        "turn",
        F.when(way == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(way == 1, F.lit("")).when(way == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.array_repeat(F.lit(0), F.when(way == 0, 0).when(way == 3, 2).otherwise(1)).alias("copies"),
    )
    return changed.select("conv_id", "turn", "role", "text", F.explode("copies").alias("copy")).drop("copy")


@query
def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of the table, also those of which the damage leaves nothing."""
    rows = table(spark, sf_dir, "conversations")
    found, _ = conversations.repairs(damaged(rows))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    all_of_them = rows.select("conv_id").distinct()
    return all_of_them.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select(
        "conv_id",
        *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


@checked(
    r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, s, ws[s : s + 12] AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS s FROM d WHERE len(ws) > 12)
), gone AS (
  SELECT DISTINCT doc_id, p FROM (
    SELECT doc_id, unnest(range(s, s + 13)) AS p
    FROM (SELECT *, min(doc_id) OVER (PARTITION BY w) AS source FROM win) WHERE source < doc_id)
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text
  FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d) ANTI JOIN gone USING (doc_id, p)
  GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
)
def op13_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.removals(table(spark, sf_dir, "documents"))
