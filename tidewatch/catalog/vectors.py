"""Embeddings, technique matching, chunk pooling and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.catalog.registry import query, table
from tidewatch.operators import features, match, neighbours, subwords
from tidewatch.plans import jobs


def vector_sql(texts: str, fit: str | None = None) -> str:
    """CTEs ``tokens`` (id, raw, words) and ``vocabulary`` (word, idf) fitted on ``fit``, there with one more."""
    split = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
    return f"""
WITH tokens AS (SELECT id, text AS raw, {split} AS words FROM ({texts})),
fit_tokens AS (SELECT id, text AS raw, {split} AS words FROM ({fit or texts})),
vocabulary AS (
  SELECT word, ln(((SELECT count(*) FROM fit_tokens WHERE trim(raw) <> '') + 1) / (count(*) + 1)) {"+ 1" if fit else ""} AS idf
  FROM (SELECT unnest(list_distinct(words)) AS word FROM fit_tokens)
  GROUP BY word
)
"""


UNIT_SQL = """
, counted AS (
  SELECT id, word, count(*) AS tf FROM (SELECT id, unnest(words) AS word FROM tokens) GROUP BY id, word
), weighted AS (SELECT id, word, tf * idf AS x FROM counted JOIN vocabulary USING (word)),
unit AS (
  SELECT id, word, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS weight FROM weighted WHERE x <> 0
)
"""

DOCS = "SELECT doc_id AS id, text FROM documents"


@query(
    vector_sql(DOCS) + UNIT_SQL + "SELECT id AS doc_id, word, round(weight, 6) AS weight FROM unit"
)
def tfidf_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = features.word_weights(docs, "text")
    return features.embed(docs, weights, "doc_id", "text").withColumn("weight", F.round("weight", 6))


@query(
    vector_sql(DOCS)
    + """
, starts AS (
  SELECT id, words, unnest(range(0, len(words), 256)) AS start FROM tokens WHERE len(words) > 0
), chunk_words AS (
  SELECT id, start, unnest(words[start + 1:start + 510]) AS word FROM starts
), weighted AS (
  SELECT id, start, word, count(*) * any_value(idf) AS x FROM chunk_words JOIN vocabulary USING (word)
  GROUP BY id, start, word
), unit AS (
  SELECT id, word, x / sqrt(sum(x * x) OVER (PARTITION BY id, start)) AS weight FROM weighted WHERE x <> 0
), n AS (SELECT id, count(*) AS chunks FROM starts GROUP BY id)
SELECT id AS doc_id, word, round(sum(weight) / max(chunks), 6) AS weight
FROM unit JOIN n USING (id) GROUP BY id, word
"""
)
def chunk_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jobs.embed_long_texts(docs, "doc_id", "text").withColumn("weight", F.round("weight", 6))


@query(
    """
WITH techniques AS (
  SELECT vec_id AS ordinal, embedding FROM embeddings WHERE vec_id % 2 = 0
  UNION ALL
  SELECT CASE WHEN vec_id % 4 = 0 THEN -1 - vec_id ELSE vec_id + 1000000000 END, embedding
  FROM embeddings WHERE vec_id % 2 = 0
), scores AS (
  SELECT t.vec_id AS text_id, m.ordinal,
    list_cosine_similarity(t.embedding::DOUBLE[], m.embedding::DOUBLE[]) AS score
  FROM embeddings t, techniques m WHERE t.vec_id % 2 = 1
)
SELECT text_id, ordinal, round(score, 6) AS score FROM scores
QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY score DESC, ordinal) = 1
"""
)
def tied_techniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every technique stands twice, its copy before or after it: the lowest ordinal wins each tie."""
    vectors = table(spark, sf_dir, "embeddings")
    key = F.col("vec_id")
    known = vectors.filter(key % 2 == 0)
    copies = F.when(key % 4 == 0, -1 - key).otherwise(key + 1_000_000_000)
    techniques = known.select(key.alias("ordinal"), F.col("embedding").alias("vector")).unionAll(
        known.select(copies, "embedding")
    )
    texts = vectors.filter(key % 2 == 1).select(key.alias("text_id"), F.col("embedding").alias("vector"))
    best = match.nearest(texts, techniques, 64)
    return best.withColumn("score", F.round("score", 6))


# The benchmark's words give the pieces: starts of one and four letters, and continuing ones from where those end.
SUBWORDS_SQL = r"""
WITH RECURSIVE listed AS (
  SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+|[^\p{L}\p{N}\s]')) AS w FROM benchmark
), vocabulary AS (
  SELECT DISTINCT unnest([w[1:1], w[1:4], '##' || w[5:7], '##' || w[8:8], '##' || w[-1:]]) AS piece FROM listed
), placed AS (
  SELECT id, unnest(ws) AS word, generate_subscripts(ws, 1) AS place FROM (
    SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+|[^\p{L}\p{N}\s]') AS ws FROM documents)
), found AS (SELECT DISTINCT word FROM placed),
parts AS (
  SELECT word, pos, n, CASE WHEN pos > 0 THEN '##' ELSE '' END || substr(word, pos + 1, n) AS piece
  FROM (SELECT word, unnest(range(0, length(word))) AS pos FROM found WHERE length(word) <= 100), range(1, 5) AS s(n)
  WHERE pos + n <= length(word)
), best AS (SELECT word, pos, max(n) AS n FROM parts JOIN vocabulary USING (piece) GROUP BY word, pos),
walk AS (
  SELECT word, CAST(0 AS BIGINT) AS pos, CAST(NULL AS VARCHAR) AS piece FROM found
  UNION ALL
  SELECT w.word, w.pos + n, CASE WHEN w.pos > 0 THEN '##' ELSE '' END || substr(w.word, w.pos + 1, n)
  FROM walk w JOIN best b ON b.word = w.word AND b.pos = w.pos
), cuts AS (
  SELECT word, CASE WHEN max(pos) = length(word) THEN list(piece ORDER BY pos) FILTER (piece IS NOT NULL)
    ELSE ['[UNK]'] END AS pieces
  FROM walk GROUP BY word
), tokens AS (SELECT id, flatten(list(pieces ORDER BY place)) AS words FROM placed JOIN cuts USING (word) GROUP BY id)
"""


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "benchmark").select(F.explode(subwords.words(F.col("text"))).alias("w")).distinct()
    w = F.col("w")
    later = [F.substring(w, 5, 3), F.substring(w, 8, 1), F.substring(w, -1, 1)]
    pieces = [F.substring(w, 1, 1), F.substring(w, 1, 4), *[F.concat(F.lit("##"), x) for x in later]]
    return listed.select(F.explode(F.array(*pieces)).alias("piece")).distinct()


@query(
    SUBWORDS_SQL
    + """
SELECT doc_id, coalesce(len(words), 0) AS n_tokens, len(list_filter(coalesce(words, []), lambda w: w = '[UNK]')) AS n_unknown,
  CAST(ceil(coalesce(len(words), 0) / 256.0) AS BIGINT) AS n_chunks, md5(coalesce(array_to_string(words, ' '), '')) AS tokens_md5
FROM documents LEFT JOIN tokens ON id = doc_id
"""
)
def subword_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as pieces of a vocabulary, and the number of a model's windows that they fill."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = subwords.with_tokens(docs, "text", _pieces(spark, sf_dir))
    tokens = F.col("tokens")
    return cut.select(
        "doc_id",
        F.size(tokens).cast("long").alias("n_tokens"),
        F.size(F.filter(tokens, lambda t: t == subwords.UNKNOWN)).cast("long").alias("n_unknown"),
        F.coalesce(F.size(features.chunks(tokens)), F.lit(0)).cast("long").alias("n_chunks"),
        F.md5(F.array_join(tokens, " ")).alias("tokens_md5"),
    )


@query(
    SUBWORDS_SQL
    + """
, idf AS (
  SELECT word, ln(((SELECT count(*) FROM tokens) + 1) / (count(*) + 1)) AS idf
  FROM (SELECT unnest(list_distinct(words)) AS word FROM tokens) GROUP BY word
), starts AS (SELECT id, words, unnest(range(0, len(words), 256)) AS start FROM tokens),
chunk_words AS (SELECT id, start, unnest(words[start + 1:start + 510]) AS word FROM starts),
weighted AS (SELECT id, start, word, count(*) * any_value(idf) AS x FROM chunk_words JOIN idf USING (word) GROUP BY id, start, word),
unit AS (SELECT id, word, x / sqrt(sum(x * x) OVER (PARTITION BY id, start)) AS weight FROM weighted WHERE x <> 0),
n AS (SELECT id, count(*) AS chunks FROM starts GROUP BY id)
SELECT id AS doc_id, word, round(sum(weight) / max(chunks), 6) AS weight FROM unit JOIN n USING (id) GROUP BY id, word
"""
)
def chunk_mean_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vectors of windows that are counted in a model's tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = jobs.embed_long_texts(docs, "doc_id", "text", _pieces(spark, sf_dir))
    return found.withColumn("weight", F.round("weight", 6))


@query(
    """
WITH scores AS (
  SELECT t.vec_id AS text_id, m.vec_id AS ordinal,
    list_cosine_similarity(t.embedding::DOUBLE[], m.embedding::DOUBLE[]) AS score
  FROM embeddings t, embeddings m WHERE m.vec_id % 2 = 0 AND t.vec_id % 2 = 1
)
SELECT text_id, ordinal, round(score, 6) AS score FROM scores
QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY score DESC, ordinal) = 1
"""
)
def nearest_technique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of even ids play the techniques, all others the texts."""
    vectors = table(spark, sf_dir, "embeddings")
    known = F.col("vec_id") % 2 == 0
    best = match.nearest(
        vectors.filter(~known).select(F.col("vec_id").alias("text_id"), F.col("embedding").alias("vector")),
        vectors.filter(known).select(F.col("vec_id").alias("ordinal"), F.col("embedding").alias("vector")),
        64,
    )
    return best.withColumn("score", F.round("score", 6))


def benchmark_techniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").orderBy("item_id").select(
        F.col("item_id").cast("string").alias("technique_id"), F.col("text").alias("technique_name")
    )


ITEMS = "SELECT item_id AS id, text FROM benchmark"

# Best benchmark item of each text, after ``vector_sql`` and ``UNIT_SQL``.
MATCH_SQL = """
, item_words AS (
  SELECT id, word, count(*) * any_value(idf) AS x
  FROM (SELECT id, unnest(words) AS word FROM fit_tokens) JOIN vocabulary USING (word) GROUP BY id, word
), items AS (SELECT id AS item_id, word, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS w FROM item_words WHERE x <> 0),
scores AS (
  SELECT id, item_id, sum(weight * w) AS score FROM unit JOIN items USING (word) GROUP BY id, item_id
), best AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, item_id) = 1
)
"""


@query(
    vector_sql(DOCS, ITEMS)
    + UNIT_SQL
    + MATCH_SQL
    + """
SELECT d.doc_id, COALESCE(CAST(item_id AS VARCHAR), 'none') AS match_id, COALESCE(round(score, 6), -1) AS score
FROM documents d LEFT JOIN best ON best.id = d.doc_id
"""
)
def matched_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against the benchmark items as techniques."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = benchmark_techniques(spark, sf_dir)
    matched = jobs.match_techniques(docs, items, "text")
    return matched.select(
        "doc_id",
        F.coalesce("mitre_match.id", F.lit("none")).alias("match_id"),
        F.coalesce(F.round("mitre_match.score", 6), F.lit(-1.0)).alias("score"),
    )


@query(
    vector_sql(DOCS, ITEMS)
    + UNIT_SQL
    + MATCH_SQL
    + """
SELECT d.doc_id // 2 AS cve_id, CASE WHEN d.doc_id % 5 = 0 THEN 'old' ELSE COALESCE(CAST(item_id AS VARCHAR), 'none') END AS match_id,
  CASE WHEN d.doc_id % 5 = 0 THEN 0.5 ELSE COALESCE(round(score, 6), -1) END AS score
FROM documents d LEFT JOIN best ON best.id = d.doc_id
"""
)
def cve_technique_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents play CVE summaries, two to an id; a fifth was matched before."""
    key = F.col("doc_id")
    old = F.struct(F.lit("old").alias("id"), F.lit("n").alias("name"), F.lit(0.5).alias("score"))
    cves = table(spark, sf_dir, "documents").select(
        F.floor(key / 2).alias("cve_id"),
        F.col("text").alias("summary"),
        F.when(key % 5 == 0, old).alias("mitre_match"),
    )
    items = benchmark_techniques(spark, sf_dir).withColumn("description", F.col("technique_name"))
    return jobs.match_unmatched(cves, items).select(
        "cve_id",
        F.coalesce("mitre_match.id", F.lit("none")).alias("match_id"),
        F.coalesce(F.round("mitre_match.score", 6), F.lit(-1.0)).alias("score"),
    )


@query(
    """
WITH scores AS (
  SELECT t.vec_id AS text_id, m.vec_id AS ordinal,
    list_cosine_similarity(t.embedding::DOUBLE[], m.embedding::DOUBLE[]) AS score
  FROM embeddings t, embeddings m WHERE m.vec_id % 2 = 1 AND t.vec_id % 2 = 0
)
SELECT text_id, ordinal, round(score, 6) AS score FROM scores
QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY score DESC, ordinal) = 1
"""
)
def nearest_technique_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of odd ids play the techniques, dealt to blocks that texts meet or skip."""
    vectors = table(spark, sf_dir, "embeddings")
    known = F.col("vec_id") % 2 == 1
    best = match.nearest(
        vectors.filter(~known).select(F.col("vec_id").alias("text_id"), F.col("embedding").alias("vector")),
        vectors.filter(known).select(F.col("vec_id").alias("ordinal"), F.col("embedding").alias("vector")),
        64,
        broadcast_elements=64,
    )
    return best.withColumn("score", F.round("score", 6))


@query(
    """
WITH pairs AS (
  SELECT a.vec_id, b.vec_id AS neighbour, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS distance
  FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id
)
SELECT vec_id, neighbour, rank, round(distance, 6) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS rank FROM pairs
) WHERE rank <= 5
"""
)
def projection_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of each vector: the edges that a layout is drawn from."""
    vectors = table(spark, sf_dir, "embeddings")
    rows = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    found = neighbours.search(rows, rows, 5, exclude_same=True).nearest
    return found.select(
        F.col("id").alias("vec_id"), "neighbour", F.col("rank").cast("long").alias("rank"),
        F.round("distance", 6).alias("distance"),
    )


def summary_sql(texts: str) -> str:
    """CTEs up to ``chosen`` (id, summary) over ``texts`` (id, text)."""
    return rf"""
s AS (
  SELECT id, list_filter(list_transform(string_split_regex(
      regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x)), lambda x: x <> '') AS ss
  FROM ({texts})
), sentences AS (
  SELECT id, unnest(ss) AS sentence, generate_subscripts(ss, 1) AS pos FROM s
), sized AS (
  SELECT id, pos, list_filter(string_split_regex(lower(sentence), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS ws
  FROM sentences
), words AS (SELECT id, pos, len(ws) AS size, unnest(ws) AS word FROM sized WHERE len(ws) > 0),
weights AS (
  SELECT *, CASE WHEN length(word) > 3 THEN count(*) OVER (PARTITION BY id, word) ELSE 0 END AS weight FROM words
), scored AS (
  SELECT id, pos, max(size) AS size, sum(weight) / max(size) AS score FROM weights GROUP BY id, pos
), taken AS (
  SELECT *, sum(size) OVER (PARTITION BY id ORDER BY score DESC, pos ROWS UNBOUNDED PRECEDING) AS total FROM scored
), chosen AS (
  SELECT id, string_agg(sentence, ' ' ORDER BY pos) AS summary
  FROM taken JOIN sentences USING (id, pos) WHERE total <= 130 OR total - size < 30 GROUP BY id
)
"""


@query(
    "WITH "
    + summary_sql(DOCS)
    + "SELECT doc_id, md5(COALESCE(summary, '')) AS summary_md5 FROM documents LEFT JOIN chosen ON id = doc_id"
)
def extractive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.md5(features.summary(F.col("text"))).alias("summary_md5"))
