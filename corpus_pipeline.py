"""The corpus pipeline: language, repeated passages, near-duplicates, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontam, language, lines, packing, simhash
from tidewatch.llm.queries import table, tokenizer_path
from tidewatch.llm.shared import fresh
from tidewatch.session import written


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the corpus's languages; those without letters or far from all of them go.

    The profiles are learned from all documents with a language. If there is none, all stay.
    """
    profiles = language.fit(docs)
    if not profiles.languages:
        return docs
    found = fresh(docs, "_language")
    judged = docs.withColumn(found, language.judged(profiles, F.col("text")))
    return judged.where(F.col(found)["lang"] != language.UNDETERMINED).select(*docs.columns)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier ones, or earlier parts of them, hold already."""
    return lines.without_repeats(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group whose fingerprints are linked."""
    return simhash.one_of_each(docs, shingle=3, radius=2)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item's window of ten words."""
    return decontam.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2,048 tokens."""
    return packing.packed(docs, tokenizer_path())


STAGES = [
    ("language", keep_known_languages),
    ("line_dedup", cut_repeated_lines),
    ("simhash", keep_one_of_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack),
]

# Profiles, fingerprints and tokens are not SQL's; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
