"""Group, region and technique aggregates.

Hosts and their CVEs are kept as pairs (``host_id, cve_id``): counts are
combined before each shuffle, and no host's list is gathered in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators import dedupe


def explode_cves(hosts: DataFrame, host: str = "host_id") -> DataFrame:
    """Pairs of a host table with an in-row CVE list; empty lists give no row."""
    return hosts.select(host, F.explode("cve_list").alias("cve_id")).filter(
        F.col("cve_id").isNotNull()
    )


def distinct_cves(pairs: DataFrame) -> DataFrame:
    return pairs.select("cve_id").distinct().orderBy("cve_id")


def usable_cves(cves: DataFrame) -> DataFrame:
    """CVE rows with a score, a technique and, where there is such a column, a similarity."""
    needed = [c for c in ("cvss", "technique_id", "similarity") if c in cves.columns]
    return cves.dropna(subset=needed)


def usable_techniques(techniques: DataFrame) -> DataFrame:
    """Complete technique rows, one per id."""
    complete = techniques.dropna(subset=["technique_id", "technique_name", "description"])
    return dedupe.keep_first(
        complete, ["technique_id"], [F.col("technique_name"), F.col("description")]
    )


def key_technique_counts(
    pairs: DataFrame, hosts: DataFrame, cves: DataFrame, key: str = "group"
) -> DataFrame:
    """``key, technique_id, count`` over all host-CVE pairs.

    Pairs are summed to ``(key, cve_id)`` before the CVE join, so a CVE found
    almost everywhere meets the CVE table once per key, not once per host.
    """
    owners = hosts.select("host_id", key).filter(F.col(key).isNotNull())
    per_cve = pairs.join(owners, "host_id").groupBy(key, "cve_id").agg(F.count("*").alias("n"))
    return (
        per_cve.join(cves.select("cve_id", "technique_id"), "cve_id")
        .groupBy(key, "technique_id")
        .agg(F.sum("n").alias("count"))
    )


def describe_techniques(counts: DataFrame, techniques: DataFrame) -> DataFrame:
    """Counts with technique name and description; rows without them are dropped."""
    return counts.join(techniques, "technique_id", "left").dropna(
        subset=["technique_name", "description"]
    )


def group_cves(pairs: DataFrame, hosts: DataFrame, cves: DataFrame, group: str) -> DataFrame:
    """CVE rows that occur in the hosts of one group."""
    members = hosts.filter(F.col("group") == group).select("host_id")
    ids = pairs.join(members, "host_id", "left_semi").select("cve_id").distinct()
    return cves.join(ids, "cve_id", "left_semi")


def value_counts(df: DataFrame, column: str, count: str = "count") -> DataFrame:
    """Rows per value, most frequent first; nulls are not counted."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias(count))
        .orderBy(F.desc(count), column)
    )


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def mean_position(hosts: DataFrame, key: str = "group") -> DataFrame:
    return hosts.groupBy(key).agg(
        F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude")
    )


def technique_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("technique_id").agg(F.sum("count").alias("count"))


def top_techniques(counts: DataFrame, key: str = "cluster", k: int = 5) -> DataFrame:
    """The ``k`` most frequent techniques of each key, ties by id, with their ``rank``."""
    order = [F.desc("count"), F.col("technique_id")]
    return dedupe.top_k(counts, [key], order, k, rank="rank")


def top_totals(counts: DataFrame, k: int = 8) -> DataFrame:
    return technique_totals(counts).orderBy(F.desc("count"), "technique_id").limit(k)


def zero_filled(counts: DataFrame, key: str) -> DataFrame:
    """``key, technique_id, count`` of every key and technique, absent pairs as 0.

    The techniques, which name the columns of the matrix, are one value of a subquery; keys may be many.
    """
    names = counts.select(F.collect_set("technique_id")).scalar()
    grid = counts.select(key).distinct().select(key, F.explode(names).alias("technique_id"))
    return grid.join(counts, [key, "technique_id"], "left").select(
        key, "technique_id", F.coalesce("count", F.lit(0)).alias("count")
    )


def pivot_counts(counts: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Wide matrix of counts, one column per technique, missing pairs as 0."""
    wide = counts.groupBy(key).pivot("technique_id", list(values)).agg(F.sum("count"))
    return wide.fillna(0, subset=list(values))


def radar_counts(counts: DataFrame, key: str = "cluster", k: int = 8) -> DataFrame:
    """Count of each of the ``k`` most frequent techniques for every key that has one of them.

    The labels are ``k`` values at most; ``counts`` is read twice, so pass a written table.
    """
    labels = sorted(row["technique_id"] for row in top_totals(counts, k).collect())
    kept = counts.filter(F.col("technique_id").isin(labels))
    return pivot_counts(kept, key, labels).unpivot([key], labels, "technique_id", "count")


def technique_text(top: DataFrame, key: str = "cluster") -> DataFrame:
    """The top techniques of a key as one text, in rank order (``top`` bounds the list)."""
    entry = F.format_string(
        "%s (%s): %s", F.col("technique_name"), F.col("technique_id"), F.col("description")
    )
    ordered = F.array_sort(F.collect_list(F.struct(F.col("rank"), entry.alias("entry"))))
    return top.groupBy(key).agg(
        F.array_join(F.transform(ordered, lambda x: x["entry"]), ". ").alias("description_text")
    )


# Request text around the technique descriptions of a cluster (fixed value).
PROMPT = """
    아래는 사이버 공격 클러스터 %s에서 자주 나타나는 MITRE ATT&CK TTP 설명입니다:

    %s

    이 클러스터의 위협 행위 특성과 관련 랜섬웨어 그룹의 공격 전략을 기반으로 다음을 요약해 주세요:
    - 어떤 공격 유형이 포함되는가 (초기 침입, lateral movement 등)
    - 특징적인 TTP 조합이 의미하는 위협 유형
    - 관련 랜섬웨어 그룹 사례 예시가 있다면

    요약으로 제시해 주세요.
        """


def prompt_text(key: Column, description: Column, template: str = PROMPT) -> Column:
    """``template`` with the key and the description in its two places."""
    return F.format_string(template, key.cast("string"), description)


def technique_catalogue(techniques: DataFrame) -> DataFrame:
    return (
        techniques.select("technique_id", "technique_name", "description")
        .distinct()
        .orderBy("technique_id", "technique_name", "description")
    )


def host_summaries(pairs: DataFrame, cves: DataFrame, techniques: DataFrame) -> DataFrame:
    """``cve_summary`` and ``ttp_summary`` of every host that has CVEs.

    The first three CVEs come from a trimmed ranking and the names from a
    distinct set of techniques, so a host's whole CVE list is never gathered.
    """
    head = dedupe.top_k(pairs, ["host_id"], [F.col("cve_id")], 3)
    names = F.array_sort(F.collect_list("cve_id"))
    sizes = pairs.groupBy("host_id").agg(F.count("*").alias("n"))
    cve_text = (
        head.groupBy("host_id")
        .agg(names.alias("head"))
        .join(sizes, "host_id")
        .select(
            "host_id",
            F.concat(
                F.array_join(F.col("head").cast("array<string>"), ", "),
                F.when(F.col("n") > 3, "...").otherwise(""),
            ).alias("cve_summary"),
        )
    )
    named = cves.select("cve_id", "technique_id").join(
        techniques.select("technique_id", "technique_name"), "technique_id"
    )
    ttp_text = (
        pairs.join(named.select("cve_id", "technique_name"), "cve_id")
        .select("host_id", "technique_name")
        .distinct()
        .groupBy("host_id")
        .agg(F.array_join(F.array_sort(F.collect_list("technique_name")), ", ").alias("ttp_summary"))
    )
    return cve_text.join(ttp_text, "host_id", "left").fillna("", subset=["ttp_summary"])


def neighbours(
    df: DataFrame, key: str, item: str, order: str, bucket_rows: int = 65_536
) -> DataFrame:
    """Position of each row within its key, and the items before and after it, circular.

    ``order`` is a unique integer. Rows are numbered within buckets of at most
    ``bucket_rows`` order values; per-bucket counts and edge items then shift
    each bucket into place, so a key with a third of all rows is spread over
    many tasks.
    """
    bucketed = df.withColumn("_bucket", F.floor(F.col(order) / F.lit(bucket_rows)))
    inside = Window.partitionBy(key, "_bucket").orderBy(order)
    buckets = bucketed.groupBy(key, "_bucket").agg(
        F.count("*").alias("_n"),
        F.min_by(item, order).alias("_first"),
        F.max_by(item, order).alias("_last"),
    )
    line = Window.partitionBy(key).orderBy("_bucket")
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = buckets.select(
        F.col(key).alias("_key"),
        F.col("_bucket").alias("_at"),
        F.coalesce(
            F.sum("_n").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_offset"),
        F.sum("_n").over(whole).alias("of"),
        F.coalesce(F.lag("_last").over(line), F.last("_last").over(whole)).alias("_before"),
        F.coalesce(F.lead("_first").over(line), F.first("_first").over(whole)).alias("_after"),
    )
    local = bucketed.withColumns(
        {
            "_row": F.row_number().over(inside),
            "_lag": F.lag(item).over(inside),
            "_lead": F.lead(item).over(inside),
        }
    )
    same = (local[key] == placed["_key"]) & (local["_bucket"] == placed["_at"])
    return local.join(placed, same).select(
        *df.columns,
        (F.col("_offset") + F.col("_row")).alias("position"),
        "of",
        F.coalesce("_lag", "_before").alias("previous_item"),
        F.coalesce("_lead", "_after").alias("next_item"),
    )


def neighbour_dates(df: DataFrame, column: str) -> DataFrame:
    """Each date of the table with the one before and after it, clamped at both ends.

    The window runs over distinct dates, one row per calendar day.
    """
    days = df.select(column).filter(F.col(column).isNotNull()).distinct()
    line = Window.partitionBy(F.lit(0)).orderBy(column)
    return days.select(
        column,
        F.coalesce(F.lag(column).over(line), F.col(column)).alias("previous_date"),
        F.coalesce(F.lead(column).over(line), F.col(column)).alias("next_date"),
    )
