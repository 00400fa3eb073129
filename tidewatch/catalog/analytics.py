"""Group, region, technique and cluster aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.catalog import standins as S
from tidewatch.catalog.registry import query, table
from tidewatch.functions import lists
from tidewatch.operators import aggregates, cluster, neighbours
from tidewatch.plans import jobs
from tidewatch.session import written


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.key_technique_counts(
        S.pairs(spark, sf_dir), S.placed_hosts(spark, sf_dir), S.cves(spark, sf_dir)
    )


def _cluster_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with a group in the place of a cluster."""
    described = aggregates.describe_techniques(
        _counts(spark, sf_dir), aggregates.usable_techniques(S.techniques(spark, sf_dir))
    )
    return described.withColumnRenamed("group", "cluster")


@query(S.SQL + 'SELECT "group", technique_id, "count" FROM counts')
def group_technique_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir)


@query(
    S.SQL
    + """
SELECT g."group", t.technique_id, COALESCE(c."count", 0) AS "count"
FROM (SELECT DISTINCT "group" FROM counts) g
CROSS JOIN (SELECT DISTINCT technique_id FROM counts) t
LEFT JOIN counts c ON c."group" = g."group" AND c.technique_id = t.technique_id
"""
)
def group_technique_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = jobs.technique_matrix(
        S.pairs(spark, sf_dir), S.placed_hosts(spark, sf_dir), S.cves(spark, sf_dir)
    )
    return aggregates.zero_filled(matrix, "group")


@query(
    S.SQL
    + """
SELECT country_code || ' - ' || region_code AS region_full, CAST(count(*) AS BIGINT) AS server_count
FROM placed GROUP BY 1
"""
)
def region_servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = S.placed_hosts(spark, sf_dir).withColumn(
        "region_full", lists.region_label(F.col("country_code"), F.col("region_code"))
    )
    return aggregates.value_counts(labelled, "region_full", "server_count")


@query(
    S.SQL
    + """
SELECT "group", round(avg(latitude), 6) AS latitude, round(avg(longitude), 6) AS longitude
FROM placed GROUP BY "group"
"""
)
def group_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    centers = aggregates.mean_position(S.placed_hosts(spark, sf_dir))
    return centers.select(
        "group", *[F.round(c, 6).alias(c) for c in ("latitude", "longitude")]
    )


@query(S.SQL + 'SELECT DISTINCT "group" FROM placed WHERE "group" IS NOT NULL')
def group_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.distinct_sorted(S.placed_hosts(spark, sf_dir), "group")


@query(
    S.SQL
    + f"""
SELECT cve_id, cvss, technique_id FROM cves WHERE cve_id IN (
  SELECT cve_id FROM pairs JOIN placed USING (host_id) WHERE "group" = '{S.GROUP}')
"""
)
def group_cve_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.group_cves(
        S.pairs(spark, sf_dir), S.placed_hosts(spark, sf_dir), S.cves(spark, sf_dir), S.GROUP
    )


@query(
    S.SQL
    + f"""
SELECT technique_id, technique_name, description, CAST(count(*) AS BIGINT) AS "count"
FROM cves JOIN techniques USING (technique_id)
WHERE cve_id IN (SELECT cve_id FROM pairs JOIN placed USING (host_id) WHERE "group" = '{S.GROUP}')
GROUP BY technique_id, technique_name, description
"""
)
def group_profile_techniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(spark, sf_dir).techniques


HOST_SUMMARY = """
, ranked AS (
  SELECT host_id, cve_id, row_number() OVER (PARTITION BY host_id ORDER BY cve_id) AS r,
         count(*) OVER (PARTITION BY host_id) AS n
  FROM pairs
), cve_text AS (
  SELECT host_id, string_agg(CAST(cve_id AS VARCHAR), ', ' ORDER BY r)
         || CASE WHEN max(n) > 3 THEN '...' ELSE '' END AS cve_summary
  FROM ranked WHERE r <= 3 GROUP BY host_id
), ttp_text AS (
  SELECT host_id, string_agg(technique_name, ', ' ORDER BY technique_name) AS ttp_summary
  FROM (SELECT DISTINCT host_id, technique_name FROM pairs JOIN cves USING (cve_id)
        JOIN techniques USING (technique_id))
  GROUP BY host_id
), summaries AS (
  SELECT host_id, cve_summary, COALESCE(ttp_summary, '') AS ttp_summary
  FROM cve_text LEFT JOIN ttp_text USING (host_id)
)
"""


@query(S.SQL + HOST_SUMMARY + "SELECT * FROM summaries")
def host_technique_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.host_summaries(
        S.pairs(spark, sf_dir),
        S.cves(spark, sf_dir),
        aggregates.usable_techniques(S.techniques(spark, sf_dir)),
    )


def _profile(spark: SparkSession, sf_dir: str) -> jobs.GroupProfile:
    return jobs.group_profile(
        S.hosts(spark, sf_dir),
        S.pairs(spark, sf_dir),
        S.cves(spark, sf_dir),
        S.techniques(spark, sf_dir),
        S.GROUP,
    )


@query(
    S.SQL
    + HOST_SUMMARY
    + f"""
SELECT host_id, country_code || ' - ' || region_code AS region_full,
  'Group: ' || "group" || chr(10) || 'Domain: ' || domain || chr(10) || 'CVE: '
  || COALESCE(cve_summary, '') || chr(10) || 'TTP: ' || COALESCE(ttp_summary, '') AS tooltip_info
FROM placed LEFT JOIN summaries USING (host_id) WHERE "group" = '{S.GROUP}'
"""
)
def group_profile_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(spark, sf_dir).hosts.select("host_id", "region_full", "tooltip_info")


@query(
    S.SQL
    + """
, members AS (
  SELECT host_id, CASE WHEN n_nationkey % 4 <> 3 THEN n_nationkey % 4 END AS cluster
  FROM placed JOIN gazetteer ON placed."group" = gazetteer.region_code
)
SELECT CAST(cluster AS BIGINT) AS cluster, technique_id, technique_name, description,
       CAST(count(*) AS BIGINT) AS "count"
FROM members JOIN pairs USING (host_id) JOIN cves USING (cve_id) JOIN techniques USING (technique_id)
WHERE cluster IN (0, 2) GROUP BY ALL
"""
)
def cluster_technique_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts joined to given cluster labels, some groups without one; two clusters selected."""
    key = F.col("n_nationkey") % 4
    labels = S.gazetteer(spark, sf_dir).filter(key != 3).select(
        F.col("region_code").alias("group"), key.cast("long").alias("cluster")
    )
    members = S.placed_hosts(spark, sf_dir).join(labels, "group", "left")
    counts = aggregates.key_technique_counts(
        S.pairs(spark, sf_dir),
        members.filter(F.col("cluster").isin(0, 2)),
        S.cves(spark, sf_dir),
        "cluster",
    )
    return aggregates.describe_techniques(
        counts, aggregates.usable_techniques(S.techniques(spark, sf_dir))
    )


TOP5 = """
, top5 AS (
  SELECT "group" AS cluster, technique_id, technique_name, description, "count",
         row_number() OVER (PARTITION BY "group" ORDER BY "count" DESC, technique_id) AS rank
  FROM counts JOIN techniques USING (technique_id)
  QUALIFY rank <= 5
)
"""


@query(
    S.SQL
    + TOP5
    + 'SELECT cluster, technique_id, technique_name, "count", CAST(rank AS BIGINT) AS rank FROM top5'
)
def cluster_top5_techniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = aggregates.top_techniques(_cluster_counts(spark, sf_dir))
    return top.select(
        "cluster", "technique_id", "technique_name", "count", F.col("rank").cast("long").alias("rank")
    )


@query(
    S.SQL
    + TOP5
    + """
, texts AS (
  SELECT cluster, string_agg(technique_name || ' (' || technique_id || '): ' || description, '. '
                             ORDER BY rank) AS description_text
  FROM top5 GROUP BY cluster
)
SELECT cluster, description_text, format('
    아래는 사이버 공격 클러스터 {}에서 자주 나타나는 MITRE ATT&CK TTP 설명입니다:

    {}

    이 클러스터의 위협 행위 특성과 관련 랜섬웨어 그룹의 공격 전략을 기반으로 다음을 요약해 주세요:
    - 어떤 공격 유형이 포함되는가 (초기 침입, lateral movement 등)
    - 특징적인 TTP 조합이 의미하는 위협 유형
    - 관련 랜섬웨어 그룹 사례 예시가 있다면

    요약으로 제시해 주세요.
        ', cluster, description_text) AS prompt
FROM texts
"""
)
def technique_rollup_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = aggregates.technique_text(
        aggregates.top_techniques(_cluster_counts(spark, sf_dir))
    )
    return rolled.withColumn(
        "prompt", aggregates.prompt_text(F.col("cluster"), F.col("description_text"))
    )


@query(
    S.SQL
    + """
SELECT technique_id, CAST(sum("count") AS BIGINT) AS "count" FROM counts
GROUP BY technique_id ORDER BY 2 DESC, technique_id LIMIT 8
"""
)
def technique_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.top_totals(_counts(spark, sf_dir))


@query(
    S.SQL
    + """
, top8 AS (
  SELECT technique_id FROM counts GROUP BY technique_id
  ORDER BY sum("count") DESC, technique_id LIMIT 8
)
SELECT g.cluster, t.technique_id, COALESCE(c."count", 0) AS "count"
FROM (SELECT DISTINCT "group" AS cluster FROM counts JOIN top8 USING (technique_id)) g
CROSS JOIN top8 t
LEFT JOIN counts c ON c."group" = g.cluster AND c.technique_id = t.technique_id
"""
)
def radar_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _counts(spark, sf_dir).withColumnRenamed("group", "cluster")
    return aggregates.radar_counts(written(counts))


@query(S.SQL + "SELECT DISTINCT technique_id, technique_name, description FROM techniques")
def technique_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.technique_catalogue(S.techniques(spark, sf_dir))


@query("SELECT DISTINCT l_partkey AS cve_id FROM lineitem")
def distinct_cves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.distinct_cves(S.pairs(spark, sf_dir))


MATRIX = """
, grid AS (
  SELECT g."group", t.technique_id, COALESCE(c."count", 0) AS x
  FROM (SELECT DISTINCT "group" FROM counts) g
  CROSS JOIN (SELECT DISTINCT technique_id FROM counts) t
  LEFT JOIN counts c ON c."group" = g."group" AND c.technique_id = t.technique_id
), scaled AS (
  SELECT "group", technique_id,
         (x - avg(x) OVER w) / CASE WHEN stddev_pop(x) OVER w = 0 THEN 1 ELSE stddev_pop(x) OVER w END AS z
  FROM grid WINDOW w AS (PARTITION BY technique_id)
)
"""


@query(S.SQL + MATRIX + 'SELECT "group", technique_id, round(z, 6) + 0.0 AS z FROM scaled')
def standardized_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = jobs.technique_matrix(
        S.pairs(spark, sf_dir), S.placed_hosts(spark, sf_dir), S.cves(spark, sf_dir)
    )
    scaled = cluster.standardize(matrix, "group")
    return scaled.withColumn("z", F.round("z", 6) + 0.0)


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    matrix = jobs.technique_matrix(
        S.pairs(spark, sf_dir), S.placed_hosts(spark, sf_dir), S.cves(spark, sf_dir)
    )
    vectors, dims = cluster.scaled_vectors(matrix, "group")
    return written(vectors), dims


@query(
    S.SQL
    + MATRIX
    + """
, labelled AS (
  SELECT *, CAST(right("group", 1) AS INTEGER) % 3 AS cluster FROM scaled
), distances AS (
  SELECT a."group", a.cluster, b.cluster AS other, b."group" AS member,
         sqrt(sum((a.z - b.z) * (a.z - b.z))) AS d
  FROM labelled a JOIN labelled b USING (technique_id)
  GROUP BY a."group", a.cluster, b.cluster, b."group"
), means AS (
  SELECT "group", cluster, other, count(*) AS n,
         CASE WHEN cluster = other THEN sum(d) / nullif(count(*) - 1, 0) ELSE avg(d) END AS m
  FROM distances GROUP BY "group", cluster, other
), ab AS (
  SELECT "group", max(CASE WHEN cluster = other THEN n END) AS size,
         max(CASE WHEN cluster = other THEN m END) AS a, min(CASE WHEN cluster <> other THEN m END) AS b
  FROM means GROUP BY "group"
)
SELECT "group", round(CASE WHEN size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette
FROM ab
"""
)
def group_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Euclidean silhouette of fixed labels, the last digit of the group's name modulo 3."""
    vectors, dims = _vectors(spark, sf_dir)
    labelled = vectors.withColumn("cluster", F.substring("group", -1, 1).cast("int") % 3)
    scores = cluster.euclidean_silhouette(labelled, "group", dims)
    return scores.withColumn("silhouette", F.round("silhouette", 6))


# Groups of three planted kinds, from all orders: a kind has four techniques of its own.
PLANTED_SQL = """
WITH counts AS (
  SELECT 'G' || lpad(CAST(o_custkey % 30 AS VARCHAR), 2, '0') AS "group",
         'T' || (o_custkey % 3 * 4 + o_orderkey % 4) AS technique_id, CAST(count(*) AS BIGINT) AS "count"
  FROM orders GROUP BY ALL
)
"""
# The first group of the same kind.
KIND_SQL = """'G' || lpad(CAST(CAST(substr("group", 2) AS INTEGER) % 3 AS VARCHAR), 2, '0')"""


def _planted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Hosts, pairs, CVEs and techniques: an order is a host with one CVE."""
    key = F.col("o_custkey")
    cve = key % 3 * 4 + F.col("o_orderkey") % 4
    orders = table(spark, sf_dir, "orders")
    hosts = orders.select(
        F.col("o_orderkey").alias("host_id"),
        F.concat(F.lit("G"), F.lpad((key % 30).cast("string"), 2, "0")).alias("group"),
        F.lit(1.0).alias("latitude"),
        F.lit(2.0).alias("longitude"),
    )
    pairs = orders.select(F.col("o_orderkey").alias("host_id"), cve.alias("cve_id"))
    technique = F.concat(F.lit("T"), F.col("cve_id").cast("string"))
    cves = pairs.select("cve_id").distinct().select(
        "cve_id", F.lit(5.0).alias("cvss"), technique.alias("technique_id")
    )
    techniques = cves.select(
        "technique_id",
        F.concat(F.lit("name "), "technique_id").alias("technique_name"),
        F.concat(F.lit("about "), "technique_id").alias("description"),
    )
    return hosts, pairs, cves, techniques


def _planted_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    hosts, pairs, cves, _ = _planted(spark, sf_dir)
    vectors, dims = cluster.scaled_vectors(jobs.technique_matrix(pairs, hosts, cves), "group")
    return written(vectors), dims


def _by_first_member(labels: DataFrame) -> DataFrame:
    """``cluster, first``: a cluster's number and its smallest group, which does not depend on the fit."""
    return labels.groupBy("cluster").agg(F.min("group").alias("first"))


@query(
    PLANTED_SQL
    + MATRIX
    + f"""
, labelled AS (SELECT *, {KIND_SQL} AS kind FROM scaled),
centres AS (SELECT kind, technique_id, avg(z) AS c FROM labelled GROUP BY kind, technique_id),
cost AS (SELECT sum((z - c) * (z - c)) AS inertia FROM labelled JOIN centres USING (kind, technique_id)),
distances AS (
  SELECT a."group", a.kind, b.kind AS other, b."group" AS member, sqrt(sum((a.z - b.z) * (a.z - b.z))) AS d
  FROM labelled a JOIN labelled b USING (technique_id) GROUP BY ALL
), means AS (
  SELECT "group", kind, other, CASE WHEN kind = other THEN sum(d) / (count(*) - 1) ELSE avg(d) END AS m
  FROM distances GROUP BY "group", kind, other
), ab AS (
  SELECT "group", max(CASE WHEN kind = other THEN m END) AS a, min(CASE WHEN kind <> other THEN m END) AS b
  FROM means GROUP BY "group"
)
SELECT 3 AS k, round(any_value(inertia), 4) AS inertia, round(avg((b - a) / greatest(a, b)), 6) AS silhouette
FROM ab, cost
"""
)
def kmeans_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best k of the sweep over planted groups, with its cost and score."""
    vectors, dims = _planted_vectors(spark, sf_dir)
    sweep = cluster.sweep_k(vectors, "group", vectors.count(), dims)
    scores = spark.createDataFrame(list(sweep.scores), "k int, inertia double, silhouette double")
    best = scores.filter(F.col("k") == sweep.best_k)
    return best.select("k", F.round("inertia", 4).alias("inertia"), F.round("silhouette", 6).alias("silhouette"))


@query(PLANTED_SQL + f'SELECT DISTINCT "group", {KIND_SQL} AS cluster FROM counts')
def cluster_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted groups with their cluster, named after its first group."""
    vectors, dims = _planted_vectors(spark, sf_dir)
    sweep = cluster.sweep_k(vectors, "group", vectors.count(), dims)
    labels = written(cluster.assign(vectors, "group", sweep.model))
    return labels.join(_by_first_member(labels), "cluster").select("group", F.col("first").alias("cluster"))


@query(
    """
WITH counts AS (
  SELECT 'G' || o_custkey % 50 AS "group", count(DISTINCT o_orderkey) AS a, count(*) AS b
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL
), scaled AS (
  SELECT "group", a / stddev_pop(a) OVER () AS a, b / stddev_pop(b) OVER () AS b FROM counts
)
SELECT "group", round(abs(a + b) / sqrt(2), 5) AS x, round(abs(a - b) / sqrt(2), 5) AS y FROM scaled
"""
)
def projection_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two techniques that grow together: the components are their sum and difference."""
    group = F.concat(F.lit("G"), (F.col("o_custkey") % 50).cast("string")).alias("group")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", group)
    items = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    counts = items.groupBy("group").agg(
        F.count_distinct("o_orderkey").alias("T0"), F.count("*").alias("T1")
    ).unpivot(["group"], ["T0", "T1"], "technique_id", "count")
    vectors, _ = cluster.scaled_vectors(written(counts), "group")
    plane = cluster.project_2d(written(vectors), "group")
    return plane.select("group", F.round(F.abs("x"), 5).alias("x"), F.round(F.abs("y"), 5).alias("y"))


@query(PLANTED_SQL + f'SELECT DISTINCT "group", {KIND_SQL} AS kind FROM counts')
def layout_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted groups with the kind that most of their five nearest in the layout are of, the group itself among them."""
    vectors, _ = _planted_vectors(spark, sf_dir)
    plane = written(neighbours.spectral_layout(vectors, "group", neighbours=5))
    points = plane.select(F.col("group").alias("id"), F.array("x", "y").alias("vector"))
    near = neighbours.search(points, points, 5).nearest
    number = F.substring("neighbour", 2, 2).cast("int") % 3
    kinds = near.select(F.col("id").alias("group"), F.concat(F.lit("G"), F.lpad(number.cast("string"), 2, "0")).alias("kind"))
    return kinds.groupBy("group").agg(F.mode("kind").alias("kind"))


def _cluster_profile(spark: SparkSession, sf_dir: str) -> jobs.ClusterProfile:
    return jobs.cluster_profile(*_planted(spark, sf_dir))


KIND_COUNTS = f"""
, kinds AS (
  SELECT {KIND_SQL} AS cluster, technique_id, CAST(sum("count") AS BIGINT) AS "count" FROM counts GROUP BY ALL
)
"""


@query(
    PLANTED_SQL
    + KIND_COUNTS
    + """
SELECT cluster, technique_id, 'name ' || technique_id AS technique_name, "count",
  row_number() OVER (PARTITION BY cluster ORDER BY "count" DESC, technique_id) AS rank FROM kinds
"""
)
def cluster_profile_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top techniques of the cluster page's job over planted groups."""
    profile = _cluster_profile(spark, sf_dir)
    first = _by_first_member(profile.labels)
    return profile.top.join(first, "cluster").select(
        F.col("first").alias("cluster"), "technique_id", "technique_name", "count", F.col("rank").cast("long").alias("rank")
    )


@query(
    PLANTED_SQL
    + KIND_COUNTS
    + """
, top8 AS (SELECT technique_id FROM kinds GROUP BY ALL ORDER BY sum("count") DESC, technique_id LIMIT 8),
of AS (SELECT DISTINCT cluster FROM kinds JOIN top8 USING (technique_id))
SELECT of.cluster, t.technique_id, COALESCE(k."count", 0) AS "count"
FROM of CROSS JOIN top8 t LEFT JOIN kinds k ON k.cluster = of.cluster AND k.technique_id = t.technique_id
"""
)
def cluster_profile_radar(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = _cluster_profile(spark, sf_dir)
    first = _by_first_member(profile.labels)
    return profile.radar.join(first, "cluster").select(
        F.col("first").alias("cluster"), "technique_id", "count"
    )
