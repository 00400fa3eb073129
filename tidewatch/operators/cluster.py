"""Grouping of keys by their technique counts: scaling, k-means, quality scores, projection."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators import aggregates, blocks, neighbours
from tidewatch.session import written

# Seed, largest k and fall-back k of the sweep (fixed values).
SEED = 42
MAX_K = 10
DEFAULT_K = 2

# Fits whose jobs may run at the same time.
FITS_AT_ONCE = 4


def _scales(counts: DataFrame, keys: int) -> DataFrame:
    """``technique_id, mean, scale`` over all ``keys`` keys, absent counts as 0; a constant has scale 1."""
    stats = counts.groupBy("technique_id").agg(
        F.sum("count").alias("_sum"),
        F.sum(F.col("count").cast("double") * F.col("count")).alias("_squares"),
        F.count("*").alias("_present"),
        F.min("count").alias("_least"),
        F.max("count").alias("_most"),
    )
    mean = F.col("_sum") / keys
    constant = (F.col("_present") == keys) & (F.col("_least") == F.col("_most"))
    scale = F.when(constant, 1.0).otherwise(F.sqrt(F.col("_squares") / keys - mean * mean))
    return stats.select("technique_id", mean.alias("mean"), scale.alias("scale"))


def standardize(counts: DataFrame, key: str) -> DataFrame:
    """``key, technique_id, z`` of every pair: zero mean, unit population variance per technique.

    ``counts`` are the positive counts (key, technique_id, count). A constant column keeps scale 1,
    so its values are 0.
    """
    scales = _scales(counts, counts.select(key).distinct().count())
    every = aggregates.zero_filled(counts, key)
    return every.join(scales, "technique_id").select(
        key, "technique_id", ((F.col("count") - F.col("mean")) / F.col("scale")).alias("z")
    )


def scaled_vectors(counts: DataFrame, key: str) -> tuple[DataFrame, int]:
    """``key, vector`` of the scaled matrix, one row per key, and the number of techniques.

    Counts are divided by their technique's deviation but not centred: distances, clusters and
    principal components do not change with the origin, and absent pairs stay 0.
    """
    order = Window.orderBy("technique_id")
    # One row per technique, numbered in one task.
    scales = _scales(counts, counts.select(key).distinct().count()).withColumn(
        "_at", F.row_number().over(order) - 1
    )
    scales = written(scales)
    dims = scales.count()
    found = (
        counts.join(scales, "technique_id")
        .groupBy(key)
        .agg(F.map_from_entries(F.collect_list(F.struct("_at", F.col("count") / F.col("scale")))).alias("_row"))
    )
    places = F.sequence(F.lit(0), F.lit(max(dims, 1) - 1))
    vector = F.transform(places, lambda i: F.coalesce(F.try_element_at("_row", i), F.lit(0.0)))
    return found.select(key, vector.alias("vector")), dims


def euclidean_silhouette(
    labelled: DataFrame, key: str, dims: int, broadcast_elements: int = blocks.BROADCAST_ELEMENTS,
    rows_per_block: int = blocks.ROWS_PER_BLOCK,
) -> DataFrame:
    """``key, silhouette`` of each row of ``key, vector, cluster``; alone in its cluster gives 0.

    Tasks return the sum of distances to each cluster, never the pairs.
    """
    id_type = dict(labelled.dtypes)[key]

    def sums(batch: pd.DataFrame, matrix: np.ndarray, info: pd.DataFrame) -> pd.DataFrame:
        distances = neighbours.euclidean(blocks.stack(batch["vector"]), matrix)
        labels = info["cluster"].to_numpy()
        parts = []
        for label in np.unique(labels):
            mine = labels == label
            parts.append(
                pd.DataFrame(
                    {
                        key: batch[key].to_numpy(),
                        "cluster": batch["cluster"].to_numpy(),
                        "other": label,
                        "total": distances[:, mine].sum(1),
                        "members": int(mine.sum()),
                    }
                )
            )
        return pd.concat(parts)

    found, _ = blocks.against_reference(
        labelled.select(key, "cluster", "vector"),
        labelled.select(F.col(key).alias("_member"), "cluster", "vector"),
        sums,
        f"{key} {id_type}, cluster int, other int, total double, members long",
        key,
        dims,
        broadcast_elements,
        rows_per_block,
    )
    per_cluster = found.groupBy(key, "cluster", "other").agg(
        F.sum("total").alias("total"), F.sum("members").alias("members")
    )
    own = F.col("cluster") == F.col("other")
    distances = per_cluster.groupBy(key, "cluster").agg(
        F.max(F.when(own, F.col("members"))).alias("size"),
        F.max(F.when(own & (F.col("members") > 1), F.col("total") / (F.col("members") - 1))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("members"))).alias("b"),
    )
    widest = F.greatest("a", "b")
    value = F.when(F.col("size") == 1, 0.0).when(widest == 0, 0.0).otherwise(
        (F.col("b") - F.col("a")) / widest
    )
    return distances.select(key, value.alias("silhouette"))


@dataclass(frozen=True)
class Sweep:
    """Score per k, and the model of the best one."""

    scores: tuple[tuple[int, float, float], ...]
    best_k: int
    model: KMeansModel


def fit_kmeans(vectors: DataFrame, k: int) -> KMeansModel:
    return KMeans(k=k, seed=SEED, featuresCol="features").fit(vectors)


def sweep_k(vectors: DataFrame, key: str, rows: int, dims: int, max_k: int = MAX_K) -> Sweep:
    """Fit k = 2 to ``min(max_k, rows - 1)``; the highest mean silhouette wins, the first on ties.

    ``vectors`` is read for each k, so pass a written or cached table. The fits
    do not depend on each other, so their jobs run side by side.
    """
    data = vectors.withColumn("features", array_to_vector("vector"))

    def fit(k: int) -> tuple[KMeansModel, float, float]:
        model = fit_kmeans(data, k)
        labelled = model.transform(data).select(key, "vector", F.col("prediction").alias("cluster"))
        score = euclidean_silhouette(labelled, key, dims).agg(F.avg("silhouette")).first()[0]
        return model, float(model.summary.trainingCost), -1.0 if score is None else float(score)

    ks = range(2, min(max_k, rows - 1) + 1)
    with ThreadPoolExecutor(max_workers=FITS_AT_ONCE) as pool:
        fits = dict(zip(ks, pool.map(fit, ks), strict=True))
    best_k, best_score = DEFAULT_K, -1.0
    for k, (_, _, score) in fits.items():
        if score > best_score:
            best_k, best_score = k, score
    model = fits[best_k][0] if best_k in fits else fit_kmeans(data, best_k)
    return Sweep(tuple((k, cost, score) for k, (_, cost, score) in fits.items()), best_k, model)


def assign(vectors: DataFrame, key: str, model: KMeansModel) -> DataFrame:
    data = vectors.withColumn("features", array_to_vector("vector"))
    return model.transform(data).select(key, F.col("prediction").alias("cluster"))


def project_2d(vectors: DataFrame, key: str) -> DataFrame:
    """Two plot coordinates per key: the first two principal components."""
    data = vectors.withColumn("features", array_to_vector("vector"))
    model = PCA(k=2, inputCol="features", outputCol="plane").fit(data)
    plane = vector_to_array("plane")
    return model.transform(data).select(key, plane[0].alias("x"), plane[1].alias("y"))
