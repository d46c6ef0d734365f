"""Ward clusters of many rows through a bounded number of weighted centroids.

k-means on Spark replaces the points by at most ``limit`` centroids with sizes, and those
are merged; each row takes the cluster of its nearest centroid.  Where ``limit`` is not
less than the number of distinct points, every point is a centroid of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.columns import ref
from tabloom.operators.points import merged_points, point, squared_distances, stack

MICRO_CLUSTERS = 500


def ward_labels(centres: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Cluster number of each weighted centre after merging down to ``k`` clusters.

    Each step joins the pair whose union adds least to the within-cluster square sum.
    Numbers follow the first centre of each cluster.
    """
    member = np.arange(len(centres))
    mean, size = centres.astype(float).copy(), sizes.astype(float).copy()
    cost = squared_distances(mean, mean) * (size[:, None] * size[None, :]) / (size[:, None] + size[None, :])
    np.fill_diagonal(cost, np.inf)
    for _ in range(len(centres) - k):
        a, b = sorted(np.unravel_index(np.argmin(cost), cost.shape))
        mean[a] = (size[a] * mean[a] + size[b] * mean[b]) / (size[a] + size[b])
        size[a] += size[b]
        member[member == b] = a
        cost[b, :] = cost[:, b] = np.inf
        live = np.isfinite(cost[a])
        fresh = squared_distances(mean[live], mean[a:a + 1])[:, 0] * size[live] * size[a] / (size[live] + size[a])
        cost[a, live] = cost[live, a] = fresh
    _, numbers = np.unique(member, return_inverse=True)
    return numbers


def ward(
    df: DataFrame, features: list[str], k: int = 3, label: str = "cluster",
    limit: int = MICRO_CLUSTERS, seed: int = 42,
) -> DataFrame:
    """Add the Ward cluster number of each row."""
    points = merged_points(df, features)
    vectors = points.select(array_to_vector("x").alias("features"), F.col("w").cast("double"))
    model = KMeans(k=limit, seed=seed, weightCol="w", maxIter=20, tol=1e-3, initMode="random").fit(vectors)
    weights = model.transform(vectors).groupBy("prediction").agg(F.sum("w").alias("w")).collect()
    held = {r.prediction: r.w for r in weights}
    centres = np.array(model.clusterCenters())
    kept = sorted(held, key=lambda i: tuple(centres[i]))  # numbers follow the centroids' order, not the draw
    sizes = np.array([held[i] for i in kept])
    centres = centres[kept]
    if len(centres) < k:
        raise ValueError(f"{len(centres)} distinct points cannot form {k} clusters")
    numbers = ward_labels(centres, sizes, k).astype("int32")

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = stack(batch.pop("_x"))
            near = [squared_distances(x[i:i + 1024], centres).argmin(axis=1) for i in range(0, len(x), 1024)]
            yield batch.assign(**{label: numbers[np.concatenate(near)]})

    schema = T.StructType([*df.schema.fields, T.StructField(label, T.IntegerType())])
    return df.select(*map(ref, df.columns), point(df, features).alias("_x")).mapInPandas(assign, schema)
