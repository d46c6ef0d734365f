"""Silhouette score with Euclidean distances.

The exact score needs every distance.  Points are cut into blocks, each pair of
blocks is one group of bounded size, worked off in tiles of ``block`` points a side, and
a group hands on only the distance sums per point and cluster, never the pairs.  Work grows with the square of the
distinct points; ``method="squared"`` is the linear alternative with squared
distances.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import ref, share
from tabloom.operators.points import BLOCK, chunk_of, merged_points, point, renewed, squared_distances, stack

#: Blocks that are enough to keep a cluster busy, and the points and distance sums that a block may hold beyond them.
MOST_BLOCKS = 32
LARGEST_BLOCK = 8_192
SUMS_OF_BLOCK = 4_000_000
#: Up to so many features differences are as fast; below this share of the squared lengths they are needed.
FEW_FEATURES = 8
CLOSE = 1e-5

_SUMS = "id bigint, cluster bigint, total double"


def _sums(ids: pd.Series, totals: np.ndarray, names: np.ndarray, there: np.ndarray) -> pd.DataFrame:
    """One row per point and cluster that is ``there`` on the other side."""
    held = np.unique(there)
    return pd.DataFrame(
        {"id": np.repeat(ids.to_numpy(), len(held)), "cluster": np.tile(names[held], len(ids)), "total": totals[:, held].ravel()}
    )


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances: by matrix product, but by differences where the product's cancellation would show."""
    if a.shape[1] <= FEW_FEATURES:
        return np.sqrt(squared_distances(a, b))
    sizes = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :]
    square = sizes - 2.0 * (a @ b.T)
    i, j = np.nonzero(~(square > CLOSE * sizes))
    if len(i) > 4 * len(a):
        return np.sqrt(squared_distances(a, b))
    square[i, j] = ((a[i] - b[j]) ** 2).sum(1)
    return np.sqrt(square)


def _block_pair(tile: int):
    """Weighted distance sums of each point to every cluster of the other block, by matrices of ``tile`` points a side."""
    def work(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"id": [], "cluster": [], "total": []})
        names, at = np.unique(np.concatenate([left["cluster"], right["cluster"]]), return_inverse=True)
        points, own, weights, totals = [], [], [], []
        for side, place in ((left, at[: len(left)]), (right, at[len(left):])):
            weight = np.zeros((len(side), len(names)))
            weight[np.arange(len(side)), place] = side["w"]
            points.append(stack(side["x"]))
            own.append(place)
            weights.append(weight)
            totals.append(np.zeros((len(side), len(names))))
        both = key[0] != key[1]  # a block with itself already holds both directions
        for i in range(0, len(left), tile):
            for j in range(0, len(right), tile):
                a, b = slice(i, i + tile), slice(j, j + tile)
                distances = _distances(points[0][a], points[1][b])
                totals[0][a] += distances @ weights[1][b]
                if both:
                    totals[1][b] += distances.T @ weights[0][a]
        sides = [_sums(left["id"], totals[0], names, own[1])]
        if both:
            sides.append(_sums(right["id"], totals[1], names, own[0]))
        return pd.concat(sides)

    return work


def silhouette(
    df: DataFrame, features: list[str], label: str, method: str = "exact", block: int = BLOCK
) -> DataFrame:
    """One row ``silhouette``: the mean over all rows; NaN unless 2 <= clusters < rows.

    Rows labelled -1 (noise) are not counted as a cluster for that condition, but
    once it holds they are a group like any other.
    """
    spark = df.sparkSession
    sizes = df.groupBy(ref(label).cast("bigint").alias("cluster")).agg(F.count(F.lit(1)).alias("size"))
    facts = sizes.agg(F.count_if(F.col("cluster") != -1).alias("k"), F.sum("size").alias("n")).first()
    if not 2 <= facts.k < (facts.n or 0):
        return spark.createDataFrame([(float("nan"),)], "silhouette double")
    if method == "squared":
        rows = df.select(array_to_vector(point(df, features)).alias("features"), ref(label).cast("double").alias("prediction"))
        return spark.createDataFrame([(float(ClusteringEvaluator().evaluate(rows)),)], "silhouette double")
    if method != "exact":
        raise ValueError(f"unknown method {method!r}: use 'exact' or 'squared'")

    points = merged_points(df, features, ref(label).cast("bigint")).withColumnRenamed("k0", "cluster")
    n = points.count()
    # A point is sent to every block, so blocks become no more than MOST_BLOCKS until they are as large as a task can hold.
    largest = max(block, min(LARGEST_BLOCK, SUMS_OF_BLOCK // max(1, sizes.count())))
    blocks = max(1, min(math.ceil(n / block), max(MOST_BLOCKS, math.ceil(n / largest))))
    placed = points.withColumn("b", chunk_of(F.col("id"), F.lit(blocks)))
    # A point meets the blocks from its own one on as left side, those up to it as right side.
    left = placed.withColumns({"i": F.col("b"), "j": F.explode(F.sequence(F.col("b"), F.lit(blocks - 1)))})
    right = placed.withColumns({"j": F.col("b"), "i": F.explode(F.sequence(F.lit(0), F.col("b")))})
    sums = left.groupBy("i", "j").cogroup(renewed(right).groupBy("i", "j")).applyInPandas(_block_pair(block), _SUMS)
    totals = sums.groupBy("id", "cluster").agg(F.sum("total").alias("total"))

    own = points.select("id", "w", F.col("cluster").alias("own"))
    means = (
        totals.join(sizes, "cluster")
        .join(own, "id")
        .groupBy("id", "w")
        .agg(
            F.max(F.when(F.col("cluster") == F.col("own"), F.col("size"))).alias("own_size"),
            F.max(F.when(F.col("cluster") == F.col("own"), share(F.col("total"), F.col("size") - 1))).alias("a"),
            F.min(F.when(F.col("cluster") != F.col("own"), share(F.col("total"), F.col("size")))).alias("b"),
        )
    )
    s = F.when(F.col("own_size") <= 1, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    )
    return means.agg(share(F.sum(s * F.col("w")), F.sum("w")).alias("silhouette"))
