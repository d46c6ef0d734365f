"""Clusterers: fitted on all rows, which they then label."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.models.base import SEED, Fold, ModelSpec
from tabloom.operators.density import dbscan
from tabloom.operators.linkage import MICRO_CLUSTERS, ward

STARTS = 10


def _labelled(predicted: DataFrame) -> DataFrame:
    return predicted.select("id", "x", F.col("prediction").cast("int").alias("prediction"))


def _kmeans(fold: Fold, k: int):
    """The best of ten seeded starts by within-cluster square sum."""
    target = inheritable_thread_target(fold.train.sparkSession)(
        lambda seed: KMeans(k=k, seed=seed, maxIter=300, tol=1e-4).fit(fold.train)
    )
    with ThreadPoolExecutor(4) as pool:
        models = list(pool.map(target, range(SEED, SEED + STARTS)))
    best = min(models, key=lambda m: m.summary.trainingCost)
    return _labelled(best.transform(fold.train)), {}


def kmeans_3(fold: Fold):
    return _kmeans(fold, 3)


def kmeans_5(fold: Fold):
    return _kmeans(fold, 5)


def mixture(fold: Fold):
    return _labelled(GaussianMixture(k=3, seed=SEED).fit(fold.train).transform(fold.train)), {}


def ward_3(fold: Fold):
    return _labelled(ward(fold.train.select("id", "x"), ["x"], k=3, label="prediction")), {}


def density(fold: Fold):
    return _labelled(dbscan(fold.train.select("id", "x"), ["x"], label="prediction")), {}


CLUSTERING = (
    ModelSpec("kmeans_3", "centroid", {"k": "3", "starts": "10"}, kmeans_3),
    ModelSpec("kmeans_5", "centroid", {"k": "5", "starts": "10"}, kmeans_5),
    ModelSpec("gaussian_mixture_3", "distribution", {"k": "3"}, mixture),
    ModelSpec("ward_3", "hierarchical", {"k": "3", "linkage": "ward", "centroids": str(MICRO_CLUSTERS)}, ward_3),
    ModelSpec("dbscan_0.5_5", "density", {"eps": "0.5", "min_points": "5"}, density),
)
