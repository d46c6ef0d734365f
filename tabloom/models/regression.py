"""Regressors."""

from __future__ import annotations

from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.models.base import SEED, Fold, ModelSpec, sized
from tabloom.operators.neighbours import mean_label, nearest
from tabloom.session import settle


def _kept(predicted: DataFrame) -> DataFrame:
    return predicted.select("id", "label", "prediction")


def mean_baseline(fold: Fold):
    mean = fold.train.agg(F.avg("label")).first()[0]
    return fold.test.select("id", "label", F.lit(float(mean)).alias("prediction")), {}


def least_squares(fold: Fold):
    model = LinearRegression(solver=_solver(fold), regParam=0.0).fit(fold.train)
    return _kept(model.transform(fold.test)), {}


def _solver(fold: Fold) -> str:
    """The normal equations, which Spark offers up to 4096 columns; beyond it, iterations."""
    return "normal" if fold.width <= 4096 else "l-bfgs"


def ridge(fold: Fold):
    """Penalty alpha = 1 on the squared coefficients.

    Spark's loss is a mean and its penalty is divided by the label's deviation, which
    is the population one in the normal solver and the sample one otherwise.
    """
    spread = F.stddev_pop("label") if _solver(fold) == "normal" else F.stddev_samp("label")
    deviation = fold.train.agg(spread).first()[0] or 0.0
    model = LinearRegression(
        solver=_solver(fold), regParam=deviation / fold.n_train, elasticNetParam=0.0, standardization=False
    ).fit(fold.train)
    return _kept(model.transform(fold.test)), {}


def neighbours(fold: Fold):
    test = fold.numbered_test()
    found = mean_label(nearest(fold.train, "label", test, "id", ["x"], k=5))
    return test.select("id", "label").join(found.withColumnRenamed("qid", "id"), "id"), {}


def forest(fold: Fold):
    model = RandomForestRegressor(
        numTrees=100, maxDepth=10, seed=SEED, featureSubsetStrategy="all", maxMemoryInMB=1024, cacheNodeIds=True
    ).fit(fold.train)
    return _kept(model.transform(fold.test)), {}


def _merged(fold: Fold) -> DataFrame:
    """Training rows of equal features as one, with their mean label and their number as weight.

    The squared error of a split depends on the sums and numbers of labels on either side alone, and equal features stay on
    one side.  So boosting, which draws no rows, grows the trees that the single rows would give.
    """
    merged = settle(
        fold.train.groupBy("features").agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
    )
    return sized(merged, merged.count(), fold.width)


def _boosted(fold: Fold, depth: int) -> DataFrame:
    gbt = GBTRegressor(maxIter=100, maxDepth=depth, stepSize=0.1, seed=SEED, maxMemoryInMB=1024, weightCol="weight")
    return _kept(gbt.fit(_merged(fold)).transform(fold.test))


def boosted_shallow(fold: Fold):
    return _boosted(fold, 3), {}


def boosted_deeper(fold: Fold):
    return _boosted(fold, 4), {}


REGRESSION = (
    ModelSpec("mean_value", "baseline", {"strategy": "mean"}, mean_baseline),
    ModelSpec("linear_regression", "linear", {}, least_squares),
    ModelSpec("ridge_alpha1", "linear", {"alpha": "1"}, ridge),
    ModelSpec("nearest_neighbours_5", "instance", {"k": "5"}, neighbours),
    ModelSpec("random_forest_100", "tree", {"trees": "100", "max_depth": "10"}, forest),
    ModelSpec("gradient_boosting_100", "boosting", {"rounds": "100", "max_depth": "3", "rate": "0.1"}, boosted_shallow),
    ModelSpec("boosted_trees_100", "boosting", {"rounds": "100", "max_depth": "4", "rate": "0.1"}, boosted_deeper),
)
