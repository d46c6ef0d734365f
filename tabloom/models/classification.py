"""Classifiers.  Labels are class numbers 0 .. k-1 in sorted class order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.columns import number_sql
from tabloom.models.base import SEED, Fold, ModelSpec
from tabloom.operators.neighbours import nearest, vote

#: Features up to which the curvature of two classes' loss, their square, is summed over rows that are not held.
CURVED_FEATURES = 200
#: Newton steps and halvings of them; loss a row that a further step could still save, below which none is taken.
NEWTON_STEPS, NEWTON_GAIN = 100, 1e-14
#: Random features standing in for the RBF kernel.
KERNEL_FEATURES = 200


def _weighted(fold: Fold, weights: list[float]) -> DataFrame:
    """Training rows with a weight per class; the lookup has one entry per class."""
    lookup = F.array(*[F.lit(float(w)) for w in weights])
    return fold.train.withColumn("weight", F.get(lookup, F.col("label").cast("int")))


def _balanced(fold: Fold) -> list[float]:
    total, classes = sum(fold.class_rows), sum(1 for n in fold.class_rows if n)
    return [total / (classes * n) if n else 0.0 for n in fold.class_rows]


def _scored(fold: Fold, predicted: DataFrame, column: str) -> DataFrame:
    kept = predicted.select("id", "label", "prediction", *([column] if len(fold.classes) == 2 else []))
    if len(fold.classes) != 2:
        return kept
    return kept.withColumn("score", F.get(vector_to_array(column), F.lit(1))).drop(column)


def majority(fold: Fold):
    """Most frequent training class, the smaller one on a tie."""
    best = float(np.argmax(fold.class_rows))
    out = fold.test.select("id", "label", F.lit(best).alias("prediction"))
    return (out.withColumn("score", F.lit(best)) if len(fold.classes) == 2 else out), {}


def logistic(fold: Fold):
    """L2-penalized logistic regression with C = 1 and balanced weights.

    Spark divides the loss by the weight sum, which balancing leaves at n.  It also keeps a copy of all rows for its
    many passes, so rows that are not held go through few passes of Newton's method to the same least loss.
    """
    if not fold.held and len(fold.classes) == 2 and fold.width <= CURVED_FEATURES and all(fold.class_rows):
        return _logistic_predicted(fold, _newton(fold, _balanced(fold))), {}
    model = LogisticRegression(
        maxIter=1000, regParam=1.0 / fold.n_train, elasticNetParam=0.0, standardization=False, weightCol="weight"
    ).fit(_weighted(fold, _balanced(fold)))
    return _scored(fold, model.transform(fold.test), "probability"), {}


def _curvature(batches: Iterator[pd.DataFrame], beta: np.ndarray, weights: list[float]) -> Iterator[pd.DataFrame]:
    """Weighted loss, its gradient and its second derivatives over the rows of a partition, summed; the intercept comes last."""
    size, by_class = len(beta), np.array(weights)
    loss, slope, bend = 0.0, np.zeros(size), np.zeros((size, size))
    for batch in batches:
        whole = batch.to_numpy(dtype=float)
        y, x = whole[:, 0], np.column_stack([whole[:, 1:], np.ones(len(whole))])
        weight, z = by_class[y.astype(int)], x @ beta
        p = np.exp(-np.logaddexp(0.0, -z))
        loss += float(weight @ (np.logaddexp(0.0, z) - y * z))
        slope += x.T @ (weight * (p - y))
        bend += x.T @ (x * (weight * p * (1 - p))[:, None])
    yield pd.DataFrame({"sums": [np.concatenate([[loss], slope, bend.ravel()])]})


def _newton(fold: Fold, weights: list[float]) -> np.ndarray:
    """Coefficients and intercept of the least penalized loss; a pass over all training rows a step."""
    size, n = fold.width + 1, fold.n_train
    rows = fold.train.select("label", *[F.col("x")[i].alias(f"x{i}") for i in range(fold.width)])
    ridge = np.append(np.ones(fold.width), 0.0)

    def at(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        parts = rows.mapInPandas(lambda batches: _curvature(batches, beta, weights), "sums array<double>").collect()
        sums = np.sum([r.sums for r in parts], axis=0) / n
        loss = sums[0] + (ridge * beta * beta).sum() / (2 * n)
        slope = sums[1 : size + 1] + ridge * beta / n
        return loss, slope, sums[size + 1 :].reshape(size, size) + np.diag(ridge) / n

    beta = np.zeros(size)
    loss, slope, bend = at(beta)
    for _ in range(NEWTON_STEPS):
        step = np.linalg.lstsq(bend, slope, rcond=None)[0]
        if slope @ step / 2 <= NEWTON_GAIN:
            break
        for _ in range(NEWTON_STEPS):
            found = at(beta - step)
            if found[0] <= loss or slope @ step / 2 <= NEWTON_GAIN:
                break
            step = step / 2
        if found[0] > loss:
            break
        beta, (loss, slope, bend) = beta - step, found
    return beta


def _logistic_predicted(fold: Fold, beta: np.ndarray) -> DataFrame:
    terms = [f"{number_sql(b)} * x[{i}]" for i, b in enumerate(beta[:-1])]
    score = f"1 / (1 + exp(-({' + '.join([*terms, number_sql(beta[-1])])})))"
    scored = fold.test.select("id", "label", F.expr(score).alias("score"))
    return scored.select("id", "label", (F.col("score") > 0.5).cast("double").alias("prediction"), "score")


def neighbours(fold: Fold):
    test = fold.numbered_test()
    found = vote(nearest(fold.train, "label", test, "id", ["x"], k=5))
    out = test.select("id", "label").join(found.withColumnRenamed("qid", "id"), "id")
    return (out if len(fold.classes) == 2 else out.drop("score")), {}


def forest(fold: Fold):
    model = RandomForestClassifier(
        numTrees=100, maxDepth=10, seed=SEED, weightCol="weight", featureSubsetStrategy="sqrt",
        maxMemoryInMB=1024, cacheNodeIds=True,
    ).fit(_weighted(fold, _balanced(fold)))
    return _scored(fold, model.transform(fold.test), "probability"), {}


def _boosted(fold: Fold, depth: int, weights: list[float] | None):
    gbt = GBTClassifier(maxIter=100, maxDepth=depth, stepSize=0.1, seed=SEED, maxMemoryInMB=1024)
    train = fold.train
    if weights:
        train = _weighted(fold, weights)
        gbt = gbt.setWeightCol("weight")
    if len(fold.classes) > 2:
        model = OneVsRest(classifier=gbt, parallelism=2).fit(train)
        return _scored(fold, model.transform(fold.test), "rawPrediction")
    return _scored(fold, gbt.fit(train).transform(fold.test), "probability")


def boosted_shallow(fold: Fold):
    return _boosted(fold, 3, None), {}


def boosted_weighted(fold: Fold):
    """Deeper trees; with two classes the second one weighs majority / minority."""
    if len(fold.classes) != 2 or min(fold.class_rows) == 0:
        return _boosted(fold, 4, None), {}
    weight = max(fold.class_rows) / min(fold.class_rows)
    return _boosted(fold, 4, [1.0, weight]), {"scale_pos_weight": str(round(weight, 4))}


def _kernel_map(df: DataFrame, width: int, gamma: float) -> DataFrame:
    """Replace ``features`` by random Fourier features of the RBF kernel (Rahimi and Recht, 2007)."""
    rng = np.random.default_rng(SEED)
    directions = rng.normal(0.0, np.sqrt(2.0 * gamma), (width, KERNEL_FEATURES))
    shifts = rng.uniform(0.0, 2.0 * np.pi, KERNEL_FEATURES)

    def lift(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            mapped = np.cos(np.stack(batch.pop("x")) @ directions + shifts) * np.sqrt(2.0 / KERNEL_FEATURES)
            yield batch.assign(x=list(mapped))

    slim = df.drop("features").select(*[c for c in df.columns if c not in ("x", "features")], "x")
    schema = T.StructType([*slim.drop("x").schema.fields, T.StructField("x", T.ArrayType(T.DoubleType()))])
    return slim.mapInPandas(lift, schema).withColumn("features", array_to_vector("x"))


def kernel_svm(fold: Fold):
    """RBF support vectors by random features: gamma 1 / (width * variance), C = 1, balanced."""
    moments = fold.train.select(F.explode("x").alias("v")).agg(F.var_pop("v")).first()[0] or 1.0
    gamma = 1.0 / (fold.width * moments)
    train = _kernel_map(_weighted(fold, _balanced(fold)), fold.width, gamma).persist()
    try:
        svm = LinearSVC(regParam=1.0 / fold.n_train, maxIter=100, standardization=False, weightCol="weight")
        if len(fold.classes) > 2:
            model = OneVsRest(classifier=svm, weightCol="weight", parallelism=2).fit(train)
        else:
            model = svm.fit(train)
    finally:
        train.unpersist()
    lifted = _kernel_map(fold.test, fold.width, gamma)
    return _scored(fold, model.transform(lifted), "rawPrediction"), {"gamma": f"{gamma:.6g}"}


CLASSIFICATION = (
    ModelSpec("majority_class", "baseline", {"strategy": "most_frequent"}, majority),
    ModelSpec("logistic_regression", "linear", {"max_iter": "1000", "C": "1", "class_weight": "balanced"}, logistic),
    ModelSpec("nearest_neighbours_5", "instance", {"k": "5"}, neighbours),
    ModelSpec("random_forest_100", "tree", {"trees": "100", "max_depth": "10", "class_weight": "balanced"}, forest),
    ModelSpec("gradient_boosting_100", "boosting", {"rounds": "100", "max_depth": "3", "rate": "0.1"}, boosted_shallow),
    ModelSpec("kernel_svm_rbf", "svm", {"kernel": "rbf", "C": "1", "class_weight": "balanced"}, kernel_svm),
    ModelSpec("boosted_trees_100", "boosting", {"rounds": "100", "max_depth": "4", "rate": "0.1"}, boosted_weighted),
)
