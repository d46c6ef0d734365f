"""Scores of predictions, each a one-row DataFrame from one or two aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import ref, share
from tabloom.plans.ordered import running_sums

NAN = float("nan")


def _class_scores(df: DataFrame, label: str, pred: str) -> DataFrame:
    """(cls, hits, actual, predicted) for each label that is true or predicted somewhere."""
    cells = df.groupBy(ref(label).alias("y"), ref(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("y").alias("cls"), hit.cast("bigint").alias("hits"), F.col("n").alias("actual"), zero.alias("predicted")),
        F.struct(F.col("p").alias("cls"), zero.alias("hits"), zero.alias("actual"), F.col("n").alias("predicted")),
    )
    return (
        cells.select(F.explode(sides).alias("s")).select("s.*")
        .groupBy("cls")
        .agg(*[F.sum(c).alias(c) for c in ("hits", "actual", "predicted")])
    )


def classification_metrics(
    df: DataFrame, label: str, pred: str, score: str | None = None, positive=None, one: float | None = 1.0
) -> DataFrame:
    """Accuracy, F1, precision, recall and, with a ``score`` column, average precision.

    Up to two labels: scores of the positive one (``one`` if it occurs, else the greater of
    two).  More labels: the plain mean over labels.  0/0 counts as 0.  Where numbers stand for
    the labels, ``one`` is the number of the label 1, or None if no label is 1.
    """
    zero = F.lit(0.0)
    precision = F.coalesce(share(F.col("hits"), F.col("predicted")), zero)
    recall = F.coalesce(share(F.col("hits"), F.col("actual")), zero)
    f1 = F.coalesce(share(2 * F.col("hits"), F.col("actual") + F.col("predicted")), zero)
    per_class = _class_scores(df, label, pred).select(
        "cls", "hits", "actual", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
        (F.col("cls").cast("string").try_cast("double") == F.lit(one).cast("double")).alias("is_one"),
    )
    # Two labels at most: 1 beats others, then the greater; a lone label has to be 1.
    rank = F.struct(F.coalesce(F.col("is_one"), F.lit(False)), F.col("cls"))
    labels = F.count(F.lit(1))
    lone_other = (labels == 1) & ~F.max(F.coalesce(F.col("is_one"), F.lit(False)))

    def averaged(name: str) -> Column:
        binary = F.when(lone_other, zero).otherwise(F.max_by(F.col(name), rank))
        return F.when(labels > 2, F.avg(name)).otherwise(binary).alias(name)

    result = per_class.agg(
        F.coalesce(share(F.sum("hits"), F.sum("actual")), F.lit(NAN)).alias("accuracy"),
        averaged("f1"), averaged("precision"), averaged("recall"),
    )
    if score is None:
        return result
    ap = average_precision(df, label, score, positive).first()[0]
    return result.withColumn("pr_auc", F.lit(ap))


def average_precision(df: DataFrame, label: str, score: str, positive=None) -> DataFrame:
    """One row ``pr_auc``: sum of recall steps times precision over falling scores.

    Rows are first counted per score, so ties are one step and the ordered part has
    one row per distinct score.  NaN unless exactly two labels occur; ``positive``
    is the greater one by default.
    """
    labels = [r[0] for r in df.select(ref(label)).filter(ref(label).isNotNull()).distinct().limit(3).collect()]
    if len(labels) != 2:
        return df.sparkSession.createDataFrame([(NAN,)], "pr_auc double")
    positive = max(labels) if positive is None else positive
    steps = df.groupBy(ref(score).cast("double").alias("score")).agg(
        F.count_if(ref(label) == F.lit(positive)).alias("hits"), F.count(F.lit(1)).alias("rows")
    )
    curve = running_sums(steps, [F.col("score").desc()], {"hits_upto": "hits", "rows_upto": "rows"})
    area = F.sum(F.col("hits") * share(F.col("hits_upto"), F.col("rows_upto")))
    return curve.agg(F.coalesce(share(area, F.sum("hits")), F.lit(NAN)).alias("pr_auc"))


def regression_metrics(df: DataFrame, label: str, pred: str) -> DataFrame:
    """RMSE, MAE and R squared; a constant label scores 1 if met exactly, else 0."""
    y, p = ref(label).cast("double"), ref(pred).cast("double")
    facts = df.agg(
        F.avg((y - p) * (y - p)).alias("mse"), F.avg(F.abs(y - p)).alias("mae"), F.var_pop(y).alias("var")
    )
    r2 = F.when(F.col("var") == 0, F.when(F.col("mse") == 0, 1.0).otherwise(0.0)).otherwise(
        1 - F.try_divide(F.col("mse"), F.col("var"))
    )
    return facts.select(F.sqrt("mse").alias("rmse"), "mae", r2.alias("r2"))


def cluster_counts(df: DataFrame, label: str) -> DataFrame:
    """Number of clusters without the noise label -1, and number of noise rows."""
    return (
        df.groupBy(ref(label).alias("c"))
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.count_if(F.col("c") != -1).alias("n_clusters"),
            F.coalesce(F.sum(F.when(F.col("c") == -1, F.col("n"))), F.lit(0)).alias("n_noise"),
        )
    )
