import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom import (
    average_precision,
    balanced_weights,
    classification_metrics,
    cluster_counts,
    positive_weight,
    regression_metrics,
    split_features,
    train_test_split,
)


def sizes(df, by):
    return {(r[by], r.is_test): r["count"] for r in df.groupBy(by, "is_test").count().collect()}


@pytest.mark.parametrize("method", ["md5", "xxhash64"])
@pytest.mark.parametrize("limit", [1, 40, 500_000])
def test_exact_shares_whatever_the_limit(spark, method, limit):
    df = spark.range(1_003).selectExpr("id", "if(id % 3 = 0, 'a', 'b') as t", "nullif(id % 7, 0) as n")
    done = train_test_split(df, by="t", method=method, limit=limit)
    found = sizes(done, "t")
    assert found["a", True] == math.ceil(0.25 * 335) and found["b", True] == math.ceil(0.25 * 668)
    assert done.select("id").distinct().count() == 1_003
    again = train_test_split(df.repartition(5), by="t", method=method)
    assert done.select("id", "is_test").exceptAll(again.select("id", "is_test")).count() == 0


def test_copies_are_parted_exactly(spark, monkeypatch):
    import tabloom.operators.split as split

    monkeypatch.setattr(split, "_COPIES_PER_ROW", 7)
    copies = spark.range(300).selectExpr("'same' as v", "'a' as t")
    others = spark.range(40).selectExpr("concat('v', id) as v", "'b' as t")
    done = train_test_split(copies.unionByName(others), by="t", limit=3)
    assert sizes(done, "t") == {("a", True): 75, ("a", False): 225, ("b", True): 10, ("b", False): 30}


def test_seed_changes_the_rows(spark):
    df = spark.range(200)
    a, b = (train_test_split(df, seed=s).filter("is_test").select("id") for s in (1, 2))
    assert a.count() == b.count() == 50 and a.exceptAll(b).count() > 10


def test_single_member_class_turns_stratification_off(spark):
    df = spark.createDataFrame([(i, "a" if i else "lonely") for i in range(20)], "id int, t string")
    assert train_test_split(df, by="t").filter("is_test").count() == 5


def test_weights(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], "t string")
    assert {r.t: r.weight for r in balanced_weights(df, "t").collect()} == {"a": 4 / 6, "b": 2.0}
    assert positive_weight(df, "t").first()[0] == 3.0
    assert positive_weight(df.unionByName(spark.createDataFrame([("c",)], "t string")), "t").first()[0] is None
    assert split_features(df, "t") == ([], "t") and split_features(df, "zz") == (["t"], None)


def scores(spark, pairs, ddl="y int, p int"):
    return classification_metrics(spark.createDataFrame(pairs, ddl), "y", "p").first().asDict()


def test_two_classes_score_the_positive_one(spark):
    found = scores(spark, [(1, 1), (1, 0), (0, 1), (0, 0), (0, 0)])
    assert found == pytest.approx({"accuracy": 0.6, "f1": 0.5, "precision": 0.5, "recall": 0.5})
    assert scores(spark, [("yes", "yes"), ("no", "yes")], "y string, p string")["precision"] == 0.5
    assert scores(spark, [(2, 2), (3, 2)])["f1"] == 0.0  # the greater label is the positive one
    assert scores(spark, [(2, 2), (1, 2)])["recall"] == 0.0  # unless 1 occurs


def test_lone_label_and_nothing_predicted(spark):
    assert scores(spark, [(0, 0), (0, 0)]) == {"accuracy": 1.0, "f1": 0.0, "precision": 0.0, "recall": 0.0}
    assert scores(spark, [(1, 1)])["f1"] == 1.0
    assert scores(spark, [(1, 0), (0, 0)])["precision"] == 0.0


def test_three_classes_are_averaged(spark):
    found = scores(spark, [(0, 0), (1, 1), (1, 2), (2, 0)])
    assert found == pytest.approx({"accuracy": 0.5, "f1": (2 / 3 + 2 / 3 + 0) / 3, "precision": 0.5, "recall": 0.5})


def test_average_precision(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "y int, s double")
    assert average_precision(df, "y", "s").first()[0] == pytest.approx(0.8333333)
    ties = spark.createDataFrame([(1, 0.5), (0, 0.5), (0, 0.5), (1, 0.1)], "y int, s double")
    assert average_precision(ties, "y", "s").first()[0] == pytest.approx(0.5 * (1 / 3) + 0.5 * 0.5)
    assert math.isnan(average_precision(df.filter("y = 1"), "y", "s").first()[0])


def test_regression_scores(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 4.0)], "y double, p double")
    found = regression_metrics(df, "y", "p").first().asDict()
    assert found == pytest.approx({"rmse": math.sqrt(2 / 3), "mae": 2 / 3, "r2": 0.75})
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y double, p double")
    assert regression_metrics(flat, "y", "p").first().r2 == 1.0
    assert regression_metrics(flat.withColumn("p", F.lit(2.0)), "y", "p").first().r2 == 0.0


def test_cluster_counts(spark):
    df = spark.createDataFrame([(0,), (0,), (4,), (-1,), (-1,)], "c int")
    assert tuple(cluster_counts(df, "c").first()) == (2, 2)
