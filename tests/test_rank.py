import math

import pytest

from tabloom import best_model, best_record, experiment_summary, failures, has_fatal, leaderboard, rank_results
from tabloom.operators.rank import ERROR_SCHEMA, RECORD_SCHEMA

NAN = float("nan")


def records(spark, *entries):
    rows = [
        (name, name, "f", {}, "t", ok, None if ok else "Boom", None if ok else "it broke", metrics, 1.5, 10, 5)
        for name, ok, metrics in entries
    ]
    return spark.createDataFrame(rows, RECORD_SCHEMA)


def order(df, task):
    return [r.model_name for r in rank_results(df, task).orderBy("rank").collect()]


def test_f1_beats_accuracy(spark):
    df = records(
        spark, ("A", True, {"accuracy": 0.95, "f1": 0.55}), ("B", True, {"accuracy": 0.92, "f1": 0.9}),
        ("C", True, {"accuracy": 0.78, "f1": 0.7}),
    )
    assert order(df, "classification") == ["B", "C", "A"]


def test_tiebreaks(spark):
    df = records(spark, ("A", True, {"f1": 0.8, "precision": 0.65}), ("B", True, {"f1": 0.8, "precision": 0.8}))
    assert order(df, "classification") == ["B", "A"]
    df = records(spark, ("A", True, {"r2": 0.8, "rmse": 2.0}), ("B", True, {"r2": 0.8, "rmse": 1.0}))
    assert order(df, "regression") == ["B", "A"]
    df = records(spark, ("b", True, {"f1": 0.8}), ("a", True, {"f1": 0.8}))
    assert order(df, "classification") == ["a", "b"]


def test_missing_values_last_and_failures_out(spark):
    df = records(
        spark, ("nan", True, {"silhouette": NAN}), ("ok", True, {"silhouette": -0.4}), ("none", True, {}),
        ("failed", False, {"silhouette": 1.0}),
    )
    assert order(df, "clustering") == ["ok", "nan", "none"]
    last = rank_results(df, "clustering").filter("rank = 2").first()
    assert last.primary_value == -math.inf and last.tiebreaker_value == -math.inf
    assert rank_results(records(spark, ("a", True, {"r2": NAN})), "regression").first().tiebreaker_value == math.inf


def test_winner_override_and_none(spark):
    df = records(spark, ("A", True, {"f1": 0.5}), ("B", True, {"f1": 0.9}))
    ranking = rank_results(df, "classification")
    assert tuple(best_model(ranking).first()) == ("B", False)
    assert tuple(best_model(ranking, "A").first()) == ("A", True)
    assert tuple(best_model(ranking, "B").first()) == ("B", False)
    failed = rank_results(records(spark, ("A", False, {}), ("B", False, {})), "regression")
    assert tuple(best_model(failed).first()) == ("none", False)
    assert tuple(best_model(failed, "A").first()) == ("A", True)
    assert best_record(df, "B").first().metrics == {"f1": 0.9}


def test_summary_leaderboard_failures(spark):
    df = records(spark, ("A", True, {"r2": 0.5, "rmse": 2.0}), ("B", False, {}), ("C", True, {"r2": 0.7, "mae": 1.0}))
    assert tuple(experiment_summary(df).first()) == (3, 2, 1, 4.5)
    board = leaderboard(df, "regression", 1).collect()
    assert [(r.model_name, r.r2, r.rmse, r.mae) for r in board] == [("C", 0.7, None, 1.0)]
    assert [tuple(r) for r in failures(df).collect()] == [("B", "Boom", "it broke")]
    with pytest.raises(ValueError):
        rank_results(df, "sorting")


def test_fatal_errors(spark):
    log = [("profile", "high_missing_values", "m", True)]
    assert not has_fatal(spark.createDataFrame(log, ERROR_SCHEMA))
    assert has_fatal(spark.createDataFrame([*log, ("x", "y", "z", False)], ERROR_SCHEMA))
