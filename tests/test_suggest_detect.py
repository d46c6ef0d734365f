import numpy as np
import pytest

from tabloom import (
    class_balance,
    correlation_pairs,
    detect_target,
    detect_task,
    feature_suggestions,
    is_imbalanced,
    resolve_column,
    suggest_binning,
    suggest_datetime,
)
from tabloom.operators.suggest import correlations


def names(df):
    return sorted(r.name for r in df.collect())


def test_nothing_to_suggest(spark):
    df = spark.createDataFrame([(1.0, "x"), (2.0, "y"), (3.0, "x")], "value double, cat string")
    assert feature_suggestions(df).count() == 0


@pytest.mark.parametrize(
    "values", [["2023-01-01", "2023-01-02"], ["01/02/2023", "25/12/2023"], ["Jan 5, 2023", "Feb 6, 2023"],
               ["2023-01-01 10:00:00", "2023-01-02T11:00:00Z"], ["2023-01-01", None]],
)
def test_date_texts(spark, values):
    df = spark.createDataFrame([(v, 1.0) for v in values], "day string, price double")
    assert names(suggest_datetime(df)) == ["day_decomposed"]


@pytest.mark.parametrize("values", [["2023-01-01", "soon"], ["a", "b"], [None, None], ["2023-13-45", "2023-01-01"], ["12", "13"]])
def test_texts_that_are_no_dates(spark, values):
    assert suggest_datetime(spark.createDataFrame([(v,) for v in values], "day string")).count() == 0


def test_late_counterexample_is_found(spark):
    df = spark.range(5_000).selectExpr("case when id = 4999 then 'never' else '2024-02-03' end as day")
    assert suggest_datetime(df).count() == 0


def test_correlation_equals_pairwise_complete_pearson(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(1e6, 5, 400)
    data = np.column_stack([x, 200 * x + rng.normal(0, 5, 400), rng.normal(size=400), np.full(400, 3.3)])
    data[::7, 1] = np.nan
    data[::5, 2] = np.nan
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in data]
    df = spark.createDataFrame(rows, "sqft double, price double, noise double, flat double")
    found = {(r.col_a, r.col_b): r.r for r in correlations(df).collect()}
    assert not any("flat" in pair for pair in found)
    for (i, a), (j, b) in (((0, "sqft"), (1, "price")), ((0, "sqft"), (2, "noise")), ((1, "price"), (2, "noise"))):
        both = ~np.isnan(data[:, i]) & ~np.isnan(data[:, j])
        assert found[a, b] == pytest.approx(np.corrcoef(data[both, i], data[both, j])[0, 1], abs=1e-9)
    assert names(correlation_pairs(df)) == ["sqft_per_price"]


def test_binning_from_ten_values_on(spark):
    df = spark.createDataFrame([(f"i{k}", f"j{k % 9}") for k in range(30)], "ten string, nine string")
    assert names(suggest_binning(df)) == ["ten_binned"]


def test_resolve_and_target(spark):
    df = spark.createDataFrame([(1, 0, 22.0)], "PassengerId int, Survived int, Age double")
    assert resolve_column(df, " survived ") == "Survived"
    assert resolve_column(df, "passenger") == "PassengerId"
    assert resolve_column(df, "the Age of it") == "Age"
    assert resolve_column(df, "zzz") is None and resolve_column(df, None) is None
    assert detect_target(df) == "Survived"
    assert detect_target(df, "Age") == "Age"
    assert detect_target(df.drop("Survived")) == "Age"
    assert detect_target(df, clustering=True) is None


@pytest.mark.parametrize(
    ("ddl", "values", "task", "confidence"),
    [
        ("string", ["A", "B"], "classification", 1.0),
        ("boolean", [True, False], "classification", 1.0),
        ("double", [1.5, 2.5, 3.0], "regression", 1.0),
        ("double", [0.0, 1.0, 1.0], "classification", 0.5),
        ("double", [float(i) for i in range(11)], "regression", 1.0),
        ("double", [None, None], "regression", 1.0),
        ("int", [0, 1, 1], "classification", 1.0),
        ("int", [0, 1, None], "classification", 0.5),  # gaps make it a float column
        ("int", [1, 2, 3, 4, 5], "classification", 0.5),
        ("int", list(range(10)), "classification", 0.5),
        ("int", list(range(11)), "regression", 0.95),
        ("bigint", list(range(5_000)), "regression", 0.95),
    ],
)
def test_task_rule(spark, ddl, values, task, confidence):
    row = detect_task(spark.createDataFrame([(v,) for v in values], f"t {ddl}"), "t").first()
    assert (row.task_type, row.confidence, row.needs_confirmation) == (task, confidence, confidence < 0.7)


def test_hint_and_override(spark):
    df = spark.createDataFrame([(i,) for i in range(5)], "t int")
    hinted = detect_task(df, "t", task_hint="regression").first()
    assert (hinted.task_type, hinted.confidence) == ("regression", 0.8)
    sure = detect_task(df, "t", override="regression").first()
    assert (sure.task_type, sure.confidence, sure.needs_confirmation) == ("regression", 1.0, False)
    assert detect_task(df, "absent").first().task_type == "clustering"
    with pytest.raises(ValueError):
        detect_task(df, "t", task_hint="ranking")


def test_balance_and_imbalance(spark):
    df = spark.createDataFrame([("a",)] * 19 + [("b",)] + [(None,)] * 3, "t string")
    rows = {r.label: r for r in class_balance(df, "t").collect()}
    assert rows["a"].share == 0.95 and rows["a"].is_majority and rows["b"].is_minority
    assert is_imbalanced(class_balance(df, "t")).first().imbalanced
    one = class_balance(df.filter("t = 'a'"), "t")
    assert one.count() == 0 and not is_imbalanced(one).first().imbalanced
