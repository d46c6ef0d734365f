import datetime as dt
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabloom import FormulaError, apply_features, bin_categorical, decompose_datetime, derive, ratio, validate_formula


def test_date_parts(spark):
    df = spark.createDataFrame([("2024-02-29",), ("junk",), (None,)], "d string")
    rows = [tuple(r)[1:] for r in decompose_datetime(df, "d").collect()]
    assert rows == [(2024, 2, 29, 3), (None,) * 4, (None,) * 4]
    typed = spark.createDataFrame([(dt.date(2023, 1, 2),)], "d date")
    assert decompose_datetime(typed, "d").first().d_weekday == 0  # a Monday


def test_ratio_at_zero(spark):
    df = spark.createDataFrame([(1, 2), (1, 0), (-1, 0), (0, 0), (None, 0)], "a int, b int")
    assert [r.r for r in ratio(df, "a", "b", "r").collect()] == [0.5, None, None, None, None]
    found = [r.r for r in ratio(df, "a", "b", "r", on_zero="ieee").collect()]
    assert found[:3] == [0.5, math.inf, -math.inf] and math.isnan(found[3]) and found[4] is None


def test_bins_with_nulls(spark):
    values = [None, "a", "a", "b", "c", "d"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    assert [r.v_binned for r in bin_categorical(df, "v", q=4).orderBy("i").collect()] == [0, 0, 0, 2, 3, 3]
    empty = spark.createDataFrame([(None,)], "v string")
    assert bin_categorical(empty, "v").first().v_binned is None


@pytest.mark.parametrize("limit", [5, 200_000])
def test_bins_of_many_values(spark, monkeypatch, limit):
    import tabloom.operators.features as features
    from tabloom.plans.ordered import running_sums

    monkeypatch.setattr(features, "running_sums", lambda *a: running_sums(*a, limit=limit))
    df = spark.range(1_000).selectExpr("id", "lpad(cast(id as string), 4, '0') as v")
    rows = bin_categorical(df, "v").orderBy("id").collect()
    assert [r.v_binned for r in rows] == [max(0, math.ceil(i / 99.9 - 1e-9) - 1) for i in range(1_000)]


@pytest.mark.parametrize(
    ("formula", "expected"),
    [("price / (sqft + 1)", 10.0), ("2", 2.0), ("-price + .5", -29.5), ("price * 2 - sqft", 58.0), ("price / 0", None), ("1 / 2", 0.5)],
)
def test_formulas(spark, formula, expected):
    df = spark.createDataFrame([(30.0, 2)], "price double, sqft int")
    assert derive(df, "n", formula).first().n == expected


@pytest.mark.parametrize(
    "formula",
    ["", "  ", None, "price.sqft", "open('x')", "price ** 2", "price // 2", "price > 1", "x if price else 1", "[1]", "price; sqft",
     "__import__", "f(price)", "lambda: 1", "price @ sqft", "True", "1j", "'a'", "price +", "unknown + 1", "~price", "price\n= 3"],
)
def test_unsafe_formulas(formula):
    with pytest.raises(FormulaError):
        validate_formula(formula, ["price", "sqft"])


NUMBERS = st.integers(0, 50).map(str) | st.sampled_from(["a", "b"])
FORMULAS = st.recursive(
    NUMBERS, lambda inner: st.tuples(inner, st.sampled_from("+-*/"), inner).map(lambda t: f"({t[0]} {t[1]} {t[2]})"), max_leaves=6
)


@settings(max_examples=15, deadline=None)
@given(formula=FORMULAS)
def test_formulas_agree_with_plain_arithmetic(spark, formula):
    try:
        expected = eval(formula, {"a": 3.0, "b": -7.0})
    except ZeroDivisionError:
        expected = None
    found = derive(spark.createDataFrame([(3.0, -7.0)], "a double, b double"), "n", formula).first().n
    assert found == (pytest.approx(expected) if expected is not None else None)


def test_selection_is_never_fatal(spark):
    df = spark.createDataFrame([(4.0, 2.0, "x")], "a double, b double, s string")
    suggestions = [
        {"name": "a_per_b", "type": "ratio", "columns": ["a", "b"]},
        {"name": "broken", "type": "ratio", "columns": ["a", "gone"]},
        {"name": "odd", "type": "fold", "columns": ["a"]},
    ]
    made, log, errors = apply_features(
        df, suggestions, ["a_per_b", "broken", "odd", "unknown"],
        [{"name": "c", "formula": "a_per_b * 2"}, {"name": "d", "formula": "c + 1"}, {"name": "a", "formula": "1"},
         {"formula": "1"}, {"name": "e", "formula": "s + 1"}],
    )
    assert made.first().asDict() == {"a": 4.0, "b": 2.0, "s": "x", "a_per_b": 2.0, "c": 4.0}
    assert [(entry[0], entry[1]) for entry in log] == [
        ("a_per_b", "create"), ("broken", "skip"), ("odd", "skip"), ("unknown", "skip"),
        ("c", "create"), ("d", "skip"), ("a", "skip"), ("?", "skip"), ("e", "skip"),
    ]
    assert [e[1] for e in errors] == ["custom_formula_rejected"]  # d uses an earlier custom column
