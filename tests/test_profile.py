import pytest

from tabloom.operators import profile as profile_module
from tabloom.operators.prepare import without_duplicates
from tabloom.plans import ordered
from tabloom import (
    categorical_profile,
    duplicate_count,
    high_missing,
    missing_profile,
    missing_total,
    numeric_profile,
    profile,
)


@pytest.fixture(scope="module")
def staff(spark):
    return spark.createDataFrame(
        [(25, 50000.0, "New York"), (30, 60000.0, "Chicago"), (35, 70000.0, "Boston"), (40, 80000.0, "New York")],
        "age bigint, salary double, city string",
    )


def by_column(df):
    return {r.column: r.asDict() for r in df.collect()}


def test_clean_table(staff):
    table, columns = profile(staff)
    assert table.first().asDict() == {"num_rows": 4, "num_cols": 3, "duplicate_count": 0}
    found = by_column(columns)
    assert found["age"]["mean"] == 32.5 and found["age"]["median"] == 32.5 and found["age"]["q25"] == 28.75
    assert found["city"]["unique_count"] == 3
    assert (found["city"]["top_value"], found["city"]["top_freq"]) == ("New York", 2)
    assert [found[c]["role"] for c in ("age", "salary", "city")] == ["numeric", "numeric", "categorical"]


def test_missing_shares_and_flag(spark):
    df = spark.createDataFrame(
        [(1, 1.0, None), (2, None, None), (3, float("nan"), None), (4, 4.0, "x")], "age int, salary double, code string"
    ).filter("age <> 3 or true")
    found = by_column(missing_profile(df))
    assert [found[c]["missing_pct"] for c in ("age", "salary", "code")] == [0.0, 50.0, 75.0]
    assert [r.column for r in high_missing(df).collect()] == ["code"]  # exactly half is not high
    assert missing_total(df).first().asDict() == pytest.approx(
        {"missing_cells": 5, "total_cells": 12, "missing_pct": 500 / 12}
    )


def test_duplicates_count_nulls_and_zeros_as_equal(spark):
    rows = [("a", None, 0.0), ("a", None, -0.0), ("a", None, 0.0), ("a", "b", 0.0), (None, "a", 0.0)]
    df = spark.createDataFrame(rows, "item string, other string, price double")
    assert duplicate_count(df).first()[0] == 2
    assert duplicate_count(df.filter("item = 'none'")).first()[0] == 0


def test_extreme_columns(spark):
    df = spark.createDataFrame(
        [(None, None, 2**60, True), (None, None, 2**60 + 1, None)], "n double, s string, big bigint, flag boolean"
    )
    numbers = by_column(numeric_profile(df))
    assert numbers["n"]["unique_count"] == 0 and numbers["n"]["median"] is None
    assert numbers["big"]["unique_count"] == 2
    classes = by_column(categorical_profile(df))
    assert classes["s"] == {"column": "s", "unique_count": 0, "top_value": None, "top_freq": None}
    assert classes["flag"]["top_value"] == "true"


def test_top_value_tie_goes_to_the_smaller(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",)], "v string")
    assert categorical_profile(df).first().top_value == "a"


def test_sketched_profile_is_close(spark):
    df = spark.range(20_000).selectExpr("id", "cast(id % 100 as double) as m")
    found = by_column(numeric_profile(df, exact=False))
    assert found["id"]["unique_count"] == pytest.approx(20_000, rel=0.05)
    assert found["id"]["median"] == pytest.approx(10_000, rel=0.02)
    assert found["m"]["unique_count"] == 100


def test_awkward_column_names(spark):
    df = spark.createDataFrame([(1.0, "x"), (2.0, "y")], "`a.b` double, `c ``d` string")
    _, columns = profile(df)
    assert by_column(columns)["a.b"]["mean"] == 1.5


def test_duplicates_do_not_shuffle_whole_rows_whatever_the_estimates(spark, monkeypatch):
    df = spark.range(2_000).selectExpr("id % 1990 as k", "cast(id % 1990 as string) as v")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = duplicate_count(df)
        assert "SortMergeJoin" not in few._jdf.queryExecution().toString()
        assert few.first()[0] == 10
        assert "Exchange" not in duplicate_count(df.distinct())._jdf.queryExecution().toString()
        monkeypatch.setattr("tabloom.operators.profile.BROADCAST_HASHES", 3)
        assert duplicate_count(df).first()[0] == 10
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_sketched_profile_is_checked_without_ordering_the_values(spark, monkeypatch):
    from tabloom.plans.registered import _near_exact

    def ordered(*args):
        raise AssertionError("no order of all values is needed")

    monkeypatch.setattr("tabloom.operators.profile.value_facts", ordered)
    df = spark.range(1_000).selectExpr("id as a", "if(id % 3 = 0, null, id % 7) as b", "cast(null as double) as c").drop("c")
    found = by_column(_near_exact(df, numeric_profile(df, exact=False)))
    assert all(found[c]["quartiles_near"] and found[c]["unique_near"] for c in "ab")
    for wrong in ("q25 + 11", "q25 - 11"):
        moved = numeric_profile(df, exact=False).selectExpr("* except (q25)", f"{wrong} as q25")
        assert not by_column(_near_exact(df, moved))["a"]["quartiles_near"]
    held = numeric_profile(df, exact=False).selectExpr("* except (q25)", "if(column = 'a', 240, q25) as q25")
    assert by_column(_near_exact(df, held))["a"]["quartiles_near"]
    more = numeric_profile(df, exact=False).selectExpr("* except (unique_count)", "unique_count * 2 + 2 as unique_count")
    assert not any(r["unique_near"] for r in by_column(_near_exact(df, more)).values())


def test_duplicates_in_rounds(spark, monkeypatch):
    rows = [(i % 40 if i % 7 else None, [0.0, -0.0, float("nan")][i % 3], f"t{i % 5}") for i in range(600)]
    df = spark.createDataFrame(rows, "`a.b` int, x double, t string")
    expected = df.count() - df.distinct().count()
    monkeypatch.setattr(ordered, "VALUES_AT_ONCE", 100)
    assert len(ordered.rounds("t", 600)) == 6
    assert profile_module.duplicate_count(df).first()[0] == expected
    monkeypatch.setattr(profile_module, "BROADCAST_HASHES", 0)
    assert profile_module.duplicate_count(df).first()[0] == expected
    distinct, removed = without_duplicates(df)
    assert (removed, distinct.count(), distinct.distinct().count()) == (expected, 600 - expected, 600 - expected)
    alone = spark.range(300).toDF("k")
    assert profile_module.duplicate_count(alone).first()[0] == 0 and without_duplicates(alone) == (alone, 0)
