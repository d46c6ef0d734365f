import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.plans import ordered


def table(spark):
    rng = np.random.default_rng(1)
    n = 5_000
    ties = rng.integers(0, 3, n).astype(float)
    half = np.where(np.arange(n) % 3 == 0, 7.0, rng.normal(size=n))
    wild = rng.normal(size=n)
    wild[:40], wild[40:70] = np.inf, -np.inf
    rows = list(zip(rng.normal(size=n).tolist(), ties.tolist(), half.tolist(), wild.tolist()))
    return spark.createDataFrame(rows, "a double, ties double, half double, wild double"), np.array(rows)


def test_narrowing_equals_sorting(spark):
    df, values = table(spark)
    names, fractions = ["a", "ties", "half"], [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    counts = {n: len(values) for n in names}
    found = ordered.narrowed_quantiles(df, names, fractions, counts, limit=50)
    small = ordered.quantiles(df, names, fractions, counts)
    for i, name in enumerate(names):
        expected = np.quantile(values[:, i], fractions)
        assert found[name] == pytest.approx(expected, abs=1e-12)
        assert small[name] == pytest.approx(expected, abs=1e-12)


def test_infinities_do_not_stall_narrowing(spark):
    df, values = table(spark)
    ranks = [0, 29, 30, 2_500, 4_959, 4_960, 4_999]
    found = ordered.order_statistics(df, [F.col("wild")], [(0, k) for k in ranks], [len(values)], limit=20, accuracy=50)
    expected = np.sort(values[:, 3])
    assert [found[0, k] for k in ranks] == [expected[k] for k in ranks]


def test_empty_column_has_no_quantiles(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    assert ordered.quantiles(df, ["a", "b"], [0.5], {"a": 0, "b": 1}) == {"a": [None], "b": [1.0]}


@pytest.mark.parametrize("limit", [10, 10_000])
def test_running_sums_over_many_partitions(spark, limit):
    df = spark.range(1_000).select(((F.col("id") * 7919) % 1000).alias("k"), (F.col("id") % 5).alias("v"))
    rows = ordered.running_sums(df, [F.col("k").desc()], {"upto": "v"}, limit=limit).orderBy(F.col("k").desc()).collect()
    assert [r.upto for r in rows] == np.cumsum([r.v for r in rows]).tolist()
    assert len(rows) == 1_000


def test_value_facts_in_rounds_equal_those_at_once(spark, monkeypatch):
    df, _ = table(spark)
    df = df.selectExpr(
        "a", "ties", "half", "wild", "cast(a * 100 as bigint) AS whole", "cast(ties as decimal(9, 2)) AS money",
        "if(ties = 0, -0D, if(ties = 1, 0D, null)) AS zeros", "if(ties = 1, double('nan'), half) AS gaps", "cast(null as int) AS none",
    )
    counts = dict(zip(df.columns, df.agg(*[F.expr(f"count(nanvl({n}, null))") for n in df.columns]).first()))
    expected = ordered.value_facts(df, df.columns, [0.25, 0.5, 0.75], counts)
    monkeypatch.setattr(ordered, "VALUES_AT_ONCE", 700)
    monkeypatch.setattr(ordered, "SINGLE_TASK_ROWS", 50)
    found = ordered.value_facts(df, df.columns, [0.25, 0.5, 0.75], counts)
    for name in df.columns:
        assert found[name][1] == expected[name][1], name
        assert found[name][0] == pytest.approx(expected[name][0], abs=1e-12), name


def test_many_values_leave_no_written_table(spark, monkeypatch):
    df, values = table(spark)
    monkeypatch.setattr(ordered, "VALUES_AT_ONCE", 700, raising=False)

    def write(*args, **kwargs):
        raise AssertionError("no copy of the values is written")

    monkeypatch.setattr(ordered, "staged", write)
    facts = ordered.value_facts(df, ["a"], [0.5], {"a": len(values)})
    assert facts["a"] == ([pytest.approx(np.quantile(values[:, 0], 0.5))], len(values))
