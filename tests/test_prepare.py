import numpy as np
import pytest

from tabloom import impute_mode, one_hot, preprocess, reduce_dims, standard_scale
from tabloom.operators.prepare import NoFeaturesLeft
from tabloom.operators.gram import pair_sums
from tabloom.operators.prepare import PLAN_COLUMNS
from tabloom.operators import reduce
from tabloom.operators.reduce import component_count, fit_axes


def operations(prepared):
    return {(r.column, r.operation) for r in prepared.log.collect()}


def test_mixed_table(spark):
    df = spark.createDataFrame(
        [(25, "NY", 1.0), (None, "LA", 2.0), (35, None, 3.0), (40, "NY", 4.0)], "age int, city string, target double"
    )
    prepared = preprocess(df, "target", "regression")
    assert prepared.df.columns == ["age", "city_LA", "city_NY", "target"]
    rows = {r.target: r for r in prepared.df.collect()}
    assert rows[3.0].city_NY == 1.0  # the mode
    ages = np.array([25, 35, 35, 40.0])
    assert [rows[t].age for t in (1.0, 2.0, 3.0, 4.0)] == pytest.approx(((ages - ages.mean()) / ages.std()).tolist())
    assert {("age", "impute"), ("age", "scale"), ("city", "impute"), ("city", "onehot_encode")} <= operations(prepared)


def test_fitted_model_works_on_new_rows(spark):
    df = spark.createDataFrame([(1.0, "x", 0), (3.0, "y", 1)], "a double, s string, t int")
    model = preprocess(df, "t").model
    fresh = spark.createDataFrame([(None, "never seen"), (5.0, None)], "a double, s string")
    assert [tuple(r) for r in model.transform(fresh).collect()] == [(0.0, 0.0, 0.0), (3.0, 1.0, 0.0)]


def test_statistics_from_other_rows(spark):
    df = spark.createDataFrame([(float(i), i % 2) for i in range(10)], "a double, t int")
    train = df.filter("a < 4")
    assert preprocess(df, "t", fit_on=train).model.numeric[0].mean == 1.5


def test_drops(spark):
    rows = [(f"id{i}", f"text {i}", None, None, float(i), i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, "id string, note string, void string, hole double, x double, target int")
    prepared = preprocess(df, "target")
    assert prepared.feature_cols == ["x"]
    assert {(c, "drop") for c in ("id", "note", "void", "hole")} <= operations(prepared)
    assert sorted(e[1] for e in prepared.errors) == ["column_all_missing"] * 2 + ["column_dropped"] * 2


def test_many_levels_stay_if_they_repeat(spark):
    df = spark.createDataFrame([(f"v{i % 25}", i) for i in range(100)], "s string, target int")
    assert len(preprocess(df, "target").feature_cols) == 25


def test_no_features_left(spark):
    with pytest.raises(NoFeaturesLeft):
        preprocess(spark.createDataFrame([(1,), (2,)], "target int"), "target")


def test_duplicates_constant_and_missing_target(spark):
    df = spark.createDataFrame([(1.0, 5.0, "a"), (1.0, 5.0, "a"), (2.0, 5.0, None)], "x double, k double, t string")
    prepared = preprocess(df, "t")
    assert prepared.df.count() == 2
    assert {("dataset", "deduplication"), ("t", "target_missing")} <= operations(prepared)
    assert {r.k for r in prepared.df.collect()} == {0.0}


def test_scale_keeps_gaps_and_one_hot_gives_none_a_zero(spark):
    df = spark.createDataFrame([(1.0, "b"), (None, None), (3.0, "a")], "x double, s string")
    assert [r.x for r in standard_scale(df, ["x"]).collect()] == [-1.0, None, 1.0]
    assert [tuple(r) for r in one_hot(df, ["s"]).select("s_a", "s_b").collect()] == [(0, 1), (0, 0), (1, 0)]


def test_mode_tie_and_boolean(spark):
    df = spark.createDataFrame([("b", True), ("a", None), (None, True)], "s string, f boolean")
    assert sorted(r.s for r in impute_mode(df).collect()) == ["a", "a", "b"]
    assert all(r.f is True for r in impute_mode(df).collect())


def wide(spark, rows=60, columns=80):
    rng = np.random.default_rng(5)
    values = rng.normal(size=(rows, columns))
    df = spark.createDataFrame([tuple(r) for r in values.tolist()], ", ".join(f"f{i} double" for i in range(columns)))
    return df, values


def test_reduction_widths(spark):
    df, _ = wide(spark)
    assert len(preprocess(df, task="clustering").feature_cols) == 50
    assert preprocess(df, task="clustering", components=5).df.columns == [f"pc_{k}" for k in range(1, 6)]
    assert len(preprocess(df, task="clustering", reduction="off").feature_cols) == 80
    assert len(preprocess(df.withColumnRenamed("f0", "t"), "t", "regression").feature_cols) == 79
    one = spark.createDataFrame([(float(i),) for i in range(20)], "only double")
    assert preprocess(one, task="clustering").feature_cols == ["only"]


@pytest.mark.parametrize("method", ["svd", "pca"])
def test_components_equal_numpy(spark, method):
    df, values = wide(spark, 40, 6)
    values = values - values.mean(axis=0) if method == "pca" else values
    u, s, _ = np.linalg.svd(values, full_matrices=False)
    expected = np.abs(u * s)[:, :4]
    found = np.abs(np.array([tuple(r) for r in reduce_dims(df, df.columns, method, 4).collect()]))
    assert found[np.argsort(found[:, 0])] == pytest.approx(expected[np.argsort(expected[:, 0])], abs=1e-8)


def test_component_count_rule():
    assert component_count(80, 60) == 50
    assert component_count(10, 100) == 9
    assert component_count(100, 5) == 4
    assert component_count(10, 100, 3) == 3
    assert component_count(1, 100) is None and component_count(10, 1) is None


def mixed(spark):
    rows = [(float(i % 7), f"v{i % 5}" if i % 6 else None, i % 3 == 0, i) for i in range(40)]
    return spark.createDataFrame(rows, "a double, s string, b boolean, t int")


def test_sparse_rows_hold_the_numbers_of_the_columns(spark):
    df = mixed(spark)
    dense, sparse = preprocess(df, "t", "regression", encoding="columns"), preprocess(df, "t", "regression", encoding="vector")
    assert sparse.feature_cols == ["features"] and sparse.model.width == len(dense.feature_cols)
    assert [r.feature for r in sparse.model.feature_table().orderBy("at").collect()] == dense.feature_cols
    expected = {r.t: [r[c] for c in dense.feature_cols] for r in dense.df.collect()}
    found = {r.t: r.features.toArray().tolist() for r in sparse.df.collect()}
    assert found == expected
    fresh = spark.createDataFrame([(None, "never seen", None)], "a double, s string, b boolean")
    assert sparse.model.transform(fresh).first().features.toArray().tolist() == list(dense.model.transform(fresh).first())


@pytest.mark.parametrize("method", ["svd", "pca"])
def test_sparse_components_equal_those_of_columns(spark, method):
    df = mixed(spark)
    # Clustering keeps the target beside the components, so that rows can be told apart.
    parts = [
        preprocess(df, "t", "clustering", reduction=method, components=3, encoding=how) for how in ("columns", "vector")
    ]
    dense, sparse = ({r.t: [r.pc_1, r.pc_2, r.pc_3] for r in p.df.collect()} for p in parts)
    assert dense.keys() == sparse.keys()
    for t, scores in dense.items():
        assert sparse[t] == pytest.approx(scores, abs=1e-8)


def test_many_levels_become_one_sparse_column(spark):
    levels = 10_500
    df = spark.range(3 * levels).selectExpr(f"concat('k', id % {levels}) as s", "double(id) as x", "id % 2 as t")
    prepared = preprocess(df, "t")
    assert levels > PLAN_COLUMNS and prepared.feature_cols == ["features"] and prepared.model.width == levels + 1
    first = prepared.df.first().features
    assert len(first.indices) == 2 and first.size == levels + 1
    used = prepared.model.feature_table()
    assert (used.count(), used.select("at").distinct().count(), used.agg({"at": "max"}).first()[0]) == (levels + 1, levels + 1, levels)


def test_wide_svd_by_lanczos_and_missing_rank(spark):
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    df, values = wide(spark, 40, 12)
    vectors = df.select(array_to_vector(F.array(*df.columns)).alias("v"))
    _, axes, kept = fit_axes(vectors, 12, "svd", 3)
    _, lanczos, same = fit_axes(vectors, 12, "svd", 3, gram_columns=4)
    assert lanczos == pytest.approx(axes, abs=1e-6) and same == pytest.approx(kept)
    flat = spark.createDataFrame([(1.0, 2.0, 0.0, 0.0)] * 6, "a double, b double, c double, d double")
    _, axes, _ = fit_axes(flat.select(array_to_vector(F.array(*flat.columns)).alias("v")), 4, "svd", 3, gram_columns=2)
    assert axes.T @ axes == pytest.approx(np.eye(3), abs=1e-9)


def test_pair_sums_by_stripes_equal_plain_sums(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(size=(50, 5))
    values[rng.random(values.shape) < 0.2] = np.nan
    df = spark.createDataFrame([tuple(r) for r in values.tolist()], ", ".join(f"f{i} double" for i in range(5))).repartition(3)
    found = {(r.i, r.j): r for r in pair_sums(df, df.columns, [0.0] * 5, cells=10).collect()}
    assert len(found) == 10
    for (i, j), r in found.items():
        x, y = values[~np.isnan(values[:, i]) & ~np.isnan(values[:, j])][:, [i, j]].T
        assert (r.n, r.sx, r.sy, r.sxx, r.syy, r.sxy) == pytest.approx((len(x), x.sum(), y.sum(), x @ x, y @ y, x @ y))


def test_models_take_sparse_rows(spark):
    from tabloom import run_experiments, select_zoo

    df = spark.range(120).selectExpr("concat('k', id % 8) as s", "double(id % 11) as x", "int(id % 8 < 4) as t")
    prepared = preprocess(df, "t", encoding="vector", dedupe=False)
    names = {"majority_class", "logistic_regression", "nearest_neighbours_5"}
    zoo = [m for m in select_zoo("classification") if m.name in names]
    found = {r.model_name: r for r in run_experiments(prepared, zoo).collect()}
    assert len(found) == 3 and all(r.success for r in found.values()), found


def test_levels_are_counted_once(spark, monkeypatch):
    from tabloom.operators import prepare as module

    rows = [(f"u{i}", None if i == 3 else "xyz"[i % 3], float(i), "pq"[i % 2]) for i in range(60)]
    df = spark.createDataFrame([*rows, rows[0]], "own string, kind string, n double, t string")
    calls, count = [], module.value_counts

    def counting(*args):
        calls.append(args)
        return count(*args)

    for place in ("prepare", "sparse"):
        monkeypatch.setattr(f"tabloom.operators.{place}.value_counts", counting)
    for how in ("columns", "vector"):
        calls.clear()
        prepared = preprocess(df, "t", encoding=how)
        assert len(calls) == 1 and prepared.df.count() == 60 and prepared.model.feature_count == 4
        assert [f.name for f in prepared.model.categorical] == ["kind"]
        assert {"60 distinct values in 60 rows", "1 duplicate rows"} <= {r.details for r in prepared.log.collect()}


def test_the_sign_of_an_axis_does_not_hang_on_rounding():
    """Flags of two levels have entries of one size: the last bit must not decide which of them is made positive."""
    half = np.sqrt(0.5)
    one, two = (np.array([[half * (1 + e)], [-half * (1 - e)], [0.0]]) for e in (1e-15, -1e-15))
    assert reduce._signed(one)[0, 0] > 0 and reduce._signed(two)[0, 0] > 0
    assert reduce._signed(-one)[0, 0] > 0 and reduce._signed(-two)[0, 0] > 0
