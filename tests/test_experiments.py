import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabloom import AllExperimentsFailed, preprocess, run_experiments, run_pipeline, run_report, select_zoo
from tabloom.models import base, classification
from tabloom.models.base import ModelSpec, sized
from tabloom.plans import ordered
from tabloom.plans.experiments import folds
from tabloom.session import ensure_checkpoint_dir


def classified(spark, n=240, classes=2, kind="int"):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(n, 4))
    y = np.digitize(x[:, 0] + 0.5 * x[:, 1], [0.0] if classes == 2 else [-0.5, 0.5])
    label = y if kind == "int" else np.array(["lo", "mid", "top"])[y]
    rows = [(*map(float, v), label[i].item()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, f"a double, b double, c double, d double, target {kind}")


def by_name(records):
    return {r.model_name: r for r in records.collect()}


def small(task, *names):
    return [s for s in select_zoo(task) if s.name in names]


def test_classification_zoo(spark):
    records = run_experiments(preprocess(classified(spark), "target"))
    found = by_name(records)
    assert len(found) == 7 and all(r.success for r in found.values()), found
    base = found["majority_class"].metrics["accuracy"]
    for name, r in found.items():
        assert set(r.metrics) == {"accuracy", "f1", "precision", "recall", "pr_auc"}
        assert (r.n_train_samples, r.n_test_samples) == (240 - r.n_test_samples, r.n_test_samples)
        if name != "majority_class":
            assert r.metrics["accuracy"] > max(base, 0.75), name
            assert r.metrics["pr_auc"] > 0.8, name
    assert "scale_pos_weight" in found["boosted_trees_100"].params
    assert [r.model_name for r in records.collect()] == sorted(found)


def test_three_text_classes(spark):
    zoo = small("classification", "logistic_regression", "kernel_svm_rbf", "nearest_neighbours_5", "random_forest_100")
    found = by_name(run_experiments(preprocess(classified(spark, classes=3, kind="string"), "target"), zoo))
    assert all(r.success and r.metrics["f1"] > 0.6 and np.isnan(r.metrics["pr_auc"]) for r in found.values()), found


def test_multiclass_boosting(spark):
    zoo = small("classification", "gradient_boosting_100")
    df = classified(spark, n=90, classes=3, kind="string")
    assert by_name(run_experiments(preprocess(df, "target"), zoo))["gradient_boosting_100"].success


def test_regression_zoo(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(200, 3))
    y = 3 * x[:, 0] - x[:, 1] + rng.normal(0, 0.1, 200)
    df = spark.createDataFrame([(*map(float, v), float(t)) for v, t in zip(x, y)], "a double, b double, c double, y double")
    found = by_name(run_experiments(preprocess(df, "y", "regression")))
    assert len(found) == 7 and all(r.success for r in found.values()), found
    assert found["linear_regression"].metrics["r2"] > 0.99 and found["ridge_alpha1"].metrics["r2"] > 0.98
    assert all(r.metrics["r2"] > 0.6 for n, r in found.items() if n != "mean_value")
    assert found["mean_value"].metrics["r2"] < 0.1


def test_clustering_zoo(spark):
    rng = np.random.default_rng(0)
    centres = np.array([[0, 0], [5, 5], [-5, 5]], dtype=float)
    x = centres[np.arange(120) % 3] + rng.normal(0, 0.5, (120, 2))
    df = spark.createDataFrame([tuple(map(float, v)) for v in x], "a double, b double")
    found = by_name(run_experiments(preprocess(df, task="clustering", reduction="off")))
    assert len(found) == 5 and all(r.success for r in found.values()), found
    for name in ("kmeans_3", "gaussian_mixture_3", "ward_3"):
        assert found[name].metrics["n_clusters"] == 3 and found[name].metrics["silhouette"] > 0.7
    assert found["kmeans_5"].metrics["n_clusters"] == 5
    assert found["kmeans_3"].n_test_samples == 0 and found["kmeans_3"].n_train_samples == 120


def broken(fold):
    raise RuntimeError("no such luck")


BROKEN = ModelSpec("broken", "none", {}, broken)


def test_a_broken_model_is_isolated(spark):
    found = by_name(run_experiments(preprocess(classified(spark), "target"), [BROKEN, *small("classification", "majority_class")]))
    assert not found["broken"].success and found["broken"].error_type == "RuntimeError"
    assert found["broken"].error_message == "no such luck" and found["majority_class"].success


def test_all_broken_is_fatal(spark):
    with pytest.raises(AllExperimentsFailed, match="no such luck") as caught:
        run_experiments(preprocess(classified(spark), "target"), [BROKEN])
    assert caught.value.records.count() == 1


def slow(fold):
    tick = F.udf(lambda v: time.sleep(1) or v, "double")
    return fold.test.withColumn("prediction", tick("label")), {}


def test_scope(spark):
    prepared = preprocess(classified(spark), "target")
    assert run_experiments(prepared, max_experiments=1, max_workers=1).count() == 1
    found = by_name(run_experiments(prepared, [ModelSpec("slow", "none", {}, slow), *small("classification", "majority_class")], time_cap_s=2))
    assert found["slow"].error_type == "TimeCapExceeded"
    assert found["slow"].runtime_seconds < 30 and found["majority_class"].success


def test_too_few_rows(spark):
    with pytest.raises(ValueError):
        run_experiments(preprocess(spark.createDataFrame([(1.0, 1)], "a double, t int"), "t"))


def test_rows_without_target_are_left_out(spark):
    df = classified(spark, n=100).withColumn("target", F.when(F.col("a") < 1.5, F.col("target")))
    missing = df.filter("target is null").count()
    record = run_experiments(preprocess(df, "target"), small("classification", "majority_class")).first()
    assert missing > 0 and record.n_train_samples + record.n_test_samples == 100 - missing


def test_whole_run_and_report(spark, tmp_path):
    rng = np.random.default_rng(21)
    rows = [
        (int(i), None if i % 9 == 0 else float(rng.normal()), float(rng.normal()), None if i % 11 == 0 else "nsew"[i % 4],
         f"2024-01-{1 + i % 28:02d}", None, int(i % 2))
        for i in range(60)
    ]
    df = spark.createDataFrame(rows + rows[:5], "id int, feat_a double, feat_b double, region string, day string, void string, target int")
    result = run_pipeline(
        df, features=("day_decomposed",), custom_features=({"name": "sum", "formula": "feat_a + feat_b"}, {"name": "bad", "formula": "x()"}),
        scope={"zoo": [*small("classification", "majority_class", "logistic_regression"), BROKEN]}, best_override="majority_class",
    )
    assert result.table_profile.first().duplicate_count == 5
    assert result.detection.first().task_type == "classification"
    clean = result.prepared.df
    assert clean.count() == 60
    gaps = clean.agg(*[F.count_if(F.col(f"`{c}`").isNull()) for c in clean.columns]).first()
    assert sum(gaps) == 0
    assert {"day_year", "sum"} <= set(result.prepared.feature_cols)
    assert result.leaderboard.count() == 2 and result.failures.count() == 1
    assert result.best.first().best_model_id == "majority_class"
    kinds = {r.error_type for r in result.errors.collect()}
    assert {"column_all_missing", "custom_formula_rejected", "experiment_failure", "high_missing_values"} <= kinds
    sections = run_report(result, str(tmp_path / "report"))
    assert len(sections) == 18 and "clean_table" in sections
    assert spark.read.parquet(str(tmp_path / "report" / "ranking")).count() == 2


def test_rows_of_one_file_are_spread_for_training(spark):
    rows = sized(spark.range(0, 60_000, 1, 1), 60_000)
    held = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert len(held) == 3 and max(held) <= 25_000


def test_partitions_grow_with_narrow_rows_once_every_core_has_some(spark):
    rows = spark.range(0, 4_000_000, 1, 1)
    assert sized(rows, 4_000_000, 12).rdd.getNumPartitions() == 40
    assert sized(rows, 4_000_000, 80).rdd.getNumPartitions() == 160
    assert sized(rows, 4_000_000).rdd.getNumPartitions() == 160


def test_rows_in_memory_hold_their_features_once(spark):
    with folds(preprocess(classified(spark), "target")) as fold:
        plan = fold.train._jdf.queryExecution().optimizedPlan().toString()
        stored = next(line for line in plan.splitlines() if "InMemoryRelation" in line)
        assert "features#" in stored and "x#" not in stored
        row = fold.train.first()
        assert row.x == list(row.features) and len(row.x) == 4


def test_medians_of_the_profile_are_not_worked_out_again(spark, monkeypatch):
    df = classified(spark).withColumn("a", F.when(F.col("b") < 1, F.col("a")))
    expected = preprocess(df, "target").model.numeric

    def again(*args):
        raise AssertionError("the medians are known")

    monkeypatch.setattr("tabloom.operators.prepare.quantiles", again)
    zoo = [s for s in select_zoo("classification") if s.name == "majority_class"]
    found = run_pipeline(df, "target", scope={"zoo": zoo}).prepared.model.numeric
    assert found == expected


def test_boosting_over_merged_rows_equals_boosting_over_single_rows(spark, monkeypatch):
    """Rows of equal features are boosted as one, however many there are; predictions are those of the single rows."""
    from pyspark.ml.regression import GBTRegressor

    trained = []
    fit = GBTRegressor.fit

    def counted(self, rows, *params):
        trained.append(rows.count())
        return fit(self, rows, *params)

    monkeypatch.setattr(GBTRegressor, "fit", counted)
    rng = np.random.default_rng(4)
    places = rng.integers(0, 5, size=(600, 2))
    y = np.sin(places[:, 0]) * 3 + places[:, 1] ** 2 + rng.normal(size=600)
    df = spark.createDataFrame([(int(a), int(b), float(v)) for (a, b), v in zip(places, y, strict=True)], "a int, b int, t double")
    spec = small("regression", "gradient_boosting_100")[0]
    with folds(preprocess(df, "t", "regression")) as fold:
        found = {r.id: r.prediction for r in spec.run(fold)[0].collect()}
        gbt = GBTRegressor(maxIter=100, maxDepth=3, stepSize=0.1, seed=42)
        single = {r.id: r.prediction for r in fit(gbt, fold.train).transform(fold.test).select("id", "prediction").collect()}
        assert len(found) == fold.n_test and fold.n_train > 400
    assert trained == [25]
    assert found == pytest.approx(single, abs=1e-6)


def written(spark, since=()):
    """Files of the checkpoint folder with their bytes, without those of ``since``."""
    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    return {p: p.stat().st_size for p in folder.rglob("*") if p.is_file() and p not in since}


def test_a_large_table_is_not_copied_for_its_models(spark, tmp_path, monkeypatch):
    """Beyond the limits, files with plain numbers are read again instead of being written as scaled doubles, twice and more."""
    classified(spark, 4_000).coalesce(1).write.parquet(str(tmp_path / "rows"))
    df, zoo = spark.read.parquet(str(tmp_path / "rows")), small("classification", "logistic_regression", "majority_class")
    expected = by_name(run_pipeline(df, "target", scope={"zoo": zoo}).records)
    monkeypatch.setattr(base, "HELD_VALUES", 100, raising=False)
    monkeypatch.setattr(ordered, "VALUES_AT_ONCE", 3_000, raising=False)
    before = written(spark)
    result = run_pipeline(df, "target", scope={"zoo": zoo})
    found = by_name(result.records)
    assert sum(written(spark, before).values()) < df.count() * 8
    assert not spark.sparkContext._jsc.getPersistentRDDs()
    assert result.prepared.df.count() == 4_000
    for name, r in found.items():
        assert (r.n_train_samples, r.n_test_samples) == (expected[name].n_train_samples, expected[name].n_test_samples)
        assert r.metrics == pytest.approx(expected[name].metrics, abs=2e-3), name


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_rows_that_are_not_held_give_the_same_models(spark, monkeypatch, task):
    df = classified(spark, 400).withColumn("target", F.expr("target" if task == "classification" else "a + b * c"))
    zoo = small(task, "logistic_regression", "majority_class", "nearest_neighbours_5", "linear_regression", "mean_value")
    held = by_name(run_experiments(preprocess(df, "target", task), zoo))
    monkeypatch.setattr(base, "HELD_VALUES", 0)
    with folds(preprocess(df, "target", task)) as fold:
        assert not fold.held and "InMemory" not in fold.train._jdf.queryExecution().optimizedPlan().toString()
    anew = by_name(run_experiments(preprocess(df, "target", task), zoo))
    assert held.keys() == anew.keys() and len(held) > 1
    for name, r in anew.items():
        assert r.success and (r.n_train_samples, r.n_test_samples) == (held[name].n_train_samples, held[name].n_test_samples)
        assert r.metrics == pytest.approx(held[name].metrics, rel=1e-3, nan_ok=True), name


def test_newton_finds_the_coefficients_of_least_loss(spark, monkeypatch):
    from pyspark.ml.classification import LogisticRegression

    monkeypatch.setattr(base, "HELD_VALUES", 0)
    df = classified(spark, 500).withColumn("e", F.col("a") * 2).withColumn("f", F.lit(1.0))  # one axis twice, and a constant
    with folds(preprocess(df, "target")) as fold:
        weights = classification._balanced(fold)
        model = LogisticRegression(
            maxIter=1000, tol=1e-12, regParam=1 / fold.n_train, standardization=False, weightCol="weight"
        ).fit(classification._weighted(fold, weights))
        found = classification._newton(fold, weights)
        assert found[:-1] == pytest.approx(model.coefficients.toArray(), abs=1e-5)
        assert found[-1] == pytest.approx(model.intercept, abs=1e-5)
        scored = classification._logistic_predicted(fold, found).orderBy("score").collect()
        expected = model.transform(fold.test).select("prediction", vector_to_array("probability")[1].alias("score")).orderBy("score").collect()
        assert [r.score for r in scored] == pytest.approx([r.score for r in expected], abs=1e-5)
        assert sum(r.prediction for r in scored) == pytest.approx(sum(r.prediction for r in expected), abs=1)
