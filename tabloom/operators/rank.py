"""Ranking of experiment records, leaderboard, winner, failures, error log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values: (primary metric, tiebreak metric) per task.
METRICS = {
    "classification": ("f1", "precision"),
    "regression": ("r2", "rmse"),
    "clustering": ("silhouette", "n_clusters"),
}
# Metrics where less is better; all others: more is better.
LOWER_IS_BETTER = ("rmse", "mae", "n_noise")
# Metrics a leaderboard shows besides the primary one.
EXTRA_METRICS = {
    "classification": ("accuracy", "precision", "recall", "pr_auc"),
    "regression": ("rmse", "mae"),
    "clustering": ("n_clusters", "n_noise"),
}
RECORD_SCHEMA = (
    "model_id string, model_name string, family string, params map<string,string>, task_type string, "
    "success boolean, error_type string, error_message string, metrics map<string,double>, "
    "runtime_seconds double, n_train_samples bigint, n_test_samples bigint"
)
ERROR_SCHEMA = "phase string, error_type string, message string, recoverable boolean"


def direction(metric: str) -> int:
    """1 if more is better, -1 if less is."""
    return -1 if metric in LOWER_IS_BETTER else 1


def metric_value(metric: str, metrics: str = "metrics") -> Column:
    """The metric out of the map; a missing one or NaN is infinitely bad."""
    value = F.try_element_at(F.col(metrics), F.lit(metric))
    worst = F.lit(-direction(metric) * float("inf"))
    return F.coalesce(F.nanvl(value, worst), worst)


def _metrics_of(task: str) -> tuple[str, str]:
    if task not in METRICS:
        raise ValueError(f"unknown task {task!r}: use one of {sorted(METRICS)}")
    return METRICS[task]


def rank_results(records: DataFrame, task: str) -> DataFrame:
    """Successful records in order of primary metric, tiebreak metric, model name.

    There is one record per model, so the ordering window is a handful of rows.
    """
    primary, tiebreak = _metrics_of(task)
    good = records.filter("success").select(
        F.coalesce("model_id", "model_name").alias("model_id"),
        "model_name",
        F.lit(primary).alias("primary_metric"),
        metric_value(primary).alias("primary_value"),
        metric_value(tiebreak).alias("tiebreaker_value"),
        "metrics",
        F.coalesce("runtime_seconds", F.lit(0.0)).alias("runtime_seconds"),
    )
    order = Window.orderBy(
        (F.col("primary_value") * -direction(primary)).asc(),
        (F.col("tiebreaker_value") * -direction(tiebreak)).asc(),
        F.coalesce("model_name", "model_id", F.lit("")).asc(),
    )
    return good.select(F.row_number().over(order).alias("rank"), *good.columns)


def best_model(ranking: DataFrame, override: str | None = None) -> DataFrame:
    """One row: the chosen model id (``"none"`` without any success) and whether the caller overrode it."""
    first = F.coalesce(F.min_by("model_id", "rank"), F.lit("none"))
    chosen = first if not override else F.lit(str(override))
    return ranking.agg(chosen.alias("best_model_id"), first.alias("_first")).select(
        "best_model_id", (F.col("best_model_id") != F.col("_first")).alias("overridden")
    )


def experiment_summary(records: DataFrame) -> DataFrame:
    """One row: runs, successes, failures, total runtime."""
    good = F.coalesce(F.col("success"), F.lit(False))
    return records.agg(
        F.count(F.lit(1)).alias("n_run"),
        F.count_if(good).alias("n_ok"),
        F.count_if(~good).alias("n_failed"),
        F.coalesce(F.sum("runtime_seconds"), F.lit(0.0)).alias("total_runtime_seconds"),
    )


def leaderboard(records: DataFrame, task: str, n: int | None = None) -> DataFrame:
    """Ranking with the task's further metrics as columns; the first ``n`` entries if given."""
    ranked = rank_results(records, task)
    extra = [F.try_element_at(F.col("metrics"), F.lit(m)).alias(m) for m in EXTRA_METRICS[task]]
    board = ranked.select(
        "rank", "model_name", F.col("primary_value").alias(METRICS[task][0]), *extra, "runtime_seconds"
    )
    return board if n is None else board.filter(F.col("rank") <= n)


def best_record(records: DataFrame, best_id: str) -> DataFrame:
    """The full record of the model with this id or name."""
    return records.filter((F.col("model_id") == best_id) | (F.col("model_name") == best_id))


def failures(records: DataFrame) -> DataFrame:
    """Name, error type and message of the failed runs."""
    return records.filter(~F.coalesce(F.col("success"), F.lit(False))).select(
        "model_name", "error_type", "error_message"
    )


def has_fatal(errors: DataFrame) -> bool:
    """Whether the error log holds an entry the run cannot go on after."""
    return not errors.filter(~F.col("recoverable")).isEmpty()
