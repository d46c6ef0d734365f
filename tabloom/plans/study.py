"""The whole way from a table to a ranked list of models, and its report tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tabloom.functions.columns import literal_rows
from tabloom.models import base
from tabloom.operators.detect import class_balance, detect_target, detect_task, is_imbalanced
from tabloom.operators.features import LOG_SCHEMA as FEATURE_LOG_SCHEMA
from tabloom.operators.features import apply_features
from tabloom.operators.prepare import PreparedData, preprocess, scaled_only, without_duplicates
from tabloom.operators.profile import missing_total, profile
from tabloom.operators.rank import (
    ERROR_SCHEMA,
    best_model,
    best_record,
    experiment_summary,
    failures,
    leaderboard,
    rank_results,
)
from tabloom.operators.suggest import feature_suggestions
from tabloom.plans.experiments import run_experiments
from tabloom.session import only_read, staged
from tabloom.sources.tables import require_non_empty, write_table


class StudyFailed(ValueError):
    """A stage could not go on; the text has one line per fatal entry of ``errors``, the error table up to there."""

    def __init__(self, message: str, errors: DataFrame):
        super().__init__(message)
        self.errors = errors


@dataclass
class StudyResult:
    """All tables of a run."""

    table_profile: DataFrame
    column_profile: DataFrame
    suggestions: DataFrame
    detection: DataFrame
    class_balance: DataFrame | None
    feature_log: DataFrame
    prepared: PreparedData
    records: DataFrame
    ranking: DataFrame
    leaderboard: DataFrame
    best: DataFrame
    failures: DataFrame
    errors: DataFrame
    missing: DataFrame
    imbalance: DataFrame | None
    summary: DataFrame
    best_record: DataFrame


def run_pipeline(
    df: DataFrame,
    target: str | None = None,
    clustering: bool = False,
    task_hint: str | None = None,
    task_override: str | None = None,
    features: tuple[str, ...] = (),
    custom_features: tuple[dict, ...] = (),
    scope: dict | None = None,
    best_override: str | None = None,
    exact: bool = True,
    reduction: str = "svd",
    components: int | None = None,
    stage_input: bool = False,
) -> StudyResult:
    """Profile, detect, derive, prepare, train, rank; every default can be replaced by an argument.

    ``exact=False`` takes sketches for quartiles, medians and distinct counts of the
    profile.  ``scope`` is passed on to :func:`run_experiments`.  ``stage_input`` writes
    an input that is costly to read again, such as CSV, as Parquet first.
    """
    spark, errors, stage = df.sparkSession, [], ["input"]
    try:
        return _run(
            df, target, clustering, task_hint, task_override, features, custom_features, scope or {}, best_override, exact,
            reduction, components, stage_input, errors, stage,
        )
    except Exception as exc:  # later stages are skipped, what is known so far stays
        errors.append((stage[0], type(exc).__name__, str(exc), False))
        log = literal_rows(spark, errors, ERROR_SCHEMA)
        fatal = [f"{where}: {kind}: {what}" for where, kind, what, recoverable in errors if not recoverable]
        raise StudyFailed("the study stopped\n" + "\n".join(fatal), log) from exc


def _run(
    df, target, clustering, task_hint, task_override, features, custom_features, scope, best_override, exact, reduction,
    components, stage_input, errors, stage,
) -> StudyResult:
    """The stages; ``errors`` and ``stage`` tell the caller how far they came."""
    df = staged(df) if stage_input else df
    require_non_empty(df)
    spark = df.sparkSession
    stage[0] = "profile"
    table, columns = profile(df, exact)
    facts = columns.select("column", "missing_pct", "high_missing", "median").collect()
    errors += [
        ("profile", "high_missing_values", f"{r.column}: {r.missing_pct}% missing", True) for r in facts if r.high_missing
    ]
    suggestions = feature_suggestions(df)
    stage[0] = "detection"
    chosen = detect_target(df, target, clustering)
    detection = detect_task(df, chosen, task_hint, task_override)
    found = detection.first()
    balance = class_balance(df, found.target_column) if found.task_type == "classification" else None
    stage[0] = "preparation"
    unique, removed = without_duplicates(df, table.first().duplicate_count)
    made, feature_log, feature_errors = apply_features(unique, suggestions, features, custom_features)
    # The exact medians of the profile are those of the rows to prepare, if these are the table itself.
    medians = {r.column: r.median for r in facts if r.median is not None} if exact and made is df else None
    prepared = preprocess(
        made, found.target_column, found.task_type, reduction=reduction, components=components,
        exact=exact, dedupe=False, medians=medians,
    )
    # The clean table is a result of its own, and every model reads it.  A large one that is no more than files with
    # scaled numbers is not written: its doubles would fill several times the disk of those files.
    if not (scaled_only(prepared) and table.first().num_rows * prepared.model.feature_count > base.HELD_VALUES and only_read(made)):
        prepared.df = staged(prepared.df)
    prepared.reread = True
    if removed:
        note = literal_rows(
            spark, [("dataset", "deduplication", f"{removed} duplicate rows")], prepared.log.schema
        )
        prepared.log = note.unionByName(prepared.log)
    errors += feature_errors + prepared.errors
    stage[0] = "experiments"
    records = run_experiments(prepared, **scope)
    errors += [
        ("experiments", "experiment_failure", f"{r.model_name}: {r.error_type}: {r.error_message}", True)
        for r in failures(records).collect()
    ]
    stage[0] = "ranking"
    ranking = rank_results(records, found.task_type)
    best = best_model(ranking, best_override)
    return StudyResult(
        table_profile=table,
        column_profile=columns,
        suggestions=suggestions,
        detection=detection,
        class_balance=balance,
        feature_log=literal_rows(spark, feature_log, FEATURE_LOG_SCHEMA),
        prepared=prepared,
        records=records,
        ranking=ranking,
        leaderboard=leaderboard(records, found.task_type),
        best=best,
        failures=failures(records),
        errors=literal_rows(spark, errors, ERROR_SCHEMA),
        missing=missing_total(df),
        imbalance=is_imbalanced(balance) if balance is not None else None,
        summary=experiment_summary(records),
        best_record=best_record(records, best.first().best_model_id),
    )


def run_report(result: StudyResult, path: str) -> list[str]:
    """Write each table of a run as Parquet under ``path``; returns the section names."""
    sections = {
        "table_profile": result.table_profile,
        "column_profile": result.column_profile,
        "suggestions": result.suggestions,
        "detection": result.detection,
        "class_balance": result.class_balance,
        "feature_log": result.feature_log,
        "preparation_log": result.prepared.log,
        "records": result.records,
        "ranking": result.ranking,
        "leaderboard": result.leaderboard,
        "best_model": result.best,
        "failures": result.failures,
        "errors": result.errors,
        "missing_cells": result.missing,
        "imbalance": result.imbalance,
        "run_summary": result.summary,
        "best_record": result.best_record,
        "clean_table": result.prepared.df,
    }
    written = []
    for name, table in sections.items():
        if table is not None:
            write_table(table, f"{path.rstrip('/')}/{name}")
            written.append(name)
    return written
