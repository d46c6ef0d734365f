"""Profiling, preparation and model comparison for tables, as Spark jobs.

The public functions take and return DataFrames.  Only fitted scalars, column
names, class lists and experiment records ever reach the driver.
"""

from tabloom.functions.formula import FormulaError, compile_formula, derive, validate_formula
from tabloom.functions.roles import column_roles, pick_target, resolve_column
from tabloom.models import select_zoo
from tabloom.operators.detect import class_balance, detect_target, detect_task, is_imbalanced
from tabloom.operators.features import (
    apply_features,
    bin_categorical,
    decompose_datetime,
    product,
    ratio,
)
from tabloom.operators.metrics import (
    average_precision,
    classification_metrics,
    cluster_counts,
    regression_metrics,
)
from tabloom.operators.prepare import (
    PreparedData,
    PrepModel,
    deduplicate,
    drop_all_missing,
    drop_high_cardinality,
    impute_median,
    impute_mode,
    one_hot,
    preprocess,
    standard_scale,
)
from tabloom.operators.profile import (
    categorical_profile,
    duplicate_count,
    high_missing,
    missing_profile,
    missing_total,
    numeric_profile,
    profile,
    table_profile,
)
from tabloom.operators.rank import (
    best_model,
    best_record,
    experiment_summary,
    failures,
    has_fatal,
    leaderboard,
    rank_results,
)
from tabloom.operators.reduce import reduce_dims
from tabloom.operators.silhouette import silhouette
from tabloom.operators.split import (
    balanced_weights,
    positive_weight,
    split_features,
    train_test_split,
)
from tabloom.operators.suggest import (
    correlation_pairs,
    feature_suggestions,
    suggest_binning,
    suggest_datetime,
)
from tabloom.plans.experiments import AllExperimentsFailed, run_experiments, run_one
from tabloom.plans.study import StudyFailed, StudyResult, run_pipeline, run_report
from tabloom.sources.tables import (
    preview,
    read_table,
    require_min_rows,
    require_non_empty,
    write_table,
)

__all__ = [name for name in dir() if not name.startswith("_")]
