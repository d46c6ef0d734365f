"""Target choice, task type and class balance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import is_fractional, is_integral, literal_rows, present, ref
from tabloom.functions.roles import pick_target, resolve_column

# Fixed values of the task rule.
FEW_VALUES = 10
CONFIRM_BELOW = 0.7
HINT_CONFIDENCE = 0.8
IMBALANCE_BELOW = 0.10
TASKS = ("classification", "regression", "clustering")

_SCHEMA = "target_column string, task_type string, confidence double, needs_confirmation boolean"


def detect_target(df: DataFrame, explicit: str | None = None, clustering: bool = False) -> str | None:
    """Target column: the (loosely) named one, else a well-known name, else the last; none for clustering."""
    return pick_target(df, resolve_column(df, explicit), clustering)


def _few_distinct(df: DataFrame, target: str) -> tuple[int, int, int, int]:
    """(distinct values, present, missing, present values that are whole numbers) of a numeric column.

    The distinct count is exact up to ``FEW_VALUES``.  A sketch in the first pass
    settles wide columns: ten values set at most ten of its registers, so an
    estimate far above ten proves more than ten values, and no shuffle is needed.
    """
    x = present(df, target)
    row = df.agg(
        F.approx_count_distinct(x, 0.05).alias("guess"),
        F.count(x).alias("n"),
        F.count(F.lit(1)).alias("rows"),
        F.count_if(x == F.floor(x)).alias("whole"),
    ).first()
    u = row.guess
    if u <= 10 * FEW_VALUES:
        u = df.agg(F.count_distinct(x)).first()[0]
    return u, row.n, row.rows - row.n, row.whole


def _rule(df: DataFrame, target: str | None) -> tuple[str, float]:
    """Task and confidence from the target column alone."""
    if target is None or target not in df.columns:
        return "clustering", 1.0
    dtype = df.schema[target].dataType
    if not (is_integral(dtype) or is_fractional(dtype)):
        return "classification", 1.0
    u, n, missing, whole = _few_distinct(df, target)
    if is_fractional(dtype) or missing:  # whole numbers with gaps are floats in a data frame
        small_codes = n > 0 and whole == n and u <= FEW_VALUES
        return ("classification", 0.5) if small_codes else ("regression", 1.0)
    if u <= 2:
        return "classification", 1.0
    return ("classification", 0.5) if u <= FEW_VALUES else ("regression", 0.95)


def detect_task(
    df: DataFrame,
    target: str | None,
    task_hint: str | None = None,
    override: str | None = None,
) -> DataFrame:
    """One row: target, task, confidence and whether the caller should confirm.

    ``task_hint`` replaces the rule's task (not clustering) and lifts the confidence
    to at least 0.8; ``override`` is a confirmed choice with confidence 1.
    """
    for given in (task_hint, override):
        if given is not None and given not in TASKS:
            raise ValueError(f"unknown task {given!r}: use one of {TASKS}")
    target = target if target in df.columns else None
    task, confidence = _rule(df, target)
    if target is not None and task_hint in ("classification", "regression"):
        task, confidence = task_hint, max(confidence, HINT_CONFIDENCE)
    if override is not None:
        task, confidence = override, 1.0
        target = None if override == "clustering" else target
    row = (target, task, confidence, confidence < CONFIRM_BELOW)
    return literal_rows(df.sparkSession, [row], _SCHEMA)


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Share per class, 4 digits, with majority and minority marked; empty below two classes."""
    counts = (
        df.select(ref(target).cast("string").alias("label"))
        .filter("label is not null")
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = counts.agg(
        F.sum("n").alias("rows"), F.count("n").alias("classes"),
        F.max("n").alias("most"), F.min("n").alias("least"),
    ).first()
    return counts.filter(F.lit(total.classes >= 2)).select(
        "label",
        "n",
        F.round(F.try_divide(F.col("n").cast("double"), F.lit(float(total.rows or 1))), 4).alias("share"),
        (F.col("n") == F.lit(total.most)).alias("is_majority"),
        (F.col("n") == F.lit(total.least)).alias("is_minority"),
    )


def is_imbalanced(balance: DataFrame) -> DataFrame:
    """One row: the smallest share and whether it is below a tenth."""
    return balance.agg(F.min("share").alias("minority_share")).select(
        "minority_share",
        F.coalesce(F.col("minority_share") < IMBALANCE_BELOW, F.lit(False)).alias("imbalanced"),
    )
