"""Running the zoo side by side: independent Spark fits from a small driver pool."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.columns import present, ref
from tabloom.models import base, select_zoo
from tabloom.models.base import Fold, ModelSpec, sized, vector_rows, with_array
from tabloom.operators.metrics import classification_metrics, cluster_counts, regression_metrics
from tabloom.operators.prepare import PreparedData
from tabloom.operators.rank import RECORD_SCHEMA
from tabloom.operators.silhouette import silhouette
from tabloom.operators.split import sized_hint, train_test_split
from tabloom.session import ensure_checkpoint_dir, settle, staged
from tabloom.sources.tables import require_min_rows

MAX_WORKERS = 4

#: What a record holds before its model has run, by column type.
EMPTY = {"string": lambda: None, "map": dict, "boolean": bool, "double": float, "bigint": int}

#: Families from the longest to the shortest fits: long ones start first, so that none is left over alone.
FAMILIES_BY_LENGTH = ("boosting", "svm", "hierarchical", "density", "tree", "instance", "centroid", "distribution")


class AllExperimentsFailed(RuntimeError):
    """No model of the zoo could be fitted; the text has one line per model."""

    def __init__(self, message: str, records: DataFrame):
        super().__init__(message)
        self.records = records


def _expected_length(spec: ModelSpec) -> int:
    known = spec.family in FAMILIES_BY_LENGTH
    return FAMILIES_BY_LENGTH.index(spec.family) if known else len(FAMILIES_BY_LENGTH)


def _classes(rows: DataFrame, target: str) -> tuple[list, int]:
    """All classes in order, and the rows; the list has to fit the driver, as the models keep a row per class anyway."""
    found = rows.groupBy(ref(target)).agg(F.count(F.lit(1))).collect()
    return sorted(r[0] for r in found), sum(r[1] for r in found)


def _one(classes: list) -> float | None:
    """The number of the class 1, None if no class is 1."""
    for number, name in enumerate(classes):
        try:
            if float(name) == 1.0:
                return float(number)
        except (TypeError, ValueError):
            continue
    return None


@contextmanager
def folds(prepared: PreparedData) -> Iterator[Fold]:
    """The rows all models share, split once, written once and held in memory while in use.

    Row ids and the split must be the same for every model, hence the written copy.  Beyond ``HELD_VALUES`` feature
    values, copies in files, shuffles and memory would fill many times the disk of the table: the rows are then
    written at most once, and each pass reads them again and tells the split by their content.
    """
    features, target, width = prepared.feature_cols, prepared.target, prepared.model.feature_count
    if target is None:
        rows = vector_rows(prepared.df, features).drop("x").withColumn("id", F.monotonically_increasing_id())
        rows = settle(rows)
        n = rows.count()
        rows = sized(rows, n, width).persist()
        try:
            full = with_array(rows)
            yield Fold(full, full, n, 0, width)
        finally:
            rows.unpersist()
        return

    known = prepared.df.filter(present(prepared.df, target).isNotNull())
    classes: list = []
    if prepared.task == "classification":
        classes, total = _classes(known, target)
        split = train_test_split(known, by=target if len(classes) > 1 else None)
        spark, kind = known.sparkSession, known.schema[target].dataType.simpleString()
        numbers = spark.createDataFrame([(c, float(i)) for i, c in enumerate(classes)], f"_class {kind}, _label double")
        split = split.join(sized_hint(numbers, len(classes)), ref(target) == F.col("_class")).drop("_class")
        label = F.col("_label")
    else:
        split, total = train_test_split(known), known.count()
        label = ref(target).cast("double")
    rows = vector_rows(split.withColumn("_label", label), features, F.col("_label").alias("label"), "is_test")
    if total * width > base.HELD_VALUES:
        yield _read_anew(rows, width, classes, prepared.reread)
        return
    rows = settle(rows.drop("x").withColumn("id", F.monotonically_increasing_id()))
    sizes = rows.groupBy("is_test").count().collect()
    n = {r.is_test: r["count"] for r in sizes}
    n_train, n_test = n.get(False, 0), n.get(True, 0)
    train = sized(rows.filter(~F.col("is_test")).drop("is_test"), n_train, width).persist()
    test = sized(rows.filter("is_test").drop("is_test"), n_test, width).persist()
    class_rows = [0] * len(classes)
    if classes:
        for r in train.groupBy("label").count().collect():
            class_rows[int(r.label)] = r["count"]
    try:
        yield Fold(
            with_array(train), with_array(test), n_train, n_test, width, classes, class_rows
        )
    finally:
        train.unpersist()
        test.unpersist()


def _read_anew(rows: DataFrame, width: int, classes: list, reread: bool) -> Fold:
    """A fold that keeps nothing in memory; rows that are costly to read again are written first, features once."""
    if not reread:
        written = staged(rows.drop("features") if "x" in rows.columns else rows)
        rows = written.withColumn("features", array_to_vector("x")) if "x" in written.columns else written
    n, class_rows = {False: 0, True: 0}, [0] * len(classes)
    for r in rows.groupBy("is_test", *(["label"] if classes else [])).count().collect():
        n[r.is_test] += r["count"]
        if classes and not r.is_test:
            class_rows[int(r.label)] = r["count"]
    rows = with_array(rows.withColumn("id", F.monotonically_increasing_id()))
    train, test = rows.filter(~F.col("is_test")).drop("is_test"), rows.filter("is_test").drop("is_test")
    return Fold(train, test, n[False], n[True], width, classes, class_rows, held=False)


def _scores(task: str, predicted: DataFrame, fold: Fold, silhouette_method: str) -> dict[str, float]:
    if task == "clustering":
        counts = cluster_counts(predicted, "prediction").first()
        quality = silhouette(predicted, ["x"], "prediction", silhouette_method).first()[0]
        return {
            "n_clusters": float(counts.n_clusters), "n_noise": float(counts.n_noise),
            "silhouette": float(quality if quality is not None else "nan"),
        }
    if task == "regression":
        row = regression_metrics(predicted, "label", "prediction").first()
        return {k: float(v) for k, v in row.asDict().items() if v is not None}
    score = "score" if "score" in predicted.columns else None
    row = classification_metrics(predicted, "label", "prediction", score, 1.0 if score else None, _one(fold.classes)).first()
    found = {k: float(v) for k, v in row.asDict().items() if v is not None}
    return {"pr_auc": float("nan")} | found


def run_one(spec: ModelSpec, task: str, fold: Fold, silhouette_method: str = "squared") -> dict:
    """Fit, predict and score one model.  A failure becomes a record, never an exception."""
    started = time.perf_counter()
    fields = [part.split() for part in RECORD_SCHEMA.split(", ")]
    record = {name: EMPTY[kind.split("<")[0]]() for name, kind in fields}
    record |= {name: spec.name for name in ("model_id", "model_name")}
    record |= {"family": spec.family, "task_type": task, "params": dict(spec.params)}
    try:
        predicted, found = spec.run(fold)
        # No score of labelled rows asks for their ids.
        predicted = (predicted if task == "clustering" else predicted.drop("id")).persist()
        try:
            record["metrics"] = _scores(task, predicted, fold, silhouette_method)
        finally:
            predicted.unpersist()
        record["params"] |= found
        if task == "clustering":
            record["params"]["silhouette"] = silhouette_method
        record["n_train_samples"], record["n_test_samples"] = fold.n_train, fold.n_test
        record["success"] = True
    except Exception as exc:  # isolation: one model must not stop the others
        record["error_type"], record["error_message"] = type(exc).__name__, str(exc)
    record["runtime_seconds"] = round(time.perf_counter() - started, 4)
    return record


def _capped(spec: ModelSpec, task: str, fold: Fold, cap: float, method: str, run: str) -> dict:
    """Run one model under its own job group; past the cap its jobs are cancelled."""
    context = fold.train.sparkSession.sparkContext
    group = f"{run}-{spec.name}"
    context.setJobGroup(group, spec.name, interruptOnCancel=True)
    context.setLocalProperty("spark.scheduler.pool", f"tabloom-{spec.family}")  # a fixed set of names
    if cap <= 0:
        return run_one(spec, task, fold, method)
    done, late = threading.Event(), threading.Event()

    def watch() -> None:
        if not done.wait(cap):
            late.set()
            while not done.wait(0.5):  # also jobs the model starts after its time is up
                context.cancelJobGroup(group)

    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        record = run_one(spec, task, fold, method)
    finally:
        done.set()
    if late.is_set():
        record |= {
            "success": False, "error_type": "TimeCapExceeded", "metrics": {},
            "error_message": f"stopped after {cap} seconds",
        }
    return record


def records_table(spark: SparkSession, records: list[dict]) -> DataFrame:
    ordered = sorted(records, key=lambda r: r["model_name"])
    names = [part.split()[0] for part in RECORD_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in ordered], RECORD_SCHEMA)


def run_experiments(
    prepared: PreparedData,
    zoo: list[ModelSpec] | None = None,
    max_experiments: int | None = None,
    max_workers: int | None = None,
    time_cap_s: float = 0,
    silhouette_method: str = "squared",
) -> DataFrame:
    """One record per model, by name.  Raises :class:`AllExperimentsFailed` if none succeeded.

    ``silhouette_method`` is ``"squared"`` (linear time, squared distances, all rows) or ``"exact"``
    (Euclidean distances, quadratic work), the same at every size; the records' parameters name it.
    """
    task = prepared.task
    zoo = (select_zoo(task) if zoo is None else list(zoo))[:max_experiments]
    workers = max(1, max_workers or min(MAX_WORKERS, len(zoo) or 1))
    spark = prepared.df.sparkSession
    ensure_checkpoint_dir(spark)
    require_min_rows(prepared.df, 2)
    run = uuid.uuid4().hex[:8]
    with folds(prepared) as fold:
        def one(spec: ModelSpec):
            # Wrapped per model: each thread needs local properties (job group, pool) of its own.
            return inheritable_thread_target(spark)(
                lambda: _capped(spec, task, fold, time_cap_s, silhouette_method, run)
            )

        with ThreadPoolExecutor(workers) as pool:
            running = [pool.submit(one(spec)) for spec in sorted(zoo, key=_expected_length)]
            records = [r.result() for r in running]
    table = records_table(spark, records)
    if records and not any(r["success"] for r in records):
        lines = [f"- {r['model_name']}: {r['error_type']}: {r['error_message']}" for r in records]
        raise AllExperimentsFailed("all experiments failed:\n" + "\n".join(lines), table)
    return table
