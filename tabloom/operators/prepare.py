"""Cleaning, imputation, scaling, encoding: fitted once, applied as one projection.

Fitting takes one aggregate for all numeric moments, the exact medians, and one
pre-aggregated value count for all categorical columns.  Everything fitted is a
few scalars and level names per column, and applying them is a single select.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import (
    as_double,
    double_sql,
    literal_rows,
    number_sql,
    present,
    present_sql,
    quoted,
    ref,
    text_sql,
)
from tabloom.functions.roles import column_roles
from tabloom.operators.profile import repeated_hashes, value_counts
from tabloom.operators.reduce import Projection, fit_projection
from tabloom.operators.sparse import SparseModel, level_table
from tabloom.plans.ordered import quantiles, rounds
from tabloom.session import staged

# Fixed values of the drop rule for free text and identifiers.
MANY_LEVELS = 20
MANY_LEVELS_SHARE = 0.4
#: One-hot columns whose names may live in the plan; with more levels, the features are one sparse vector column.
PLAN_COLUMNS = 2_000
LOG_SCHEMA = "column string, operation string, details string"
ERROR_SCHEMA = "phase string, error_type string, message string, recoverable boolean"


class NoFeaturesLeft(ValueError):
    """Preparation left no feature column."""


@dataclass(frozen=True)
class NumericFit:
    name: str
    median: float
    mean: float
    scale: float
    missing: int


@dataclass(frozen=True)
class CategoricalFit:
    name: str
    mode: str
    levels: tuple[str, ...]
    missing: int


@dataclass
class PrepModel:
    """Fitted preparation; ``transform`` also works on rows it was not fitted on."""

    numeric: list[NumericFit]
    categorical: list[CategoricalFit]
    target: str | None = None
    projection: Projection | None = None
    columns: list[str] = field(init=False)

    def __post_init__(self) -> None:
        self.columns = [f.name for f in self.numeric] + [
            f"{f.name}_{level}" for f in self.categorical for level in f.levels
        ]
        if len(set(self.columns)) < len(self.columns):
            raise ValueError("an encoded level has the name of another feature column")

    @property
    def feature_cols(self) -> list[str]:
        return self.projection.names if self.projection else self.columns

    @property
    def feature_count(self) -> int:
        return len(self.feature_cols)

    def _encoded(self, df: DataFrame) -> list[str]:
        scaled = [
            f"(coalesce({double_sql(df, f.name)}, {number_sql(f.median)}) - {number_sql(f.mean)}) / {number_sql(f.scale)}"
            f" as {quoted(f.name)}"
            for f in self.numeric
        ]
        flags = [
            f"double(coalesce(cast({quoted(f.name)} as string), {text_sql(f.mode)}) = {text_sql(level)})"
            f" as {quoted(f'{f.name}_{level}')}"
            for f in self.categorical
            for level in f.levels
        ]
        return scaled + flags

    def encode(self, df: DataFrame) -> DataFrame:
        """Features before any projection, and the target as it is."""
        kept = [quoted(self.target)] if self.target in df.columns else []
        return df.selectExpr(*self._encoded(df), *kept)

    def transform(self, df: DataFrame) -> DataFrame:
        encoded = self.encode(df)
        return self.projection.apply(encoded) if self.projection else encoded


@dataclass
class PreparedData:
    """The clean table, its feature columns, what was done, and the fitted model."""

    df: DataFrame
    feature_cols: list[str]
    log: DataFrame
    model: PrepModel | SparseModel
    target: str | None
    task: str
    errors: list[tuple[str, str, str, bool]]
    #: Whether reading ``df`` again costs little more than reading files.
    reread: bool = False


def scaled_only(prepared: PreparedData) -> bool:
    """Whether each feature is arithmetic on one number of its row."""
    model = prepared.model
    return isinstance(model, PrepModel) and not model.categorical and model.projection is None


def imputed(column: Column, fill) -> Column:
    return F.coalesce(column, F.lit(fill))


def scaled_value(column: Column, mean: float, scale: float) -> Column:
    return (column - F.lit(mean)) / F.lit(scale)


def deduplicate(df: DataFrame) -> DataFrame:
    """Distinct full rows, nulls being equal."""
    return df.dropDuplicates()


def without_duplicates(df: DataFrame, duplicates: int | None = None) -> tuple[DataFrame, int]:
    """(distinct rows, rows removed).

    Looking for equal rows shuffles hashes only, so a table without any is left as it
    is; otherwise the distinct rows are written once for the passes that follow, in rounds if they
    hold many values, and are counted there, if the caller does not know the duplicates.
    """
    if duplicates == 0 or (duplicates is None and repeated_hashes(df).isEmpty()):
        return df, 0
    rows = df.count()
    cuts = rounds(", ".join(map(quoted, df.columns)), rows * len(df.columns))
    parts = [staged(deduplicate(df.filter(cut)), drop_shuffles=len(cuts) > 1) for cut in cuts]
    distinct = reduce(DataFrame.unionByName, parts)
    return distinct, rows - distinct.count() if duplicates is None else duplicates


def present_counts(df: DataFrame, names: list[str]) -> tuple[int, dict[str, int]]:
    """Row count and present values per column, in one aggregate."""
    row = df.agg(F.expr("count(1)"), *[F.expr(f"count({present_sql(df, n)})") for n in names]).first()
    return row[0], dict(zip(names, row[1:], strict=True))


def drop_all_missing(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Drop the columns (of ``cols``, default all) without any present value."""
    cols = df.columns if cols is None else cols
    _, held = present_counts(df, cols)
    return df.drop(*[n for n in cols if held[n] == 0])


def _level_facts(df: DataFrame, names: list[str], counted: DataFrame | None = None) -> dict[str, tuple[int, str | None, int]]:
    """(distinct values, smallest most frequent value, missing) per column, from one value count."""
    if not names:
        return {}
    held = F.col("value").isNotNull()
    rows = (
        (value_counts(df, names) if counted is None else counted)
        .groupBy("slot")
        .agg(
            F.count("value").alias("levels"),
            F.min(F.when(held, F.struct(-F.col("n"), F.col("value")))).alias("best"),
            F.coalesce(F.sum(F.when(~held, F.col("n"))), F.lit(0)).alias("missing"),
        )
        .collect()
    )
    found = {
        names[int(r.slot)]: (r.levels, r.best.value if r.best else None, r.missing) for r in rows
    }
    return {n: found.get(n, (0, None, 0)) for n in names}


def _too_many_levels(levels: int, rows: int) -> bool:
    return levels > MANY_LEVELS and levels / rows > MANY_LEVELS_SHARE


def drop_high_cardinality(
    df: DataFrame, cols: list[str] | None = None, levels: int = MANY_LEVELS, share: float = MANY_LEVELS_SHARE
) -> DataFrame:
    """Drop categorical columns with more than ``levels`` values that are more than ``share`` of the rows."""
    cols = column_roles(df)[1] if cols is None else cols
    facts = _level_facts(df, cols)
    rows = df.count()
    return df.drop(*[n for n in cols if facts[n][0] > levels and facts[n][0] / rows > share])


def _medians(df: DataFrame, cols: list[str], held: dict[str, int], exact: bool) -> dict[str, float]:
    if not cols:
        return {}
    if exact:
        return {n: q[0] for n, q in quantiles(df, cols, [0.5], held).items()}
    row = df.agg(*[F.percentile_approx(as_double(df, n), 0.5, 10_000) for n in cols]).first()
    return dict(zip(cols, row, strict=True))


def impute_median(df: DataFrame, cols: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Fill missing numbers with the column's median; the columns become doubles."""
    cols = column_roles(df)[0] if cols is None else cols
    _, held = present_counts(df, cols)
    medians = _medians(df, cols, held, exact)
    return df.withColumns({n: imputed(as_double(df, n), medians[n]) for n in cols})


def impute_mode(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Fill missing categories with the most frequent value, the smallest one on a tie."""
    cols = column_roles(df)[1] if cols is None else cols
    facts = _level_facts(df, cols)
    return df.withColumns(
        {
            n: F.coalesce(ref(n), F.lit(facts[n][1]).cast(df.schema[n].dataType))
            for n in cols
            if facts[n][1] is not None
        }
    )


def standard_scale(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Zero mean and unit population variance; a constant column is only centred."""
    cols = column_roles(df)[0] if cols is None else cols
    if not cols:
        return df
    row = df.agg(
        *[F.expr(f"struct(avg({x}) as m, stddev_pop({x}) as s)") for x in (double_sql(df, n) for n in cols)]
    ).first()
    fits = dict(zip(cols, row, strict=True))
    return df.withColumns(
        {
            n: scaled_value(as_double(df, n), f.m, f.s or 1.0) if f.m is not None else as_double(df, n)
            for n, f in fits.items()
        }
    )


def levels_of(df: DataFrame, counts: dict[str, int], counted: DataFrame | None = None) -> dict[str, tuple[str, ...]]:
    """Sorted distinct values per column that has any by ``counts``; each one becomes a column of the plan."""
    total = sum(counts.values())
    found: dict[str, list[str]] = {n: [] for n in counts}
    if total:
        names = list(counts)
        for r in (value_counts(df, names) if counted is None else counted).filter("value is not null").collect():
            found[names[int(r.slot)]].append(r.value)
    return {n: tuple(sorted(values, key=lambda v: v.encode())) for n, values in found.items()}


def one_hot(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Replace each column by one 0/1 column per sorted level, ``<col>_<level>``; null has no level.

    Every level is a column, so this is for few levels; :func:`preprocess` turns to sparse vectors for many.
    """
    cols = column_roles(df)[1] if cols is None else cols
    levels = levels_of(df, {n: facts[0] for n, facts in _level_facts(df, cols).items()})
    kept = [quoted(n) for n in df.columns if n not in set(cols)]
    flags = [
        f"double(cast({quoted(n)} as string) <=> {text_sql(v)}) as {quoted(f'{n}_{v}')}"
        for n in cols
        for v in levels[n]
    ]
    return df.selectExpr(*kept, *flags)


def _numeric_fits(
    df: DataFrame, cols: list[str], rows: int, exact: bool, known: dict[str, float] | None = None
) -> list[NumericFit]:
    """Median, if not ``known``, and the moments the column has once its gaps hold the median.

    Both follow from the moments of the present values, so imputing needs no second pass.
    """
    if not cols:
        return []
    moments = df.agg(
        *[
            F.expr(f"struct(count({x}) as n, avg({x}) as mean, var_pop({x}) as var)")
            for x in (double_sql(df, n) for n in cols)
        ]
    ).first()
    stats = dict(zip(cols, moments, strict=True))
    medians = dict(known or {})
    medians |= _medians(df, [n for n in cols if n not in medians], {n: s.n for n, s in stats.items()}, exact)
    fits = []
    for n, s in stats.items():
        gaps, median = rows - s.n, medians[n]
        mean = (s.n * s.mean + gaps * median) / rows
        spread = s.n * (s.var + (s.mean - mean) ** 2) + gaps * (median - mean) ** 2
        scale = (spread / rows) ** 0.5
        fits.append(NumericFit(n, median, mean, scale or 1.0, gaps))
    return fits


def fit_preparation(
    df: DataFrame, target: str | None = None, exact: bool = True, encoding: str = "auto", medians: dict[str, float] | None = None
) -> tuple[PrepModel | SparseModel, list[tuple[str, str, str]], list[tuple[str, str, str, bool]]]:
    """Fit on ``df``; returns the model, log rows and error rows.  ``medians`` are those known of the very same rows."""
    if encoding not in ("auto", "columns", "vector"):
        raise ValueError(f"unknown encoding {encoding!r}: use 'auto', 'columns' or 'vector'")
    log: list[tuple[str, str, str]] = []
    errors: list[tuple[str, str, str, bool]] = []
    numeric, categorical = column_roles(df, exclude=[target] if target else [])
    rows, held = present_counts(df, numeric + categorical)
    for name in (n for n in numeric + categorical if held[n] == 0):
        log.append((name, "drop", "all values are missing"))
        errors.append(("preparation", "column_all_missing", f"{name}: all values are missing", True))
    numeric = [n for n in numeric if held[n]]
    coded_names = [n for n in categorical if held[n]]
    # Counted once and written: the levels are needed again once it is known which columns stay.
    counted = staged(value_counts(df, coded_names)) if coded_names else None
    facts = _level_facts(df, coded_names, counted)
    for name in [n for n, f in facts.items() if _too_many_levels(f[0], rows)]:
        text = f"{facts.pop(name)[0]} distinct values in {rows} rows"
        log.append((name, "drop", text))
        errors.append(("preparation", "column_dropped", f"{name}: {text}", True))
    if not numeric and not facts:
        raise NoFeaturesLeft("no feature column is left after preparation")

    def gap(name: str, missing: int, what: str) -> None:
        if missing:
            log.append((name, "impute", f"{missing} missing values ({100 * missing / rows:.1f}%) by {what}"))

    fits = _numeric_fits(df, numeric, rows, exact, medians)
    for fit in fits:
        gap(fit.name, fit.missing, "median")
        log.append((fit.name, "scale", "zero mean, unit variance"))
    for name, (count, _, missing) in facts.items():
        gap(name, missing, "most frequent value")
        log.append((name, "onehot_encode", f"{count} levels"))
    total = sum(f[0] for f in facts.values())
    if facts:
        place = {n: str(i) for i, n in enumerate(facts)}
        slots = f"array({', '.join(place.get(n, 'cast(null as int)') for n in coded_names)})"
        counted = counted.selectExpr(f"{slots}[int(slot)] as slot", "value", "n").filter("slot is not null")
    if encoding == "vector" or (encoding == "auto" and total > PLAN_COLUMNS):
        coded = [CategoricalFit(n, f[1], (), f[2]) for n, f in facts.items()]
        return SparseModel(fits, coded, target, level_table(df, list(facts), len(fits), counted), len(fits) + total), log, errors
    levels = levels_of(df, {n: f[0] for n, f in facts.items()}, counted)
    coded = [CategoricalFit(n, f[1], levels[n], f[2]) for n, f in facts.items()]
    return PrepModel(fits, coded, target), log, errors


def preprocess(
    df: DataFrame,
    target: str | None = None,
    task: str = "classification",
    fit_on: DataFrame | None = None,
    reduction: str = "svd",
    components: int | None = None,
    exact: bool = True,
    dedupe: bool = True,
    encoding: str = "auto",
    medians: dict[str, float] | None = None,
) -> PreparedData:
    """Deduplicate, drop, impute, scale, encode, and for clustering reduce.

    ``encoding`` is ``"columns"`` (one column per level), ``"vector"`` (one sparse vector column ``features``), or
    ``"auto"``: columns as long as all levels are few enough for the plan.  Both hold the same numbers in the same order.

    Fitted on the whole table unless ``fit_on`` names other rows.  The target
    column travels with its features and is never changed.  ``medians`` holds those
    a caller knows of the rows that are fitted, so that they are not worked out again.
    """
    log: list[tuple[str, str, str]] = []
    if dedupe:
        df, removed = without_duplicates(df)
        if removed:
            log.append(("dataset", "deduplication", f"{removed} duplicate rows"))
    model, steps, errors = fit_preparation(df if fit_on is None else fit_on, target, exact, encoding, medians)
    log += steps
    if task == "clustering" and reduction not in ("off", "none"):
        fitted = df if fit_on is None else fit_on
        if isinstance(model, SparseModel):
            width, p = model.width, model.fit_projection(fitted, reduction, components)
        else:
            width, encoded = len(model.columns), model.encode(fitted).select(*map(ref, model.columns))
            p = model.projection = fit_projection(encoded, model.columns, reduction, components)
        if p:
            log.append(
                ("features", "dimension_reduction", f"{width} to {len(p.names)} by {reduction}, {p.explained:.1%} of variance")
            )
    if target in df.columns:
        gaps = df.filter(present(df, target).isNull()).count()
        if gaps:
            log.append((target, "target_missing", f"{gaps} rows without target"))
    return PreparedData(
        df=model.transform(df),
        feature_cols=model.feature_cols,
        log=literal_rows(df.sparkSession, log, LOG_SCHEMA),
        model=model,
        target=target if target in df.columns else None,
        task=task,
        errors=errors,
    )

