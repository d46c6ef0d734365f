"""Suggestions for derived features.  Nothing here changes the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import is_datetime, literal_rows, ref, text_sql
from tabloom.functions.roles import column_roles
from tabloom.operators.gram import means, pair_sums
from tabloom.operators.profile import distinct_counts

CORRELATION_THRESHOLD = 0.7
BINNING_THRESHOLD = 10
SUGGESTION_SCHEMA = "name string, type string, columns array<string>, evidence double"

# Accepted date and time shapes as (pattern, format); null format = ISO.
_DATE_SHAPES = (
    (r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?\s*(Z|[+-]\d{2}:?\d{2})?)?$", None),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "M/d/yyyy H:mm"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "M/d/yyyy H:mm:ss"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Za-z]{4,9} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2} [A-Za-z]{4,9} \d{4}$", "d MMMM yyyy"),
    (r"^\d{4}-\d{2}$", "yyyy-MM"),
)


def parse_datetime(df: DataFrame, name: str) -> Column:
    """The column as a date or timestamp; text that is none becomes null."""
    column = ref(name)
    if is_datetime(df.schema[name].dataType):
        return column
    text = F.trim(column.cast("string"))
    tries = [
        F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(fmt)) if fmt else F.try_to_timestamp(text))
        for shape, fmt in _DATE_SHAPES
    ]
    return F.coalesce(*tries)


def _unparsed(df: DataFrame, names: list[str]) -> dict[str, tuple[int, int]]:
    """(present values, values that are no date) per column."""
    row = df.agg(
        *[
            F.struct(
                F.count(ref(n)).alias("n"),
                F.count_if(ref(n).isNotNull() & parse_datetime(df, n).isNull()).alias("bad"),
            )
            for n in names
        ]
    ).first()
    return {n: (f.n, f.bad) for n, f in zip(names, row, strict=True)}


def suggest_datetime(df: DataFrame) -> DataFrame:
    """Columns of a date or time type, and text columns whose every present value reads as one.

    A look at a few rows rules most text columns out, since one value that is no
    date is enough for that; only the others are read in full.
    """
    typed = [f.name for f in df.schema.fields if is_datetime(f.dataType)]
    texts = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    if texts:
        texts = [n for n, (_, bad) in _unparsed(df.select(*map(ref, texts)).limit(200), texts).items() if bad == 0]
    if texts:
        texts = [n for n, (seen, bad) in _unparsed(df, texts).items() if seen > 0 and bad == 0]
    hits = [n for n in df.columns if n in set(typed) | set(texts)]
    rows = [(f"{n}_decomposed", "datetime_decompose", [n], 1.0) for n in hits]
    return literal_rows(df.sparkSession, rows, SUGGESTION_SCHEMA)


def correlations(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(col_a, col_b, r): pairwise-complete Pearson r of every unordered numeric pair that has one.

    A single SQL aggregate over all pairs outgrows code generation at some dozens of
    pairs; the matrix sums take one pass at any number.
    """
    names = column_roles(df)[0] if names is None else names
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, r double")
    sums = pair_sums(df, names, means(df, names))
    spread_x = F.col("sxx") - F.try_divide(F.col("sx") * F.col("sx"), F.col("n"))
    spread_y = F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), F.col("n"))
    joint = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), F.col("n"))
    # Rounding can leave a constant column a spread of about 1e-16 of its square sum.
    flat = (spread_x <= 1e-12 * F.col("sxx")) | (spread_y <= 1e-12 * F.col("syy"))
    labels = F.expr(f"array({', '.join(map(text_sql, names))})")
    return (
        sums.select(
            F.get(labels, F.col("i")).alias("col_a"),
            F.get(labels, F.col("j")).alias("col_b"),
            F.when(~flat, F.try_divide(joint, F.sqrt(spread_x * spread_y))).alias("r"),
        )
        .filter("r is not null")
    )


def correlation_pairs(df: DataFrame, threshold: float = CORRELATION_THRESHOLD) -> DataFrame:
    """Ratio suggestions for strongly correlated numeric pairs, with their r."""
    return (
        correlations(df)
        .filter(F.abs("r") >= threshold)
        .select(
            F.concat("col_a", F.lit("_per_"), "col_b").alias("name"),
            F.lit("ratio").alias("type"),
            F.array("col_a", "col_b").alias("columns"),
            F.col("r").alias("evidence"),
        )
    )


def suggest_binning(df: DataFrame, threshold: int = BINNING_THRESHOLD) -> DataFrame:
    """Binning suggestions for categorical columns with many distinct values."""
    names = column_roles(df)[1]
    counts = distinct_counts(df, names) if names else {}
    rows = [
        (f"{n}_binned", "binning", [n], float(u)) for n, u in counts.items() if u >= threshold
    ]
    return literal_rows(df.sparkSession, rows, SUGGESTION_SCHEMA)


def feature_suggestions(df: DataFrame) -> DataFrame:
    """All suggestions as one table, empty if there is nothing to suggest."""
    return (
        suggest_datetime(df).unionByName(correlation_pairs(df)).unionByName(suggest_binning(df))
    )
