"""Table and column profiles.

One aggregate without grouping covers everything that combines map-side
(counts, moments, extremes).  Distinct counts and modes need the values
themselves: these go through one unpivot per value type, pre-aggregated by
(column, value) before the shuffle, so a hot value is one row by then.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import double_sql, literal_rows, present_sql, quoted, text_sql
from tabloom.functions.roles import column_roles
from tabloom.plans.ordered import by_family, rounds, value_facts
from tabloom.session import shuffles_dropped, staged

HIGH_MISSING_PCT = 50.0
#: Hashes of repeated rows up to which their table, eight bytes each, is broadcast.
BROADCAST_HASHES = 1_000_000


def table_profile(df: DataFrame) -> DataFrame:
    """One row: number of rows and columns."""
    return df.agg(F.count(F.lit(1)).alias("num_rows"), F.lit(len(df.columns)).alias("num_cols"))


def repeated_hashes(df: DataFrame) -> DataFrame:
    """The 64-bit row hashes ``_h`` that occur more than once, written; without any, no two rows are equal.

    Large tables are done in rounds, and a round's shuffle files go when it is written.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    hashed = df.toDF(*names).select(F.xxhash64(*names).alias("_h"))

    def repeated(rows: DataFrame) -> DataFrame:
        return staged(rows.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_h"), drop_shuffles=True)

    return reduce(DataFrame.unionByName, [repeated(hashed.filter(cut)) for cut in rounds("_h", df.count())])


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row: rows beyond the first copy of each full row, nulls being equal.

    Rows are counted by a 64-bit hash first, and the hashes that occur more than once are written.  Only rows
    with such a hash are compared in full, so mostly distinct tables shuffle a hash a row; which way the second
    step goes is decided by the number of these hashes, not by an estimate.  Beyond ``BROADCAST_HASHES`` all rows
    are grouped, equal ones combined before the shuffle, in rounds if they hold many values.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    plain = df.toDF(*names)
    hashed = plain.withColumn("_h", F.xxhash64(*names))
    repeated = repeated_hashes(df)
    known = repeated.count()
    if not known:
        return literal_rows(df.sparkSession, [(0,)], "duplicate_count bigint")

    def beyond_first(rows: DataFrame) -> DataFrame:
        copies = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
        return copies.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_count"))

    if known <= BROADCAST_HASHES:
        return beyond_first(hashed.join(F.broadcast(repeated), "_h", "left_semi"))
    cuts = rounds("_h", df.count() * len(names))
    if len(cuts) == 1:
        return beyond_first(plain)
    with shuffles_dropped(df.sparkSession):
        found = sum(beyond_first(hashed.filter(cut)).first()[0] for cut in cuts)
    return literal_rows(df.sparkSession, [(found,)], "duplicate_count bigint")


def _missing_facts(df: DataFrame) -> DataFrame:
    """One row per column with its missing count and the row count, from one aggregate."""
    facts = df.agg(
        F.expr("count(1) as _rows"),
        *[F.expr(f"count({present_sql(df, name)}) as _c{i}") for i, name in enumerate(df.columns)],
    )
    per_column = [
        f"struct({text_sql(name)} as column, _rows - _c{i} as missing, _rows as num_rows)"
        for i, name in enumerate(df.columns)
    ]
    return facts.select(F.expr(f"inline(array({', '.join(per_column)}))"))


def missing_profile(df: DataFrame) -> DataFrame:
    """Missing count and percentage per column; ``pct`` is unrounded, ``missing_pct`` has 2 digits."""
    pct = F.coalesce(
        F.try_divide(F.col("missing") * F.lit(100.0), F.col("num_rows").cast("double")), F.lit(0.0)
    )
    return (
        _missing_facts(df)
        .withColumn("pct", pct)
        .select(
            "column",
            "missing",
            "pct",
            F.round("pct", 2).alias("missing_pct"),
            (F.col("pct") > HIGH_MISSING_PCT).alias("high_missing"),
        )
    )


def high_missing(df: DataFrame) -> DataFrame:
    """Columns with strictly more than half of their values missing."""
    return missing_profile(df).filter(F.col("pct") > HIGH_MISSING_PCT).select("column", "missing_pct")


def missing_total(df: DataFrame) -> DataFrame:
    """One row: missing cells, all cells, missing percentage of the whole table."""
    return (
        _missing_facts(df)
        .agg(F.sum("missing").alias("missing_cells"), F.sum("num_rows").alias("total_cells"))
        .withColumn(
            "missing_pct",
            F.coalesce(
                F.try_divide(F.col("missing_cells") * F.lit(100.0), F.col("total_cells").cast("double")),
                F.lit(0.0),
            ),
        )
    )


def value_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """(slot, value as text, n) for every value of the named columns; slot is the position in ``names``.

    The nulls of a column are one row, so an empty column still shows up.
    """
    slim = df.selectExpr(*[f"cast({quoted(n)} as string) as `{i}`" for i, n in enumerate(names)])
    return (
        slim.unpivot([], slim.columns, "slot", "value")
        .groupBy("slot", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def distinct_counts(df: DataFrame, names: list[str]) -> dict[str, int]:
    """Exact distinct non-null values per column, compared in the column's own type."""
    result: dict[str, int] = {}
    for family, members in by_family(df, names).items():
        slim = df.selectExpr(
            *[f"cast({present_sql(df, n)} as {family}) as `{i}`" for i, n in enumerate(members)]
        )
        counted = (
            slim.unpivot([], slim.columns, "slot", "value")
            .groupBy("slot", "value")
            .agg(F.lit(1).alias("one"))
            .groupBy("slot")
            .agg(F.count("value").alias("u"))
            .collect()
        )
        found = {members[int(r.slot)]: r.u for r in counted}
        result.update({n: found.get(n, 0) for n in members})
    return result


_NUMERIC_SCHEMA = (
    "column string, mean double, std double, min double, max double, "
    "q25 double, median double, q75 double, unique_count bigint"
)
_FRACTIONS = [0.25, 0.5, 0.75]


def numeric_profile(df: DataFrame, names: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Mean, sample deviation, extremes, quartiles and distinct count per numeric column.

    ``exact=False`` takes sketches for quartiles and distinct counts, so that the
    whole profile is one pass with a tiny shuffle.
    """
    names = column_roles(df)[0] if names is None else names
    spark = df.sparkSession
    if not names:
        return spark.createDataFrame([], _NUMERIC_SCHEMA)

    def facts(name: str):
        x = double_sql(df, name)
        parts = (
            f"count({x}) as n, avg({x}) as mean, stddev_samp({x}) as std, min({x}) as low, max({x}) as high"
        )
        if not exact:
            hashed = f"hll_sketch_agg(if({x} is null, null, xxhash64({x})), 14)"
            parts += (
                f", percentile_approx({x}, array({', '.join(map(str, _FRACTIONS))}), 10000) as quartiles"
                f", hll_sketch_estimate({hashed}) as u"
            )
        return F.expr(f"struct({parts})")

    row = df.agg(*[facts(n) for n in names]).first()
    found = dict(zip(names, row, strict=True))
    if exact:
        counts = {n: f.n for n, f in found.items()}
        facts_of = value_facts(df, names, _FRACTIONS, counts)
        quartiles = {n: q for n, (q, _) in facts_of.items()}
        distinct = {n: u for n, (_, u) in facts_of.items()}
    else:
        quartiles = {n: f.quartiles or [None] * 3 for n, f in found.items()}
        distinct = {n: f.u for n, f in found.items()}
    rows = [
        (n, f.mean, f.std, f.low, f.high, *quartiles[n], distinct[n]) for n, f in found.items()
    ]
    return literal_rows(spark, rows, _NUMERIC_SCHEMA)


def categorical_profile(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Distinct count, most frequent value and its frequency per categorical column.

    The smallest of equally frequent values counts as the most frequent one.
    """
    names = column_roles(df)[1] if names is None else names
    if not names:
        return df.sparkSession.createDataFrame(
            [], "column string, unique_count bigint, top_value string, top_freq bigint"
        )
    best = F.min(F.when(F.col("value").isNotNull(), F.struct(-F.col("n"), F.col("value"))))
    labels = F.expr(f"array({', '.join(map(text_sql, names))})")
    return (
        value_counts(df, names)
        .groupBy("slot")
        .agg(F.count("value").alias("unique_count"), best.alias("best"))
        .select(
            F.get(labels, F.col("slot").cast("int")).alias("column"),
            "unique_count",
            F.col("best.value").alias("top_value"),
            (-F.col("best.col1")).alias("top_freq"),
        )
    )


def profile(df: DataFrame, exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """(one-row table profile, one-row-per-column profile)."""
    numeric, categorical = column_roles(df)
    roles = {n: "numeric" for n in numeric} | {n: "categorical" for n in categorical}
    facts = literal_rows(
        df.sparkSession,
        [
            (i, f.name, f.dataType.simpleString(), roles.get(f.name))
            for i, f in enumerate(df.schema.fields)
        ],
        "position int, column string, dtype string, role string",
    )
    table = table_profile(df)
    if all(f.name in roles for f in df.schema.fields):
        # One row on each side; a map column has no equality and hence no duplicates.
        table = table.select("*", F.lit(duplicate_count(df).first()[0]).alias("duplicate_count"))
    else:
        table = table.select("*", F.lit(None).cast("bigint").alias("duplicate_count"))
    numbers = numeric_profile(df, numeric, exact).withColumnRenamed("unique_count", "u_num")
    classes = categorical_profile(df, categorical).withColumnRenamed("unique_count", "u_cat")
    columns = (
        facts.join(missing_profile(df).select("column", "missing_pct", "high_missing"), "column")
        .join(numbers, "column", "left")
        .join(classes, "column", "left")
        .select(
            "position", "column", "dtype", "role", "missing_pct", "high_missing",
            "mean", "std", "min", "max", "q25", "median", "q75",
            F.coalesce("u_num", "u_cat").alias("unique_count"), "top_value", "top_freq",
        )
    )
    return table, columns
