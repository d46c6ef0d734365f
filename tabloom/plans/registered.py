"""Queries over the given tables, one per operator, each with its SQL counterpart where there is one.

The SQL states the expected result independently of the library and is run by DuckDB.
Floating point results are rounded on both sides.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabloom.functions.columns import double_sql, literal_rows, number_sql
from tabloom.functions.formula import derive
from tabloom.models import classification, regression, select_zoo
from tabloom.models.base import Fold, ModelSpec, sized, vector_rows
from tabloom.operators import detect, features, metrics, prepare, profile, rank, reduce, split, suggest
from tabloom.operators.density import dbscan
from tabloom.operators.neighbours import mean_label, nearest, vote
from tabloom.operators.prepare import PreparedData
from tabloom.operators.silhouette import silhouette
from tabloom.plans.experiments import run_experiments, run_one
from tabloom.plans.ordered import narrowed_quantiles
from tabloom.plans.study import StudyFailed, run_pipeline, run_report
from tabloom.session import ensure_checkpoint_dir
from tabloom.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tables.read_table(spark, f"{folder}/{name}.parquet", fmt="parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column."""
    return df.select(
        [F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema]
    )


def union_sql(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


# ---------------------------------------------------------------- inputs

LINEITEM_NUMBERS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
)
LINEITEM_COLUMNS = (*LINEITEM_NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate")


def gappy_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem with missing values: l_tax on line 7, l_discount from line 3 on, l_returnflag on line 1."""
    line = F.col("l_linenumber")
    return table(spark, folder, "lineitem").withColumns(
        {
            "l_tax": F.when(line != 7, F.col("l_tax")),
            "l_discount": F.when(line < 3, F.col("l_discount")),
            "l_returnflag": F.when(line != 1, F.col("l_returnflag")),
        }
    )


GAPPY = (
    "(SELECT * REPLACE (CASE WHEN l_linenumber <> 7 THEN l_tax END AS l_tax, "
    "CASE WHEN l_linenumber < 3 THEN l_discount END AS l_discount, "
    "CASE WHEN l_linenumber <> 1 THEN l_returnflag END AS l_returnflag) FROM lineitem)"
)


def customer_rows(spark: SparkSession, folder: str) -> DataFrame:
    """customer with its balance as a decimal, whose text is the same in any engine."""
    return table(spark, folder, "customer").select(
        "c_custkey", "c_nationkey", F.col("c_acctbal").cast("decimal(18,4)").alias("c_acctbal"), "c_mktsegment"
    )


CUSTOMER_HASH = (
    "md5(concat_ws('|', c_custkey::VARCHAR, c_nationkey::VARCHAR, (c_acctbal::DECIMAL(18,4))::VARCHAR, "
    "c_mktsegment, '42'))"
)
CUSTOMER_SPLIT = (
    "(SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment, "
    "dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS seg, "
    f"row_number() OVER (PARTITION BY c_mktsegment ORDER BY {CUSTOMER_HASH}) "
    "<= ceil(0.25 * count(*) OVER (PARTITION BY c_mktsegment)) AS is_test FROM customer)"
)


# ---------------------------------------------------------------- sources and shape

@query(
    "csv_round_trip",
    "SELECT p_partkey, p_name, p_brand, p_type, p_size::BIGINT AS p_size, p_retailprice FROM part",
)
def csv_round_trip(spark, folder):
    path = f"{ensure_checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    tables.write_table(table(spark, folder, "part"), path, "csv")
    return tables.read_table(spark, path, "csv")


@query("preview_counts", "SELECT count(*) AS num_rows, 6::BIGINT AS num_cols FROM orders")
def preview_counts(spark, folder):
    _, rows, cols = tables.preview(tables.require_non_empty(table(spark, folder, "orders")))
    return spark.createDataFrame([(rows, cols)], "num_rows bigint, num_cols bigint")


# ---------------------------------------------------------------- profiling

@query("table_profile", "SELECT count(*) AS num_rows, 11 AS num_cols FROM lineitem")
def table_profile(spark, folder):
    return profile.table_profile(table(spark, folder, "lineitem"))


@query(
    "duplicate_count",
    "SELECT (SELECT count(*) FROM orders) - (SELECT count(*) FROM "
    "(SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders)) AS duplicate_count",
)
def duplicate_count(spark, folder):
    return profile.duplicate_count(table(spark, folder, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority"))


@query(
    "duplicate_count_with_nulls",
    f"SELECT (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_discount, "
    f"l_tax, l_linestatus FROM {GAPPY})) AS duplicate_count",
)
def duplicate_count_with_nulls(spark, folder):
    return profile.duplicate_count(
        gappy_lineitem(spark, folder).select("l_returnflag", "l_discount", "l_tax", "l_linestatus")
    )


MISSING_SQL = union_sql(
    [
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, 100.0 * (count(*) - count({c})) / count(*) AS pct FROM {GAPPY}"
        for c in LINEITEM_COLUMNS
    ]
)


@query(
    "missing_profile",
    f'SELECT "column", missing, round(pct::DOUBLE, 6) AS pct, round(pct::DOUBLE, 2) AS missing_pct, pct > 50 AS high_missing FROM ({MISSING_SQL})',
)
def missing_profile(spark, folder):
    return profile.missing_profile(gappy_lineitem(spark, folder)).withColumn("pct", F.round("pct", 6))


@query("high_missing", f'SELECT "column", round(pct::DOUBLE, 2) AS missing_pct FROM ({MISSING_SQL}) WHERE pct > 50')
def high_missing(spark, folder):
    return profile.high_missing(gappy_lineitem(spark, folder))


@query(
    "missing_total",
    "SELECT sum(missing)::BIGINT AS missing_cells, (count(*) * (SELECT count(*) FROM lineitem))::BIGINT AS total_cells, "
    f"round(100.0 * sum(missing)::DOUBLE / (count(*) * (SELECT count(*) FROM lineitem)), 6) AS missing_pct FROM ({MISSING_SQL})",
)
def missing_total(spark, folder):
    return rounded(profile.missing_total(gappy_lineitem(spark, folder)))


def numeric_sql(columns, source: str) -> str:
    return union_sql(
        [
            f"SELECT '{c}' AS \"column\", round(avg({c}::DOUBLE), 7) AS mean, round(stddev_samp({c}::DOUBLE), 7) AS std, "
            f"min({c})::DOUBLE AS \"min\", max({c})::DOUBLE AS \"max\", round(quantile_cont({c}::DOUBLE, 0.25), 7) AS q25, "
            f"round(quantile_cont({c}::DOUBLE, 0.5), 7) AS median, round(quantile_cont({c}::DOUBLE, 0.75), 7) AS q75, "
            f"count(DISTINCT {c}) AS unique_count FROM {source}"
            for c in columns
        ]
    )


@query("numeric_profile", numeric_sql(LINEITEM_NUMBERS, "lineitem"))
def numeric_profile(spark, folder):
    return rounded(profile.numeric_profile(table(spark, folder, "lineitem")), 7)


@query("numeric_profile_with_gaps", numeric_sql(LINEITEM_NUMBERS, GAPPY))
def numeric_profile_with_gaps(spark, folder):
    return rounded(profile.numeric_profile(gappy_lineitem(spark, folder)), 7)


@query(
    "numeric_profile_sketched",
    union_sql(
        [
            f"SELECT '{c}' AS \"column\", round(avg({c}::DOUBLE), 4) AS mean, round(stddev_samp({c}::DOUBLE), 4) AS std, min({c})::DOUBLE AS min, "
            f"max({c})::DOUBLE AS max, true AS quartiles_near, true AS unique_near FROM lineitem"
            for c in LINEITEM_NUMBERS
        ]
    ),
)
def numeric_profile_sketched(spark, folder):
    """Sketched quartiles lie within a hundredth of the rows of the exact ones, distinct counts within a tenth."""
    df = table(spark, folder, "lineitem")
    return _near_exact(df, profile.numeric_profile(df, exact=False))


def _near_exact(df: DataFrame, found: DataFrame) -> DataFrame:
    """A sketched profile against exact ranks and distinct counts.

    A quartile is one of the values, so it lies between two exact quantiles if its exact ranks do: counting the values
    below it and up to it is one pass without a shuffle.  Of different values only those are shuffled.
    """
    names = [r.column for r in found.select("column").collect()]
    _, counts = prepare.present_counts(df, names)
    exact = profile.distinct_counts(df, names)
    sketched = {r.column: (r.q25, r.median, r.q75) for r in found.select("column", "q25", "median", "q75").collect()}
    ranks = []
    for name in names:
        x = double_sql(df, name)
        for q in sketched[name]:
            at = "double(null)" if q is None else number_sql(q)
            ranks.append(F.expr(f"struct(count_if({x} < {at}) as below, count_if({x} <= {at}) as upto)"))
    row = iter(df.agg(*ranks).first())
    facts = []
    for name in names:
        last = counts[name] - 1
        near = [
            r.upto - 1 >= math.ceil(last * (share - 0.01)) and r.below <= math.floor(last * (share + 0.01))
            for share, r in zip((0.25, 0.5, 0.75), row)
        ]
        facts.append((name, all(near), exact[name]))
    known = literal_rows(df.sparkSession, facts, "column string, quartiles_near boolean, u bigint")
    return found.join(F.broadcast(known), "column").select(
        "column", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "min", "max", "quartiles_near",
        (F.abs(F.col("unique_count") - F.col("u")) <= 0.1 * F.col("u") + 1).alias("unique_near"),
    )


@query(
    "quantiles_by_narrowing",
    union_sql(
        [
            f"SELECT '{c}' AS \"column\", round(quantile_cont({c}::DOUBLE, 0.1), 6) AS q10, "
            f"round(quantile_cont({c}::DOUBLE, 0.5), 6) AS q50, round(quantile_cont({c}::DOUBLE, 0.99), 6) AS q99 FROM {GAPPY}"
            for c in LINEITEM_NUMBERS
        ]
    ),
)
def quantiles_by_narrowing(spark, folder):
    """Quantiles without a shuffle of values."""
    df = gappy_lineitem(spark, folder)
    _, counts = prepare.present_counts(df, list(LINEITEM_NUMBERS))
    found = narrowed_quantiles(df, list(LINEITEM_NUMBERS), [0.1, 0.5, 0.99], counts, limit=1_000)
    rows = [(name, *values) for name, values in found.items()]
    return rounded(spark.createDataFrame(rows, "column string, q10 double, q50 double, q99 double"))


def categorical_sql(columns, source: str) -> str:
    return union_sql(
        [
            f"SELECT '{c}' AS \"column\", (SELECT count(DISTINCT {c}) FROM {source}) AS unique_count, "
            f"v AS top_value, n AS top_freq FROM (SELECT {c} AS v, count(*) AS n FROM {source} "
            f"WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, v LIMIT 1)"
            for c in columns
        ]
    )


@query("categorical_profile", categorical_sql(("l_returnflag", "l_linestatus"), GAPPY))
def categorical_profile(spark, folder):
    return profile.categorical_profile(gappy_lineitem(spark, folder).drop("l_shipdate"))


@query("categorical_profile_part", categorical_sql(("p_name", "p_brand", "p_type"), "part"))
def categorical_profile_part(spark, folder):
    return profile.categorical_profile(table(spark, folder, "part"))


COLUMN_PROFILE_SQL = (
    'SELECT m."column", round(m.pct::DOUBLE, 2) AS missing_pct, p.mean, p.std, p.median, '
    "coalesce(p.unique_count, k.unique_count) AS unique_count, k.top_value, k.top_freq "
    f"FROM ({MISSING_SQL}) m LEFT JOIN ({numeric_sql(LINEITEM_NUMBERS, GAPPY)}) p USING (\"column\") "
    f"LEFT JOIN ({categorical_sql(('l_returnflag', 'l_linestatus'), GAPPY)}) k USING (\"column\") "
    "WHERE m.\"column\" <> 'l_shipdate'"
)


@query("column_profile", COLUMN_PROFILE_SQL)
def column_profile(spark, folder):
    _, columns = profile.profile(gappy_lineitem(spark, folder).drop("l_shipdate"))
    return rounded(
        columns.select("column", "missing_pct", "mean", "std", "median", "unique_count", "top_value", "top_freq"), 7
    )


PROFILED_TABLES = ("lineitem", "orders", "customer", "part", "supplier")


@query(
    "table_summaries",
    union_sql(
        [
            f"SELECT '{t}' AS \"table\", (SELECT count(*) FROM {t}) AS num_rows, "
            f"(SELECT count(*) FROM (DESCRIBE {t}))::INTEGER AS num_cols, "
            f"(SELECT count(*) FROM {t}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})) AS duplicate_count"
            for t in PROFILED_TABLES
        ]
    ),
)
def table_summaries(spark, folder):
    whole = None
    for name in PROFILED_TABLES:
        df = table(spark, folder, name)
        duplicates = profile.duplicate_count(df).first()[0]
        one = profile.table_profile(df).select(
            F.lit(name).alias("table"), "*", F.lit(duplicates).alias("duplicate_count")
        )
        whole = one if whole is None else whole.unionByName(one)
    return whole


# ---------------------------------------------------------------- suggestions

def pearson_sql(columns, source: str) -> str:
    return union_sql(
        [
            f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}::DOUBLE, {b}::DOUBLE), 6) + 0.0 AS r FROM {source}"
            for i, a in enumerate(columns)
            for b in columns[i + 1:]
        ]
    )


@query("correlations", pearson_sql(LINEITEM_NUMBERS, GAPPY))
def correlations(spark, folder):
    return suggest.correlations(gappy_lineitem(spark, folder)).withColumn("r", F.round("r", 6) + F.lit(0.0))


@query(
    "correlations_of_many_columns",
    "SELECT 'e' || a.i AS col_a, 'e' || b.i AS col_b, round(corr(a.v, b.v), 6) + 0.0 AS r "
    "FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) a "
    "JOIN (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) b "
    "ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY ALL",
)
def correlations_of_many_columns(spark, folder):
    return suggest.correlations(embedding_columns(spark, folder).drop("label")).withColumn("r", F.round("r", 6) + F.lit(0.0))


def embedding_columns(spark: SparkSession, folder: str) -> DataFrame:
    """embeddings with one double column e1 .. ed per position."""
    df = table(spark, folder, "embeddings")
    width = df.select(F.max(F.size("embedding"))).first()[0]
    return df.select("label", *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i + 1}") for i in range(width)])


@query(
    "correlation_pairs",
    "SELECT col_a || '_per_' || col_b AS name, 'ratio' AS type, col_a || ',' || col_b AS columns, r AS evidence FROM "
    f"({pearson_sql(('p_partkey', 'p_size', 'p_retailprice', 'gross'), '(SELECT *, 2 * p_retailprice + p_size AS gross FROM part)')}) "
    "WHERE abs(r) >= 0.7",
)
def correlation_pairs(spark, folder):
    df = derive(table(spark, folder, "part"), "gross", "2 * p_retailprice + p_size")
    return flat(suggest.correlation_pairs(df))


def flat(suggestions: DataFrame) -> DataFrame:
    return rounded(suggestions.withColumn("columns", F.concat_ws(",", "columns")))


DATE_SUGGESTIONS = (
    "SELECT c || '_decomposed' AS name, 'datetime_decompose' AS type, c AS columns, 1.0::DOUBLE AS evidence FROM "
    "(SELECT 'ts' AS c UNION ALL SELECT 'day' AS c WHERE (SELECT count(*) = count(try_cast(strftime(ts, '%Y-%m-%d') AS TIMESTAMP)) FROM events) "
    "UNION ALL SELECT 'event_type' AS c WHERE (SELECT count(*) = count(try_cast(event_type AS TIMESTAMP)) FROM events))"
)


def dated_events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "ts", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", "value"
    )


@query("suggest_datetime", DATE_SUGGESTIONS)
def suggest_datetime(spark, folder):
    return flat(suggest.suggest_datetime(dated_events(spark, folder)))


def binning_sql(columns, source: str) -> str:
    return union_sql(
        [
            f"SELECT '{c}_binned' AS name, 'binning' AS type, '{c}' AS columns, count(DISTINCT {c})::DOUBLE AS evidence "
            f"FROM {source} HAVING count(DISTINCT {c}) >= 10"
            for c in columns
        ]
    )


@query("suggest_binning", binning_sql(("p_name", "p_brand", "p_type"), "part"))
def suggest_binning(spark, folder):
    return flat(suggest.suggest_binning(table(spark, folder, "part")))


@query(
    "feature_suggestions",
    f"{DATE_SUGGESTIONS} UNION ALL "
    + binning_sql(("ts", "day", "event_type"), "(SELECT ts, strftime(ts, '%Y-%m-%d') AS day, event_type FROM events)"),
)
def feature_suggestions(spark, folder):
    return flat(suggest.feature_suggestions(dated_events(spark, folder)))


# ---------------------------------------------------------------- target and task

def task_sql(column: str, kind: str, source: str) -> str:
    """Expected row of the task rule; ``kind`` is 'text', 'float' or 'int'."""
    if kind == "text":
        task, confidence = "'classification'", "1.0"
    elif kind == "float":
        small = "u <= 10 AND whole"
        task = f"CASE WHEN {small} THEN 'classification' ELSE 'regression' END"
        confidence = f"CASE WHEN {small} THEN 0.5 ELSE 1.0 END"
    else:
        task = "CASE WHEN u <= 10 THEN 'classification' ELSE 'regression' END"
        confidence = "CASE WHEN u <= 2 THEN 1.0 WHEN u <= 10 THEN 0.5 ELSE 0.95 END"
    whole = "bool_and(v = floor(v))" if kind != "text" else "false"
    return (
        f"SELECT '{column}' AS target_column, {task} AS task_type, ({confidence})::DOUBLE AS confidence, "
        f"({confidence}) < 0.7 AS needs_confirmation FROM "
        f"(SELECT count(DISTINCT v) AS u, {whole} AS whole FROM (SELECT {column} AS v FROM {source}))"
    )


def _task_query(name: str, source: str, column: str, kind: str, prepare_table=None, sql_source: str | None = None) -> None:
    @query(name, task_sql(column, kind, sql_source or source))
    def run(spark, folder):
        df = table(spark, folder, source) if prepare_table is None else prepare_table(spark, folder)
        return detect.detect_task(df, column)


_task_query("detect_task_text", "orders", "o_orderstatus", "text")
_task_query("detect_task_continuous", "lineitem", "l_extendedprice", "float")
_task_query("detect_task_whole_floats", "lineitem", "l_quantity", "float")
_task_query("detect_task_two_integers", "labels", "toxic", "int")
_task_query("detect_task_few_integers", "lineitem", "l_linenumber", "int")
_task_query("detect_task_many_integers", "part", "p_size", "int")


def _lines_with_gaps(spark, folder):
    return table(spark, folder, "lineitem").select(
        F.when(F.col("l_returnflag") != "R", F.col("l_linenumber")).alias("line"), "l_quantity"
    )


_task_query(
    "detect_task_integers_with_gaps", "lineitem", "line", "float", _lines_with_gaps,
    "(SELECT CASE WHEN l_returnflag <> 'R' THEN l_linenumber END AS line FROM lineitem)",
)


@query(
    "detect_task_without_target",
    "SELECT NULL::VARCHAR AS target_column, 'clustering' AS task_type, 1.0::DOUBLE AS confidence, "
    "false AS needs_confirmation FROM (SELECT count(*) FROM customer)",
)
def detect_task_without_target(spark, folder):
    df = table(spark, folder, "customer")
    return detect.detect_task(df, detect.detect_target(df, clustering=True))


@query(
    "detect_task_hint_and_override",
    "SELECT how, target_column, task_type, confidence::DOUBLE AS confidence, false AS needs_confirmation FROM (VALUES "
    "('hint', 'l_linenumber', 'regression', 0.8), ('override', 'l_linenumber', 'regression', 1.0)) "
    "AS t(how, target_column, task_type, confidence), (SELECT count(*) FROM lineitem)",
)
def detect_task_hint_and_override(spark, folder):
    df = table(spark, folder, "lineitem")
    hint = detect.detect_task(df, "l_linenumber", task_hint="regression").select(F.lit("hint").alias("how"), "*")
    override = detect.detect_task(df, "l_linenumber", override="regression").select(F.lit("override").alias("how"), "*")
    return hint.unionByName(override)


@query(
    "detect_target",
    union_sql(
        [
            f"SELECT '{name}' AS \"table\", '{column}' AS target_column, count(DISTINCT {column}) AS n_values FROM {name}"
            for name, column in (("embeddings", "label"), ("orders", "o_orderpriority"), ("part", "p_size"))
        ]
    ),
)
def detect_target(spark, folder):
    """A known name, the last column, and a loosely written name; with the values of what was found."""
    found = None
    for name, columns, hint in (("embeddings", ("label", "vec_id"), None), ("orders", ("*",), None), ("part", ("*",), "SIZE")):
        df = table(spark, folder, name).select(*columns)
        target = detect.detect_target(df, hint) if hint else detect.detect_target(df)
        values = df.agg(F.lit(name).alias("table"), F.lit(target).alias("target_column"), F.count_distinct(target).alias("n_values"))
        found = values if found is None else found.unionByName(values)
    return found


def balance_sql(column: str, source: str) -> str:
    return (
        f"SELECT {column}::VARCHAR AS label, count(*) AS n, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 4) AS share, "
        "count(*) = max(count(*)) OVER () AS is_majority, count(*) = min(count(*)) OVER () AS is_minority "
        f"FROM {source} WHERE {column} IS NOT NULL GROUP BY {column}"
    )


@query("class_balance", balance_sql("o_orderstatus", "orders"))
def class_balance(spark, folder):
    return detect.class_balance(table(spark, folder, "orders"), "o_orderstatus")


@query("class_balance_with_gaps", balance_sql("l_returnflag", GAPPY))
def class_balance_with_gaps(spark, folder):
    return detect.class_balance(gappy_lineitem(spark, folder), "l_returnflag")


@query(
    "is_imbalanced",
    f"SELECT min(share) AS minority_share, min(share) < 0.10 AS imbalanced FROM ({balance_sql('toxic', 'labels')})",
)
def is_imbalanced(spark, folder):
    return detect.is_imbalanced(detect.class_balance(table(spark, folder, "labels"), "toxic"))


# ---------------------------------------------------------------- derived features

@query(
    "decompose_datetime",
    "SELECT o_orderkey, year(o_orderdate)::INTEGER AS o_orderdate_year, month(o_orderdate)::INTEGER AS o_orderdate_month, "
    "day(o_orderdate)::INTEGER AS o_orderdate_day, (isodow(o_orderdate) - 1)::INTEGER AS o_orderdate_weekday FROM orders",
)
def decompose_datetime(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    return features.decompose_datetime(df, "o_orderdate").drop("o_orderdate")


@query(
    "decompose_datetime_text",
    "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN year(o_orderdate) END::INTEGER AS day_year, "
    "CASE WHEN o_orderstatus <> 'F' THEN month(o_orderdate) END::INTEGER AS day_month, "
    "CASE WHEN o_orderstatus <> 'F' THEN day(o_orderdate) END::INTEGER AS day_day, "
    "CASE WHEN o_orderstatus <> 'F' THEN isodow(o_orderdate) - 1 END::INTEGER AS day_weekday FROM orders",
)
def decompose_datetime_text(spark, folder):
    """Dates as text, some of it unreadable."""
    text = F.when(F.col("o_orderstatus") != "F", F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise("unknown")
    df = table(spark, folder, "orders").select("o_orderkey", text.alias("day"))
    return features.decompose_datetime(df, "day").drop("day")


@query(
    "ratio",
    "SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_tax = 0 THEN NULL ELSE l_discount / l_tax END, 6) AS r FROM lineitem",
)
def ratio(spark, folder):
    df = features.ratio(table(spark, folder, "lineitem"), "l_discount", "l_tax", "r")
    return rounded(df.select("l_orderkey", "l_linenumber", "l_partkey", "r"))


@query(
    "ratio_ieee",
    "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN l_tax <> 0 THEN 'number' WHEN l_discount = 0 THEN 'nan' ELSE 'inf' END AS kind FROM lineitem) GROUP BY kind",
)
def ratio_ieee(spark, folder):
    df = features.ratio(table(spark, folder, "lineitem"), "l_discount", "l_tax", "r", on_zero="ieee")
    kind = F.when(F.isnan("r"), "nan").when(F.col("r") == float("inf"), "inf").otherwise("number")
    return df.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "product",
    "SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity * l_discount, 6) AS p FROM lineitem",
)
def product(spark, folder):
    df = features.product(table(spark, folder, "lineitem"), "l_quantity", "l_discount", "p")
    return rounded(df.select("l_orderkey", "l_linenumber", "l_partkey", "p"))


def binning_values_sql(column: str, key: str, source: str) -> str:
    """Quantile bins of the value's rank, null being rank -1, with equal edges counted once."""
    return (
        f"WITH coded AS (SELECT {key}, CASE WHEN {column} IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY {column} NULLS LAST) - 1 END AS code FROM {source}), "
        "shape AS (SELECT least(10, count(DISTINCT CASE WHEN code >= 0 THEN code END)) AS q FROM coded), "
        "sorted AS (SELECT code, row_number() OVER (ORDER BY code) - 1 AS pos FROM coded), "
        "places AS (SELECT ((SELECT count(*) FROM coded) - 1) * (k / (SELECT q FROM shape)::DOUBLE) AS p FROM range(0, 11) AS r(k) WHERE k <= (SELECT q FROM shape)), "
        "edges AS (SELECT DISTINCT a.code + (b.code - a.code) * (p - floor(p)) AS e FROM places JOIN sorted a ON a.pos = floor(p) JOIN sorted b ON b.pos = ceil(p)) "
        f"SELECT {key}, greatest(0, (SELECT count(*) FROM edges WHERE e < code) - 1)::INTEGER AS bin FROM coded"
    )


@query("bin_categorical", binning_values_sql("p_brand", "p_partkey", "part"))
def bin_categorical(spark, folder):
    df = features.bin_categorical(table(spark, folder, "part"), "p_brand", name="bin")
    return df.select("p_partkey", "bin")


@query(
    "bin_categorical_with_nulls",
    binning_values_sql("c_name", "c_custkey", "(SELECT c_custkey, CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_name END AS c_name FROM customer)"),
)
def bin_categorical_with_nulls(spark, folder):
    name = F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_name"))
    df = table(spark, folder, "customer").select("c_custkey", name.alias("c_name"))
    return features.bin_categorical(df, "c_name", name="bin").select("c_custkey", "bin")


@query(
    "derive_formula",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * (1 - l_discount) / (l_quantity + 1) - -2 AS net FROM lineitem",
)
def derive_formula(spark, folder):
    df = derive(table(spark, folder, "lineitem"), "net", "l_extendedprice * (1 - l_discount) / (l_quantity + 1) - -2")
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "net")


@query(
    "apply_features",
    "SELECT o_orderkey, year(o_orderdate)::INTEGER AS o_orderdate_year, round(o_totalprice / 1000.0, 6) AS thousands FROM orders",
)
def apply_features(spark, folder):
    """A suggestion, an unknown name, a formula, an unsafe formula and a name already taken."""
    df = table(spark, folder, "orders")
    made, _, _ = features.apply_features(
        df, suggest.suggest_datetime(df), ["o_orderdate_decomposed", "no_such_suggestion"],
        [
            {"name": "thousands", "formula": "o_totalprice / 1000"},
            {"name": "unsafe", "formula": "__import__('os')"},
            {"name": "o_custkey", "formula": "1 + 1"},
        ],
    )
    return rounded(made.select("o_orderkey", "o_orderdate_year", "thousands"))


@query(
    "apply_features_log",
    "SELECT * FROM (VALUES ('no_such_suggestion', 'skip', 'suggested'), ('o_orderdate_day', 'create', 'suggested'), "
    "('o_orderdate_month', 'create', 'suggested'), ('o_orderdate_weekday', 'create', 'suggested'), "
    "('o_orderdate_year', 'create', 'suggested'), ('thousands', 'create', 'custom'), ('unsafe', 'skip', 'custom'), "
    "('o_custkey', 'skip', 'custom')) AS t(\"column\", operation, source)",
)
def apply_features_log(spark, folder):
    df = table(spark, folder, "orders")
    _, log, _ = features.apply_features(
        df, suggest.suggest_datetime(df), ["o_orderdate_decomposed", "no_such_suggestion"],
        [
            {"name": "thousands", "formula": "o_totalprice / 1000"},
            {"name": "unsafe", "formula": "__import__('os')"},
            {"name": "o_custkey", "formula": "1 + 1"},
        ],
    )
    return spark.createDataFrame(log, features.LOG_SCHEMA).drop("details")


# ---------------------------------------------------------------- cleaning, encoding, scaling

@query("deduplicate", "SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders")
def deduplicate(spark, folder):
    return prepare.deduplicate(table(spark, folder, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority"))


@query("drop_all_missing", "SELECT s_suppkey, s_nationkey FROM supplier")
def drop_all_missing(spark, folder):
    df = table(spark, folder, "supplier").select(
        "s_suppkey", "s_nationkey", F.when(F.col("s_suppkey") < 0, F.col("s_name")).alias("empty_text"),
        F.when(F.col("s_suppkey") < 0, F.col("s_acctbal")).alias("empty_number"),
    )
    return prepare.drop_all_missing(df)


@query("drop_high_cardinality", "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def drop_high_cardinality(spark, folder):
    return prepare.drop_high_cardinality(table(spark, folder, "customer"))


KEYS = "l_orderkey, l_linenumber, l_partkey"


@query(
    "impute_median",
    f"SELECT {KEYS}, round(coalesce(l_tax, (SELECT median(l_tax) FROM {GAPPY})), 6) AS l_tax, "
    f"round(coalesce(l_discount, (SELECT median(l_discount) FROM {GAPPY})), 6) AS l_discount FROM {GAPPY}",
)
def impute_median(spark, folder):
    df = prepare.impute_median(gappy_lineitem(spark, folder), ["l_tax", "l_discount"])
    return rounded(df.select("l_orderkey", "l_linenumber", "l_partkey", "l_tax", "l_discount"))


@query(
    "impute_mode",
    f"SELECT {KEYS}, coalesce(l_returnflag, (SELECT l_returnflag FROM {GAPPY} WHERE l_returnflag IS NOT NULL "
    f"GROUP BY l_returnflag ORDER BY count(*) DESC, l_returnflag LIMIT 1)) AS l_returnflag FROM {GAPPY}",
)
def impute_mode(spark, folder):
    df = prepare.impute_mode(gappy_lineitem(spark, folder), ["l_returnflag"])
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")


@query(
    "standard_scale",
    "SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem), 6) AS l_quantity, "
    "round((l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem)) / (SELECT stddev_pop(l_extendedprice) FROM lineitem), 6) AS l_extendedprice, "
    "0.0::DOUBLE AS constant FROM lineitem",
)
def standard_scale(spark, folder):
    df = table(spark, folder, "lineitem").withColumn("constant", F.lit(3.0))
    scaled = prepare.standard_scale(df, ["l_quantity", "l_extendedprice", "constant"])
    return rounded(scaled.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "constant"))


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query(
    "one_hot",
    "SELECT o_orderkey, "
    + ", ".join(f"(o_orderpriority = '{p}')::INTEGER::DOUBLE AS \"o_orderpriority_{p}\"" for p in PRIORITIES)
    + ", " + ", ".join(f"(o_orderstatus = '{s}')::INTEGER::DOUBLE AS o_orderstatus_{s}" for s in "FOP")
    + " FROM orders",
)
def one_hot(spark, folder):
    return prepare.one_hot(table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"))


def scaled_sql(column: str, source: str) -> str:
    filled = f"coalesce({column}, (SELECT median({column}) FROM {source}))"
    return (
        f"round(({filled} - (SELECT avg({filled}) FROM {source})) / (SELECT stddev_pop({filled}) FROM {source}), 6)"
    )


CLEAN = f"(SELECT DISTINCT l_quantity, l_discount, l_tax, l_returnflag, l_linestatus FROM {GAPPY})"


@query(
    "preprocess",
    f"WITH clean AS {CLEAN} SELECT {scaled_sql('l_quantity', 'clean')} AS l_quantity, {scaled_sql('l_discount', 'clean')} AS l_discount, "
    f"{scaled_sql('l_tax', 'clean')} AS l_tax, "
    + ", ".join(
        f"(coalesce(l_returnflag, (SELECT l_returnflag FROM clean WHERE l_returnflag IS NOT NULL GROUP BY 1 "
        f"ORDER BY count(*) DESC, 1 LIMIT 1)) = '{v}')::INTEGER::DOUBLE AS l_returnflag_{v}" for v in "ANR"
    )
    + ", l_linestatus FROM clean",
)
def preprocess(spark, folder):
    df = gappy_lineitem(spark, folder).select("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    return rounded(prepare.preprocess(df, "l_linestatus").df)


ORDER_LINES = (
    "(SELECT DISTINCT l_orderkey::VARCHAR AS k, l_returnflag AS f, CASE WHEN l_linenumber > 1 THEN l_quantity END AS q, "
    "l_orderkey * 10 + l_linenumber AS t FROM lineitem)"
)


@query(
    "encode_many_levels",
    f"WITH d AS {ORDER_LINES}, lk AS (SELECT k, row_number() OVER (ORDER BY k) AS at, count(*) OVER () AS n FROM (SELECT DISTINCT k FROM d)), "
    "lf AS (SELECT f, row_number() OVER (ORDER BY f) AS at FROM (SELECT DISTINCT f FROM d)) "
    f"SELECT t, (1 + lk.n + (SELECT count(*) FROM lf))::BIGINT AS width, {scaled_sql('q', 'd')} AS q, lk.at::BIGINT AS at_k, "
    "(lk.n + lf.at)::BIGINT AS at_f FROM d JOIN lk USING (k) JOIN lf USING (f)",
)
def encode_many_levels(spark, folder):
    """Every order a level: size of the sparse vectors, the scaled number, and the two positions that are set."""
    df = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("k"), F.col("l_returnflag").alias("f"),
        F.when(F.col("l_linenumber") > 1, F.col("l_quantity")).alias("q"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("t"),
    )
    prepared = prepare.preprocess(df, "t", "regression", encoding="vector")
    rows = prepared.df.select("t", F.unwrap_udt("features").alias("v"))
    return rounded(
        rows.selectExpr(
            "t", "bigint(v.size) as width", "v.values[0] as q", "bigint(v.indices[1]) as at_k", "bigint(v.indices[2]) as at_f"
        )
    )


@query(
    "preprocess_log",
    "SELECT * FROM (VALUES ('c_name', 'drop'), ('c_custkey', 'scale'), ('c_nationkey', 'scale'), ('c_acctbal', 'scale')) AS t(\"column\", operation)",
)
def preprocess_log(spark, folder):
    return prepare.preprocess(table(spark, folder, "customer"), "c_mktsegment").log.drop("details")


@query(
    "preprocess_for_clustering",
    "SELECT count(*) AS n_rows, true AS narrower, 0.0::DOUBLE AS cross FROM (SELECT DISTINCT embedding FROM embeddings)",
)
def preprocess_for_clustering(spark, folder):
    """Distinct rows, fewer columns than the inputs, and components that do not overlap."""
    inputs = embedding_columns(spark, folder).drop("label")
    prepared = prepare.preprocess(inputs, task="clustering")
    return _components(prepared.df, prepared.feature_cols, len(inputs.columns))


def _components(df: DataFrame, names: list[str], inputs: int) -> DataFrame:
    """Rows, whether there are fewer components than inputs, and the greatest cosine of a component and the next."""
    pairs = list(zip(names[1:], names[:-1], strict=True))
    cross = F.greatest(
        F.lit(0.0), F.lit(0.0), *[F.abs(F.sum(F.col(a) * F.col(b))) / F.sqrt(F.sum(F.col(a) ** 2) * F.sum(F.col(b) ** 2)) for a, b in pairs]
    )
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(len(names) < inputs).alias("narrower"), (F.round(cross, 5) + 0.0).alias("cross")
    )


@query("reduce_dims_svd", "SELECT count(*) AS n_rows, true AS narrower, 0.0::DOUBLE AS cross FROM embeddings")
def reduce_dims_svd(spark, folder):
    df = embedding_columns(spark, folder)
    found = reduce.reduce_dims(df, [c for c in df.columns if c != "label"], "svd", 5)
    return _components(found, [c for c in found.columns if c != "label"], len(df.columns) - 1)


@query(
    "reduce_dims_pca_variance",
    "SELECT 'total' AS what, round(sum(v), 4) AS variance FROM (SELECT var_samp(v) AS v FROM "
    "(SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i)",
)
def reduce_dims_pca_variance(spark, folder):
    """Components and the dropped remainder together hold the variance of the inputs."""
    df = embedding_columns(spark, folder).drop("label")
    fit = reduce.fit_projection(df, df.columns, "pca", len(df.columns) - 1)
    kept = fit.apply(df).agg(*[F.var_samp(n).alias(n) for n in fit.names])
    total = sum((F.col(n) for n in fit.names[1:]), F.col(fit.names[0])) / F.lit(fit.explained)
    return kept.select(F.lit("total").alias("what"), F.round(total, 4).alias("variance"))


# ---------------------------------------------------------------- split and weights

LINEITEM_TEXT = (
    "concat_ws('|', l_orderkey::VARCHAR, l_partkey::VARCHAR, l_linenumber::VARCHAR, (l_quantity::DECIMAL(18,4))::VARCHAR, "
    "(l_extendedprice::DECIMAL(18,4))::VARCHAR, l_returnflag, l_shipdate::VARCHAR, '42')"
)


def hashed_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", F.col("l_quantity").cast("decimal(18,4)").alias("l_quantity"),
        F.col("l_extendedprice").cast("decimal(18,4)").alias("l_extendedprice"), "l_returnflag", "l_shipdate",
    )


def split_sql(partition: str) -> str:
    return (
        f"SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, row_number() OVER ({partition} ORDER BY md5({LINEITEM_TEXT})) "
        f"<= ceil(0.25 * count(*) OVER ({partition})) AS is_test FROM lineitem"
    )


@query("train_test_split", split_sql("PARTITION BY l_returnflag"))
def train_test_split(spark, folder):
    done = split.train_test_split(hashed_lineitem(spark, folder), by="l_returnflag", method="md5")
    return done.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "is_test")


@query("train_test_split_unstratified", split_sql(""))
def train_test_split_unstratified(spark, folder):
    """With a small limit, so that the cut is refined over several hash prefixes."""
    done = split.train_test_split(hashed_lineitem(spark, folder), limit=2, method="md5")
    return done.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "is_test")


@query(
    "train_test_split_sizes",
    "SELECT l_returnflag, ceil(0.25 * count(*))::BIGINT AS test_rows, count(*) AS all_rows FROM lineitem GROUP BY l_returnflag",
)
def train_test_split_sizes(spark, folder):
    """The default hash, over all columns as they are."""
    done = split.train_test_split(table(spark, folder, "lineitem"), by="l_returnflag")
    return done.groupBy("l_returnflag").agg(F.count_if(F.col("is_test")).alias("test_rows"), F.count(F.lit(1)).alias("all_rows"))


@query(
    "train_test_split_null_class",
    "SELECT CASE WHEN c_nationkey < 8 THEN 'null' WHEN c_nationkey < 16 THEN 'mark' ELSE 'text' END AS kind, "
    "ceil(0.25 * count(*))::BIGINT AS test_rows, count(*) AS all_rows FROM customer GROUP BY 1",
)
def train_test_split_null_class(spark, folder):
    """A class of nulls beside one whose text is the usual mark of null."""
    nation = F.col("c_nationkey")
    df = table(spark, folder, "customer").withColumn(
        "c_class", F.when(nation < 8, None).when(nation < 16, F.lit("\\N")).otherwise(F.lit("x"))
    )
    kind = F.when(F.col("c_class").isNull(), "null").when(nation < 16, "mark").otherwise("text")
    done = split.train_test_split(df, by="c_class")
    return done.groupBy(kind.alias("kind")).agg(F.count_if("is_test").alias("test_rows"), F.count(F.lit(1)).alias("all_rows"))


@query(
    "balanced_weights",
    "SELECT doc_id, quality, (SELECT count(*) FROM labels)::DOUBLE / ((SELECT count(DISTINCT quality) FROM labels) * "
    "count(*) OVER (PARTITION BY quality)) AS weight FROM labels",
)
def balanced_weights(spark, folder):
    return split.balanced_weights(table(spark, folder, "labels").select("doc_id", "quality"), "quality")


@query(
    "positive_weight",
    "SELECT CASE WHEN count(*) = 2 THEN max(n)::DOUBLE / min(n) END AS positive_weight FROM (SELECT toxic, count(*) AS n FROM labels GROUP BY toxic)",
)
def positive_weight(spark, folder):
    return split.positive_weight(table(spark, folder, "labels"), "toxic")


# ---------------------------------------------------------------- metrics

def flag_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A rule's guess of 'R' against the truth, two classes."""
    return table(spark, folder, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        (F.col("l_quantity") > 25).cast("int").alias("p"),
        F.round(F.col("l_extendedprice") * F.col("l_discount"), 0).alias("score"),
    )


FLAGS = (
    "(SELECT (l_returnflag = 'R')::INTEGER AS y, (l_quantity > 25)::INTEGER AS p, "
    "round(l_extendedprice * l_discount, 0) AS score FROM lineitem)"
)


@query(
    "classification_metrics_binary",
    "SELECT round(avg((y = p)::INTEGER), 6) AS accuracy, round(2.0 * sum(y * p) / (sum(y) + sum(p)), 6)::DOUBLE AS f1, "
    f"round(sum(y * p) / sum(p)::DOUBLE, 6) AS precision, round(sum(y * p) / sum(y)::DOUBLE, 6) AS recall FROM {FLAGS}",
)
def classification_metrics_binary(spark, folder):
    return rounded(metrics.classification_metrics(flag_rows(spark, folder), "y", "p"))


@query(
    "average_precision",
    "SELECT round(sum(hits::DOUBLE * hits_upto / rows_upto) / sum(hits), 6) AS pr_auc FROM (SELECT hits, "
    "sum(hits) OVER (ORDER BY score DESC) AS hits_upto, sum(n) OVER (ORDER BY score DESC) AS rows_upto FROM "
    f"(SELECT score, sum(y) AS hits, count(*) AS n FROM {FLAGS} GROUP BY score))",
)
def average_precision(spark, folder):
    return rounded(metrics.average_precision(flag_rows(spark, folder), "y", "score"))


MACRO = (
    "(SELECT l_returnflag AS y, CASE WHEN l_quantity < 15 THEN 'A' WHEN l_quantity < 35 THEN 'N' ELSE 'R' END AS p FROM lineitem)"
)


@query(
    "classification_metrics_macro",
    f"WITH d AS {MACRO}, c AS (SELECT y AS k FROM d UNION SELECT p FROM d), s AS (SELECT k, "
    "(SELECT count(*) FROM d WHERE y = k AND p = k) AS hit, (SELECT count(*) FROM d WHERE y = k) AS act, "
    "(SELECT count(*) FROM d WHERE p = k) AS pred FROM c) SELECT (SELECT round(avg((y = p)::INTEGER), 6) FROM d) AS accuracy, "
    "round(avg(2.0 * hit / (act + pred))::DOUBLE, 6) AS f1, round(avg(CASE WHEN pred = 0 THEN 0 ELSE hit::DOUBLE / pred END), 6) AS precision, "
    "round(avg(CASE WHEN act = 0 THEN 0 ELSE hit::DOUBLE / act END), 6) AS recall FROM s",
)
def classification_metrics_macro(spark, folder):
    q = F.col("l_quantity")
    df = table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("y"), F.when(q < 15, "A").when(q < 35, "N").otherwise("R").alias("p")
    )
    return rounded(metrics.classification_metrics(df, "y", "p"))


@query(
    "regression_metrics",
    "SELECT round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae, "
    "round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2 FROM (SELECT l_extendedprice AS y, 1500 * l_quantity AS p FROM lineitem)",
)
def regression_metrics(spark, folder):
    df = table(spark, folder, "lineitem").select(
        F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p")
    )
    return metrics.regression_metrics(df, "y", "p").select(
        F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2")
    )


@query(
    "cluster_counts",
    "SELECT count(DISTINCT CASE WHEN c <> -1 THEN c END) AS n_clusters, count(CASE WHEN c = -1 THEN 1 END) AS n_noise FROM "
    "(SELECT CASE WHEN l_returnflag = 'N' THEN -1 ELSE l_linenumber END AS c FROM lineitem)",
)
def cluster_counts(spark, folder):
    c = F.when(F.col("l_returnflag") == "N", -1).otherwise(F.col("l_linenumber"))
    return metrics.cluster_counts(table(spark, folder, "lineitem").select(c.alias("c")), "c")


def silhouette_sql(distance: str, source: str) -> str:
    return (
        f"WITH d AS (SELECT a.id, a.k AS own, b.k AS k, sum({distance}) AS total, "
        f"count(*) AS n FROM {source} a, {source} b GROUP BY a.id, a.k, b.k), "
        "m AS (SELECT id, max(CASE WHEN k = own THEN n END) AS own_n, "
        "max(CASE WHEN k = own THEN total / nullif(n - 1, 0) END) AS a, "
        "min(CASE WHEN k <> own THEN total / n END) AS b FROM d GROUP BY id) "
        "SELECT round(avg(CASE WHEN own_n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM m"
    )


@query(
    "silhouette",
    silhouette_sql(
        "list_distance(a.e, b.e)",
        "(SELECT vec_id AS id, label AS k, embedding::DOUBLE[] AS e FROM embeddings)",
    ),
)
def silhouette_exact(spark, folder):
    return rounded(silhouette(table(spark, folder, "embeddings"), ["embedding"], "label", block=128))


@query(
    "silhouette_of_columns",
    silhouette_sql(
        "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))",
        "(SELECT s_suppkey AS id, CASE WHEN s_acctbal > 5000 THEN 1 ELSE 0 END AS k, s_nationkey::DOUBLE AS x, s_acctbal / 100.0 AS y FROM supplier)",
    ),
)
def silhouette_of_columns(spark, folder):
    df = table(spark, folder, "supplier").select(
        F.when(F.col("s_acctbal") > 5000, 1).otherwise(0).alias("k"),
        F.col("s_nationkey").cast("double").alias("x"), (F.col("s_acctbal") / 100.0).alias("y"),
    )
    return rounded(silhouette(df, ["x", "y"], "k"))


@query(
    "silhouette_squared",
    silhouette_sql(
        "power(list_distance(a.e, b.e), 2)",
        "(SELECT vec_id AS id, label AS k, embedding::DOUBLE[] AS e FROM embeddings)",
    ),
)
def silhouette_squared(spark, folder):
    return rounded(silhouette(table(spark, folder, "embeddings"), ["embedding"], "label", method="squared"))


# ---------------------------------------------------------------- ranking

def supplier_records(spark: SparkSession, folder: str) -> DataFrame:
    """One record per supplier, made of its line items: ties, NaN, missing metrics and failures occur."""
    per = table(spark, folder, "lineitem").groupBy("l_suppkey").agg(
        F.round(F.avg("l_discount"), 3).alias("a"), F.round(F.avg("l_tax"), 3).alias("b"),
        F.round(F.avg("l_quantity"), 1).alias("c"), F.count(F.lit(1)).alias("n"),
    )
    nan = F.lit(float("nan"))
    shown = F.map_from_arrays(
        F.array(*[F.lit(m) for m in ("f1", "precision", "accuracy", "r2", "rmse", "mae")]),
        F.array(
            F.when(F.col("c") < 25, nan).otherwise(F.col("a")), F.col("b"), F.col("a") + F.col("b"),
            F.when(F.col("c") > 26, nan).otherwise(F.col("b")), F.col("c"), F.col("a"),
        ),
    )
    ok = F.col("b") < 0.042
    name = F.concat(F.lit("m"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0"))
    return per.select(
        name.alias("model_id"), name.alias("model_name"), F.lit("group").alias("family"),
        F.create_map(F.lit("rows"), F.col("n").cast("string")).alias("params"), F.lit("classification").alias("task_type"),
        ok.alias("success"), F.when(~ok, "Rejected").alias("error_type"), F.when(~ok, "tax too high").alias("error_message"),
        shown.alias("metrics"), (F.col("n") / 10.0).alias("runtime_seconds"), F.col("n").alias("n_train_samples"),
        F.lit(0).cast("bigint").alias("n_test_samples"),
    )


RECORDS = (
    "(SELECT 'm' || lpad(l_suppkey::VARCHAR, 6, '0') AS model_name, round(avg(l_discount), 3) AS a, round(avg(l_tax), 3) AS b, "
    "round(avg(l_quantity), 1) AS c, count(*) AS n FROM lineitem GROUP BY l_suppkey)"
)
RANK_F1 = (
    "SELECT row_number() OVER (ORDER BY f1 DESC, precision DESC, model_name)::INTEGER AS rank, model_name, f1, precision, a + b AS accuracy, n FROM "
    f"(SELECT *, CASE WHEN c < 25 THEN '-Infinity'::DOUBLE ELSE a END AS f1, b AS precision FROM {RECORDS} WHERE b < 0.042)"
)


@query(
    "rank_results",
    f"SELECT rank, model_name AS model_id, model_name, 'f1' AS primary_metric, f1 AS primary_value, precision AS tiebreaker_value, n / 10.0::DOUBLE AS runtime_seconds FROM ({RANK_F1})",
)
def rank_results(spark, folder):
    return rank.rank_results(supplier_records(spark, folder), "classification").drop("metrics")


@query(
    "rank_results_lower_is_better",
    "SELECT row_number() OVER (ORDER BY r2 DESC, c, model_name)::INTEGER AS rank, model_name, r2 AS primary_value, c AS tiebreaker_value FROM "
    f"(SELECT *, CASE WHEN c > 26 THEN '-Infinity'::DOUBLE ELSE b END AS r2 FROM {RECORDS} WHERE b < 0.042)",
)
def rank_results_lower_is_better(spark, folder):
    return rank.rank_results(supplier_records(spark, folder), "regression").select(
        "rank", "model_name", "primary_value", "tiebreaker_value"
    )


@query(
    "leaderboard_top3",
    f"SELECT rank, model_name, f1, round(accuracy, 6) AS accuracy, precision, NULL::DOUBLE AS recall, NULL::DOUBLE AS pr_auc, n / 10.0::DOUBLE AS runtime_seconds FROM ({RANK_F1}) WHERE rank <= 3",
)
def leaderboard_top3(spark, folder):
    return rounded(rank.leaderboard(supplier_records(spark, folder), "classification", 3))


@query(
    "best_model",
    f"SELECT (SELECT model_name FROM ({RANK_F1}) WHERE rank = 1) AS best_model_id, false AS overridden",
)
def best_model(spark, folder):
    return rank.best_model(rank.rank_results(supplier_records(spark, folder), "classification"))


@query(
    "best_model_without_success",
    "SELECT 'none' AS best_model_id, false AS overridden FROM (SELECT count(*) FROM lineitem)",
)
def best_model_without_success(spark, folder):
    failed = supplier_records(spark, folder).withColumn("success", F.lit(False))
    return rank.best_model(rank.rank_results(failed, "classification"))


@query("best_model_override", "SELECT 'm000003' AS best_model_id, true AS overridden FROM (SELECT count(*) FROM lineitem)")
def best_model_override(spark, folder):
    return rank.best_model(rank.rank_results(supplier_records(spark, folder), "classification"), "m000003")


@query(
    "best_record",
    f"SELECT r.model_name, r.n AS n_train_samples FROM {RECORDS} r WHERE model_name = (SELECT model_name FROM ({RANK_F1}) WHERE rank = 1)",
)
def best_record(spark, folder):
    records = supplier_records(spark, folder)
    winner = rank.best_model(rank.rank_results(records, "classification")).first().best_model_id
    return rank.best_record(records, winner).select("model_name", "n_train_samples")


@query(
    "experiment_summary",
    "SELECT count(*) AS n_run, count(CASE WHEN b < 0.042 THEN 1 END) AS n_ok, count(CASE WHEN b >= 0.042 THEN 1 END) AS n_failed, "
    f"round(sum(n / 10.0)::DOUBLE, 4) AS total_runtime_seconds FROM {RECORDS}",
)
def experiment_summary(spark, folder):
    return rounded(rank.experiment_summary(supplier_records(spark, folder)), 4)


@query(
    "failures",
    f"SELECT model_name, 'Rejected' AS error_type, 'tax too high' AS error_message FROM {RECORDS} WHERE b >= 0.042",
)
def failures(spark, folder):
    return rank.failures(supplier_records(spark, folder))


# ---------------------------------------------------------------- models with an SQL form

def segment_fold(spark, folder) -> Fold:
    done = split.train_test_split(customer_rows(spark, folder), by="c_mktsegment", method="md5")
    return _fold(done, ["c_nationkey", "c_acctbal"], "seg")


def balance_fold(spark, folder, inputs=("c_nationkey", "seg")) -> Fold:
    done = split.train_test_split(customer_rows(spark, folder), by="c_mktsegment", method="md5")
    return _fold(done, list(inputs), "c_acctbal")


def _fold(done: DataFrame, inputs: list[str], label: str) -> Fold:
    """A fold of the customer split whose ids are the customer keys."""
    segments = sorted(r[0] for r in done.select("c_mktsegment").distinct().collect())
    numbers = F.array(*[F.lit(s) for s in segments])
    rows = vector_rows(
        done.withColumn("seg", (F.array_position(numbers, F.col("c_mktsegment")) - 1).cast("double"))
        .withColumn("label", F.col(label).cast("double")).withColumnRenamed("c_custkey", "id"),
        inputs, "id", "label", "is_test",
    )
    train, test = rows.filter("not is_test").drop("is_test"), rows.filter("is_test").drop("is_test")
    per_class = [0] * len(segments)
    if label == "seg":
        for r in train.groupBy("label").count().collect():
            per_class[int(r.label)] = r["count"]
    return Fold(
        train, test, train.count(), test.count(), len(inputs), segments if label == "seg" else [],
        per_class if label == "seg" else [],
    )


@query(
    "baseline_classifier",
    f"WITH s AS {CUSTOMER_SPLIT} SELECT c_custkey, (SELECT seg FROM s WHERE NOT is_test GROUP BY seg ORDER BY count(*) DESC, seg LIMIT 1)::DOUBLE AS prediction FROM s WHERE is_test",
)
def baseline_classifier(spark, folder):
    out, _ = classification.majority(segment_fold(spark, folder))
    return out.select(F.col("id").alias("c_custkey"), "prediction")


@query(
    "baseline_regressor",
    f"WITH s AS {CUSTOMER_SPLIT} SELECT c_custkey, round((SELECT avg(c_acctbal) FROM s WHERE NOT is_test), 4) AS prediction FROM s WHERE is_test",
)
def baseline_regressor(spark, folder):
    out, _ = regression.mean_baseline(balance_fold(spark, folder))
    return rounded(out.select(F.col("id").alias("c_custkey"), "prediction"), 4)


def neighbours_sql(distance: str, label: str) -> str:
    return (
        f"WITH s AS {CUSTOMER_SPLIT}, near AS (SELECT q.c_custkey, t.{label} AS label, "
        f"row_number() OVER (PARTITION BY q.c_custkey ORDER BY {distance}, t.{label}) AS place "
        "FROM s q, s t WHERE q.is_test AND NOT t.is_test) "
    )


@query(
    "knn_classifier",
    neighbours_sql(
        "(q.c_nationkey - t.c_nationkey) * (q.c_nationkey - t.c_nationkey) + (q.c_acctbal - t.c_acctbal) * (q.c_acctbal - t.c_acctbal)", "seg"
    )
    + "SELECT c_custkey, label::DOUBLE AS prediction FROM (SELECT c_custkey, label, row_number() OVER (PARTITION BY c_custkey "
    "ORDER BY count(*) DESC, label) AS place FROM near WHERE place <= 5 GROUP BY c_custkey, label) WHERE place = 1",
)
def knn_classifier(spark, folder):
    fold = segment_fold(spark, folder)
    found = vote(nearest(fold.train, "label", fold.test, "id", ["x"], k=5))
    return found.select(F.col("qid").alias("c_custkey"), "prediction")


@query(
    "knn_regressor",
    neighbours_sql(
        "(q.c_nationkey - t.c_nationkey) * (q.c_nationkey - t.c_nationkey) + (q.seg - t.seg) * (q.seg - t.seg)", "c_acctbal"
    )
    + "SELECT c_custkey, round(avg(label), 4) AS prediction FROM near WHERE place <= 5 GROUP BY c_custkey",
)
def knn_regressor(spark, folder):
    fold = balance_fold(spark, folder)
    found = mean_label(nearest(fold.train, "label", fold.test, "id", ["x"], k=5))
    return rounded(found.select(F.col("qid").alias("c_custkey"), "prediction"), 4)


def line_sql(penalty: float) -> str:
    return (
        f"WITH s AS {CUSTOMER_SPLIT}, f AS (SELECT avg(c_nationkey) AS mx, avg(c_acctbal) AS my, "
        "covar_pop(c_acctbal, c_nationkey) * count(*) AS sxy, var_pop(c_nationkey) * count(*) AS sxx FROM s WHERE NOT is_test) "
        f"SELECT c_custkey, round(my + sxy / (sxx + {penalty}) * (c_nationkey - mx), 4) AS prediction FROM s, f WHERE is_test"
    )


@query("linear_regression", line_sql(0.0))
def linear_regression(spark, folder):
    out, _ = regression.least_squares(balance_fold(spark, folder, ["c_nationkey"]))
    return rounded(out.select(F.col("id").alias("c_custkey"), "prediction"), 4)


@query("ridge", line_sql(1.0))
def ridge(spark, folder):
    out, _ = regression.ridge(balance_fold(spark, folder, ["c_nationkey"]))
    return rounded(out.select(F.col("id").alias("c_custkey"), "prediction"), 4)


DBSCAN_SQL = (
    "WITH RECURSIVE p AS (SELECT s_suppkey AS id, (s_nationkey - (SELECT avg(s_nationkey) FROM supplier)) / (SELECT stddev_pop(s_nationkey) FROM supplier) AS x, "
    "(s_acctbal - (SELECT avg(s_acctbal) FROM supplier)) / (SELECT stddev_pop(s_acctbal) FROM supplier) AS y FROM supplier), "
    "placed AS (SELECT *, row_number() OVER (ORDER BY x, y) AS pos FROM p), "
    "near AS (SELECT a.id AS a, b.id AS b, b.pos AS bpos FROM placed a, placed b WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.25), "
    "core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 5), "
    "links AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)), "
    "reach(a, b) AS (SELECT id, id FROM core UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a), "
    "root AS (SELECT r.a AS id, min(q.pos) AS root FROM reach r JOIN placed q ON q.id = r.b GROUP BY r.a), "
    "numbered AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS number FROM root), "
    "border AS (SELECT n.a AS id, min(c.number) AS number FROM near n JOIN numbered c ON c.id = n.b WHERE n.a NOT IN (SELECT id FROM core) GROUP BY n.a) "
    "SELECT s_suppkey, coalesce(n.number, b.number, -1)::INTEGER AS cluster FROM supplier "
    "LEFT JOIN numbered n ON n.id = s_suppkey LEFT JOIN border b ON b.id = s_suppkey"
)


@query("dbscan", DBSCAN_SQL)
def dbscan_suppliers(spark, folder):
    df = prepare.standard_scale(table(spark, folder, "supplier"), ["s_nationkey", "s_acctbal"])
    return dbscan(df, ["s_nationkey", "s_acctbal"]).select("s_suppkey", "cluster")


# ---------------------------------------------------------------- models without an SQL form

def _checked(record: dict) -> dict:
    if not record["success"]:
        raise RuntimeError(f"{record['model_name']}: {record['error_type']}: {record['error_message']}")
    return record


def _record_rows(spark: SparkSession, record: dict) -> DataFrame:
    rows = [(record["model_name"], metric, float(value)) for metric, value in sorted(record["metrics"].items())]
    return spark.createDataFrame(rows, "model_name string, metric string, value double")


def balance_flag_fold(spark, folder) -> Fold:
    """Two classes: whether a customer's balance is above 5000, from nation and segment."""
    done = split.train_test_split(customer_rows(spark, folder), by="c_mktsegment", method="md5")
    fold = _fold(done.withColumn("c_high", (F.col("c_acctbal") > 5000).cast("int")), ["c_nationkey", "seg"], "c_high")
    counts = {int(r.label): r["count"] for r in fold.train.groupBy("label").count().collect()}
    fold.classes, fold.class_rows = [0, 1], [counts.get(0, 0), counts.get(1, 0)]
    return fold


def scaled_customers(spark, folder) -> PreparedData:
    """Nation and balance of all customers, prepared for clustering without reduction; customers with equal values all stay."""
    df = table(spark, folder, "customer").select("c_nationkey", "c_acctbal")
    return prepare.preprocess(df, task="clustering", reduction="off", dedupe=False)


def _model_query(name: str, task: str, spec, make_fold) -> None:
    """What SQL can state of a fitted model: the rows it learned from and was scored on, and the scores that are numbers."""
    scores = "accuracy,f1,pr_auc,precision,recall" if task == "classification" else "mae,r2,rmse"

    @query(
        name,
        f"WITH s AS {CUSTOMER_SPLIT} SELECT '{spec.name}' AS model_name, count(CASE WHEN NOT is_test THEN 1 END) AS n_train, "
        f"count(CASE WHEN is_test THEN 1 END) AS n_test, '{scores}' AS scores FROM s",
    )
    def run(spark, folder):
        ensure_checkpoint_dir(spark)
        fold = make_fold(spark, folder)
        fold.train, fold.test = sized(fold.train, fold.n_train).persist(), sized(fold.test, fold.n_test).persist()
        try:
            record = _checked(run_one(spec, task, fold))
            numbers = ",".join(sorted(k for k, v in record["metrics"].items() if math.isfinite(v)))
            row = (record["model_name"], record["n_train_samples"], record["n_test_samples"], numbers)
            return spark.createDataFrame([row], "model_name string, n_train bigint, n_test bigint, scores string")
        finally:
            fold.train.unpersist()
            fold.test.unpersist()


for _spec in select_zoo("classification"):
    if _spec.name not in ("majority_class", "nearest_neighbours_5"):
        _model_query(f"classify_{_spec.name}", "classification", _spec, balance_flag_fold)
for _spec in select_zoo("regression"):
    if _spec.family in ("tree", "boosting"):
        _model_query(f"regress_{_spec.name}", "regression", _spec, balance_fold)


def _cluster_query(spec) -> None:
    """Rows clustered, and the clusters formed where their number is a parameter."""
    wanted = f"{spec.params['k']}::DOUBLE" if "k" in spec.params else "NULL::DOUBLE"

    @query(
        f"cluster_{spec.name.replace('.', '_')}",
        f"SELECT '{spec.name}' AS model_name, true AS success, count(*) AS n_train, {wanted} AS n_clusters FROM customer",
    )
    def run(spark, folder):
        record = run_experiments(scaled_customers(spark, folder), zoo=[spec])
        clusters = F.col("metrics").getItem("n_clusters") if "k" in spec.params else F.lit(None).cast("double")
        return record.select(
            "model_name", "success", F.col("n_train_samples").cast("bigint").alias("n_train"), clusters.alias("n_clusters")
        )


for _spec in select_zoo("clustering"):
    _cluster_query(_spec)


@query(
    "experiment_scores_labels_1_2",
    f"WITH s AS {CUSTOMER_SPLIT}, t AS (SELECT CASE WHEN c_acctbal > 5000 THEN 2 ELSE 1 END AS y, is_test FROM s), "
    "m AS (SELECT y FROM t WHERE NOT is_test GROUP BY y ORDER BY count(*) DESC, y LIMIT 1), "
    "c AS (SELECT avg((t.y = 1)::INTEGER) AS p1, avg((t.y = 2)::INTEGER) AS p2, max(m.y) AS m FROM t, m WHERE is_test) "
    "SELECT 'majority_class' AS model_name, metric, round(value, 6) AS value FROM ("
    + union_sql(
        [
            f"SELECT '{metric}' AS metric, ({value})::DOUBLE AS value FROM c"
            for metric, value in (
                ("accuracy", "CASE WHEN m = 1 THEN p1 ELSE p2 END"), ("f1", "CASE WHEN m = 1 THEN 2 * p1 / (1 + p1) ELSE 0 END"),
                ("precision", "CASE WHEN m = 1 THEN p1 ELSE 0 END"), ("recall", "CASE WHEN m = 1 THEN 1 ELSE 0 END"), ("pr_auc", "p2"),
            )
        ]
    )
    + ")",
)
def experiment_scores_labels_1_2(spark, folder):
    """Labels 1 and 2 as numbers 0 and 1: the scores are those of label 1."""
    fold = balance_flag_fold(spark, folder)
    fold.classes = [1, 2]
    spec = next(s for s in select_zoo("classification") if s.name == "majority_class")
    return rounded(_record_rows(spark, _checked(run_one(spec, "classification", fold))))


@query(
    "experiments_regression_ranked",
    "SELECT r.range::INTEGER AS rank, true AS in_order, n AS n_rows FROM range(1, 8) r, (SELECT count(*) AS n FROM "
    "(SELECT DISTINCT p_size, p_brand, p_type, p_retailprice FROM part))",
)
def experiments_regression_ranked(spark, folder):
    """The whole regression zoo on part, price from size and brand: every rank once, errors rising with it."""
    df = table(spark, folder, "part").select("p_size", "p_brand", "p_type", "p_retailprice")
    records = run_experiments(prepare.preprocess(df, "p_retailprice", "regression"))
    board = rank.leaderboard(records, "regression").join(records.select("model_name", "n_train_samples", "n_test_samples"), "model_name")
    # One row per model of the zoo.
    before = F.lag("rmse").over(Window.partitionBy(F.lit(0)).orderBy("rank"))
    return board.select(
        "rank", F.coalesce(F.col("rmse") >= before, F.lit(True)).alias("in_order"),
        (F.col("n_train_samples") + F.col("n_test_samples")).cast("bigint").alias("n_rows"),
    )


@query(
    "study_of_customers",
    "SELECT model_name, true AS scored, (SELECT count(*) FROM (SELECT DISTINCT c_nationkey, c_mktsegment, c_acctbal > 5000 FROM customer)) "
    "AS n_rows FROM (VALUES " + ", ".join(f"('{s.name}')" for s in select_zoo("classification")) + ") AS m(model_name)",
)
def study_of_customers(spark, folder):
    """A whole run with a confirmed task: high balance from nation and segment."""
    df = table(spark, folder, "customer").select(
        "c_nationkey", "c_mktsegment", (F.col("c_acctbal") > 5000).cast("int").alias("label")
    )
    return _studied(run_pipeline(df, custom_features=({"name": "twice", "formula": "c_nationkey * 2"},)))


def _studied(result) -> DataFrame:
    """The models that were scored, and the rows they shared."""
    return result.records.filter("success").select(
        "model_name", (F.col("n_test_samples") >= 1).alias("scored"),
        (F.col("n_train_samples") + F.col("n_test_samples")).cast("bigint").alias("n_rows"),
    )


LINES_PREPARED = (
    "WITH d AS (SELECT * FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, "
    "l_tax, l_quantity * l_discount AS a, l_extendedprice * l_tax AS b, l_extendedprice / l_quantity AS c, l_partkey + l_suppkey AS d, "
    "(l_returnflag = 'R')::INTEGER AS label FROM lineitem))"
)


@query(
    "study_of_lineitem",
    f"{LINES_PREPARED} SELECT model_name, ceil(0.25 * sum(n))::BIGINT >= 1 AS scored, sum(n)::BIGINT AS n_rows FROM "
    "(SELECT label, count(*) AS n FROM d GROUP BY label), "
    "(VALUES ('logistic_regression'), ('majority_class')) AS m(model_name) GROUP BY model_name",
)
def study_of_lineitem(spark, folder):
    """A whole run over twelve numeric columns and two classes, with the two linear-time models."""
    df = table(spark, folder, "lineitem").select(
        *LINEITEM_NUMBERS, (F.col("l_quantity") * F.col("l_discount")).alias("a"), (F.col("l_extendedprice") * F.col("l_tax")).alias("b"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("c"), (F.col("l_partkey") + F.col("l_suppkey")).alias("d"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
    )
    zoo = [s for s in select_zoo("classification") if s.name in ("majority_class", "logistic_regression")]
    return _studied(run_pipeline(df, scope={"zoo": zoo}))


@query(
    "report_sections",
    "WITH c AS (SELECT c_nationkey, c_mktsegment, c_acctbal > 5000 AS label FROM customer) "
    "SELECT 'clean_table' AS section, count(*) AS n_rows FROM (SELECT DISTINCT * FROM c) "
    "UNION ALL SELECT 'class_balance', count(DISTINCT label) FROM c "
    "UNION ALL SELECT 'rows of records', 2 * count(*) FROM (SELECT DISTINCT * FROM c) "
    "UNION ALL SELECT section, n FROM (VALUES ('table_profile', 1), ('column_profile', 3), ('detection', 1), ('records', 2), ('ranking', 2), "
    "('leaderboard', 2), ('best_model', 1), ('failures', 0), ('missing_cells', 1), ('run_summary', 1), ('best_record', 1)) AS t(section, n)",
)
def report_sections(spark, folder):
    """The tables that a report writes, read again: rows of each section, and the rows its two models shared."""
    df = table(spark, folder, "customer").select(
        "c_nationkey", "c_mktsegment", (F.col("c_acctbal") > 5000).cast("int").alias("label")
    )
    zoo = [s for s in select_zoo("classification") if s.name in ("majority_class", "logistic_regression")]
    path = f"{ensure_checkpoint_dir(spark)}/report-{uuid.uuid4().hex}"
    written = run_report(run_pipeline(df, scope={"zoo": zoo}), path)
    counted = (
        "clean_table", "class_balance", "table_profile", "column_profile", "detection", "records", "ranking", "leaderboard",
        "best_model", "failures", "missing_cells", "run_summary", "best_record",
    )
    parts = [
        spark.read.parquet(f"{path}/{name}").agg(F.lit(name).alias("section"), F.count(F.lit(1)).alias("n_rows"))
        for name in counted if name in written
    ]
    shared = F.coalesce(F.sum(F.col("n_train_samples") + F.col("n_test_samples")), F.lit(0)).cast("bigint")
    found = spark.read.parquet(f"{path}/records").agg(F.lit("rows of records").alias("section"), shared.alias("n_rows"))
    for part in parts:
        found = found.unionByName(part)
    return found


@query(
    "csv_round_trip_documents",
    "SELECT doc_id, md5(text) AS digest, lang FROM documents",
)
def csv_round_trip_documents(spark, folder):
    """Texts with line breaks and quotes, written as CSV and read again."""
    path = f"{ensure_checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    tables.write_table(table(spark, folder, "documents").select("doc_id", "text", "lang"), path, "csv")
    found = tables.read_table(spark, path, "csv", "doc_id bigint, text string, lang string")
    return found.select("doc_id", F.md5("text").alias("digest"), "lang")


@query(
    "guards",
    "SELECT what, outcome, (SELECT count(*) FROM orders) AS n_rows FROM (VALUES ('empty table', 'ValueError'), ('one row', 'ValueError'), "
    "('no features', 'NoFeaturesLeft'), ('all models fail', 'AllExperimentsFailed'), ('study stops', 'StudyFailed'), "
    "('fatal entry', 'input: ValueError'), ('features and target', '1 feature'), ('components', '2')) AS t(what, outcome)",
)
def guards(spark, folder):
    """What stops a run, each tried on the orders table."""
    orders = table(spark, folder, "orders").select("o_orderpriority", "o_totalprice")

    def broken(fold):
        raise RuntimeError("broken on purpose")

    def outcome(work) -> str:
        try:
            work()
        except Exception as exc:  # the error's kind is the result
            return type(exc).__name__
        return "none"

    def fatal() -> str:
        try:
            run_pipeline(orders.filter("o_totalprice < 0"))
        except StudyFailed as stopped:
            return "; ".join(f"{r[0]}: {r[1]}" for r in stopped.errors.filter("not recoverable").collect())
        return "none"

    prepared = prepare.preprocess(orders, "o_totalprice", "regression")
    failing = [ModelSpec("broken", "none", {}, broken)]
    inputs, _ = split.split_features(orders, "o_totalprice")
    found = [
        ("empty table", outcome(lambda: tables.require_non_empty(orders.filter("o_totalprice < 0")))),
        ("one row", outcome(lambda: tables.require_min_rows(orders.limit(1)))),
        ("no features", outcome(lambda: prepare.preprocess(orders.select("o_totalprice"), "o_totalprice", "regression"))),
        ("all models fail", outcome(lambda: run_experiments(prepared, failing))),
        ("study stops", outcome(lambda: run_pipeline(orders, "o_totalprice", task_override="regression", scope={"zoo": failing}))),
        ("fatal entry", fatal()), ("features and target", f"{len(inputs)} feature"), ("components", str(reduce.component_count(3, 10))),
    ]
    return spark.createDataFrame(found, "what string, outcome string").crossJoin(orders.agg(F.count(F.lit(1)).alias("n_rows")))
