"""Table sources, sinks and shape guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.columns import ref

# Cell texts read as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Patterns deciding a text column's type.
_INTEGER = r"^\s*[+-]?\d{1,18}\s*$"
_NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI]nf(inity)?)\s*$"
_BOOLEAN = r"^(True|TRUE|true|False|FALSE|false)$"


def _typed(df: DataFrame) -> DataFrame:
    """Cast each text column to the narrowest type all its values fit, in one pass."""
    facts = df.agg(
        *[
            F.struct(
                F.count(ref(name)).alias("n"),
                F.count_if(ref(name).rlike(_INTEGER)).alias("integer"),
                F.count_if(ref(name).rlike(_NUMBER)).alias("number"),
                F.count_if(ref(name).rlike(_BOOLEAN)).alias("boolean"),
            ).alias(str(i))
            for i, name in enumerate(df.columns)
        ]
    ).first()

    def cast(i: int, name: str) -> Column:
        fact, text = facts[i], F.trim(ref(name))
        if fact.n == 0:
            return ref(name)
        if fact.integer == fact.n:
            return text.cast("bigint").alias(name)
        if fact.number == fact.n:
            return text.cast("double").alias(name)
        if fact.boolean == fact.n:
            return text.cast("boolean").alias(name)
        return ref(name)

    return df.select([cast(i, name) for i, name in enumerate(df.columns)])


def read_table(
    spark: SparkSession, path: str, fmt: str = "csv", schema: str | None = None, multiline: bool = True
) -> DataFrame:
    """Read a table.  CSV has a header row; missing-value tokens become null before types are found.

    ``schema`` (DDL text) skips the typing pass.  Quoted cells may hold line breaks, so a file is
    read by one task; ``multiline=False`` splits files that are known to hold none.
    """
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt != "csv":
        raise ValueError(f"unknown format {fmt!r}: use 'csv' or 'parquet'")
    raw = (
        spark.read.option("header", True)
        .option("inferSchema", False)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multiline)
        .csv(path)
    )
    if not raw.columns:
        raise ValueError(f"{path} has no columns")
    nulled = raw.select(
        [F.when(~ref(c).isin(*NA_TOKENS), ref(c)).alias(c) for c in raw.columns]
    )
    if schema is None:
        return _typed(nulled)
    wanted = spark.createDataFrame([], schema).schema
    return nulled.select([ref(f.name).cast(f.dataType).alias(f.name) for f in wanted.fields])


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Write a table, replacing what the path held."""
    writer = df.write.mode("overwrite")
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt == "csv":
        writer.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    else:
        raise ValueError(f"unknown format {fmt!r}: use 'csv' or 'parquet'")
    return path


def require_non_empty(df: DataFrame) -> DataFrame:
    """Fail on a table without rows or without columns."""
    if not df.columns or df.isEmpty():
        raise ValueError("the table is empty: it has no rows or no columns")
    return df


def require_min_rows(df: DataFrame, n: int = 2) -> DataFrame:
    """Fail on a table with fewer than ``n`` rows, reading no more than needed."""
    found = df.limit(n).count()
    if found < n:
        raise ValueError(f"the table has {found} rows, at least {n} are needed")
    return df


def preview(df: DataFrame, n: int = 5) -> tuple[DataFrame, int, int]:
    """The first rows, the row count and the column count."""
    return df.limit(n), df.count(), len(df.columns)
