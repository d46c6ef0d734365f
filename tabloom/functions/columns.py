"""Small column helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Column objects are costly to build one call at a time from Python (milliseconds each),
# so whatever is repeated per column of a wide table is written as SQL text and parsed once.


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def ref(name: str) -> Column:
    """Reference a column whose name may hold dots, blanks or backticks."""
    return F.expr(quoted(name))


def number_sql(value: float) -> str:
    """A double literal."""
    return f"double('{float(value)!r}')"


def text_sql(value: str) -> str:
    """A string literal that is the same under any escaping rule."""
    return f"cast(X'{value.encode().hex()}' as string)"


def is_fractional(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType))


def is_integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def is_datetime(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def present_sql(df: DataFrame, name: str) -> str:
    """The column with NaN counted as missing, as it is in a data frame of floats."""
    column = quoted(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return f"if(isnan({column}), null, {column})"
    return column


def double_sql(df: DataFrame, name: str) -> str:
    return f"cast({present_sql(df, name)} as double)"


def present(df: DataFrame, name: str) -> Column:
    return F.expr(present_sql(df, name))


def as_double(df: DataFrame, name: str) -> Column:
    return F.expr(double_sql(df, name))


def share(part: Column, whole: Column) -> Column:
    """part / whole as a double, null where whole is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def safe_ratio(a: Column, b: Column, on_zero: str = "null") -> Column:
    """a / b on doubles; ``on_zero`` is ``"null"`` or ``"ieee"`` (signed infinity, NaN)."""
    a, b = a.cast("double"), b.cast("double")
    if on_zero == "null":
        return F.try_divide(a, b)
    if on_zero != "ieee":
        raise ValueError(f"on_zero must be 'null' or 'ieee', not {on_zero!r}")
    at_zero = (
        F.when(a.isNull(), F.lit(None).cast("double"))
        .when((a == 0) | F.isnan(a), F.lit(float("nan")))
        .otherwise(F.signum(a) * F.lit(float("inf")))
    )
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def text_of(column: Column) -> Column:
    """Text of any value for hashing, with a marker for null that a text could hold too."""
    return F.coalesce(column.cast("string"), F.lit("\\N"))


def content_hash(df: DataFrame, seed: int, method: str = "xxhash64") -> Column:
    """A row's content as 32 hex digits that order rows at random but always the same way.

    ``"xxhash64"`` joins two differently seeded 64-bit hashes of the column values.
    ``"md5"`` hashes their texts: several times slower, but the same in any engine
    that writes the values alike.
    """
    if method == "md5":
        return F.md5(F.concat_ws("|", *[text_of(ref(n)) for n in df.columns], F.lit(str(seed))))
    if method != "xxhash64":
        raise ValueError(f"unknown method {method!r}: use 'xxhash64' or 'md5'")
    # A null leaves the hash as it was, so where the nulls are has to be hashed too.
    nulls = ", ".join(f"if({quoted(f.name)} is null, '1', '0')" for f in df.schema if f.nullable)
    values = ", ".join(quoted(n) for n in df.columns)
    halves = [f"lpad(hex(xxhash64({seed + i}, concat('', {nulls or chr(39) * 2}), {values})), 16, '0')" for i in (0, 1)]
    return F.expr(f"lower(concat({', '.join(halves)}))")


def literal_rows(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A table of driver-side facts: one row per column, class, model or log entry."""
    return spark.createDataFrame(rows, schema)
