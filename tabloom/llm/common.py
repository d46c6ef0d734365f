"""Column expressions and helpers shared by the operators on documents."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.columns import ref
from tabloom.session import ensure_checkpoint_dir

#: The white space that separates words, and the two alphabets of ASCII folding.
WHITE_SPACE = r"[ \t-\x0d]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text of a row, empty where it is null."""
    return F.coalesce(ref(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WHITE_SPACE), lambda word: word != "")


def hashed_sample(df: DataFrame, name: str, size: int) -> DataFrame:
    """About ``size`` different values of a text column, by their hash; all of them if there are no more rows than that.

    What is taken depends on the values and on the number of rows only.  Copies of a value are combined before
    they are shuffled.
    """
    share = size / max(1, df.count())
    number = F.xxhash64(name)
    taken = df.select(ref(name)).filter(F.pmod(number, F.lit(1_000_000_007)) / F.lit(1_000_000_007.0) < share)
    return taken.groupBy(number.alias("_hash")).agg(F.first(name).alias(name)).select(name)


def packed(df: DataFrame, name: str = "_row") -> DataFrame:
    """All columns of a row as one struct, so that no column added later can clash with them."""
    return df.select(F.struct(*[ref(c) for c in df.columns]).alias(name))


def unpacked(df: DataFrame, columns: list[str], name: str = "_row") -> DataFrame:
    return df.select(*[F.col(name).getField(c).alias(c) for c in columns])


def bucketed(rows: DataFrame, buckets: int, *columns: str) -> DataFrame:
    """The rows, written once as a table in buckets of some columns, so that joins and groups by them need no further shuffle."""
    spark = rows.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark)}/{name}"
    rows.repartition(buckets, *columns).write.format("parquet").bucketBy(buckets, *columns).option("path", path).saveAsTable(name)
    return spark.table(name)
