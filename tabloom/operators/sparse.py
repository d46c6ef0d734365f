"""One-hot encoding of any number of levels: a dictionary table and sparse vectors.

The level dictionary is a table (column slot, level, position in the vector), ordered by column and level and
written in one folder per column.  Encoding joins each column with its part of the dictionary; Spark broadcasts a part that is
small and shuffles with skew handling otherwise, so neither the driver nor the plan ever holds the levels.  Vectors
are written in the storage form of Spark's vector type and read back as vectors, without any code per row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.columns import double_sql, number_sql, quoted, ref, text_sql
from tabloom.operators.profile import value_counts
from tabloom.operators.reduce import fit_axes
from tabloom.session import ensure_checkpoint_dir, staged


def level_table(df: DataFrame, names: list[str], first: int = 0, counted: DataFrame | None = None) -> DataFrame:
    """(slot, level, at): all levels of the named columns by slot and level, numbered on from ``first`` without gaps.

    ``counted`` is their value count, where the caller has it.
    """
    spark = df.sparkSession
    schema = "level string, at int, slot int"
    if not names:
        return spark.createDataFrame([], schema)
    counted = value_counts(df, names) if counted is None else counted
    levels = counted.filter("value is not null").select(F.col("slot").cast("int").alias("slot"), F.col("value").alias("level"))
    placed = staged(levels.repartitionByRange("slot", "level").withColumn("part", F.spark_partition_id()))
    # One row per partition, whatever the number of levels.
    sizes = sorted((r.part, r["count"]) for r in placed.groupBy("part").count().collect())
    starts, at = [], first
    for part, size in sizes:
        starts.append((part, at))
        at += size
    offsets = spark.createDataFrame(starts, "part int, start bigint")
    within = Window.partitionBy("part").orderBy("slot", "level")
    numbered = placed.join(F.broadcast(offsets), "part").select(
        "slot", "level", (F.col("start") + F.row_number().over(within) - 1).cast("int").alias("at")
    )
    path = f"{ensure_checkpoint_dir(spark)}/levels-{uuid.uuid4().hex}"
    numbered.write.partitionBy("slot").parquet(path)
    return spark.read.schema(schema).parquet(path)


@dataclass
class SparseProjection:
    """Components of sparse rows: loadings of the numeric columns on the driver, those of the levels as a table."""

    numeric: np.ndarray
    shift: np.ndarray
    loadings: DataFrame  # slot, level, load
    explained: float

    @property
    def names(self) -> list[str]:
        return [f"pc_{k + 1}" for k in range(len(self.shift))]


@dataclass
class SparseModel:
    """Fitted preparation whose output is one vector column; ``transform`` also works on rows it was not fitted on."""

    numeric: list  # NumericFit
    categorical: list  # CategoricalFit without levels
    target: str | None
    dictionary: DataFrame
    width: int
    projection: SparseProjection | None = None

    @property
    def vector(self) -> str:
        return "features" if self.target != "features" else "features_"

    @property
    def feature_cols(self) -> list[str]:
        return self.projection.names if self.projection else [self.vector]

    @property
    def feature_count(self) -> int:
        return len(self.projection.names) if self.projection else self.width

    def feature_table(self) -> DataFrame:
        """(at, feature): the name of each position, as the column form has them."""
        spark = self.dictionary.sparkSession
        numbers = spark.createDataFrame([(k, f.name) for k, f in enumerate(self.numeric)], "at int, feature string")
        slots = spark.createDataFrame([(k, f.name) for k, f in enumerate(self.categorical)], "slot int, _name string")
        levels = self.dictionary.join(F.broadcast(slots), "slot").select("at", F.concat_ws("_", "_name", "level").alias("feature"))
        return numbers.unionByName(levels)

    def _joined(self, df: DataFrame, table: DataFrame, wanted: str) -> DataFrame:
        """``x`` (scaled numbers), ``f0``, ``f1`` ... (what the table holds for each column's level), ``t``, the target."""
        scaled = [
            f"(coalesce({double_sql(df, f.name)}, {number_sql(f.median)}) - {number_sql(f.mean)}) / {number_sql(f.scale)}"
            for f in self.numeric
        ]
        values = [
            f"coalesce(cast({quoted(f.name)} as string), {text_sql(f.mode)}) as v{k}" for k, f in enumerate(self.categorical)
        ]
        kept = [f"{quoted(self.target)} as t"] if self.target in df.columns else []
        rows = df.selectExpr(f"cast(array({', '.join(scaled)}) as array<double>) as x", *values, *kept)
        for k in range(len(self.categorical)):
            part = table.filter(F.col("slot") == k).select(F.col("level").alias(f"l{k}"), F.col(wanted).alias(f"f{k}"))
            rows = rows.join(part, F.col(f"v{k}") == F.col(f"l{k}"), "left").drop(f"v{k}", f"l{k}")
        return rows

    def encode(self, df: DataFrame) -> DataFrame:
        """The vector column and the target as it is, written once; a level that was not fitted has no entry."""
        spark = df.sparkSession
        rows = self._joined(df, self.dictionary, "at")
        found = f"filter(cast(array({', '.join(f'f{k}' for k in range(len(self.categorical)))}) as array<int>), a -> a is not null)"
        first = f"slice(sequence(0, {len(self.numeric)}), 1, {len(self.numeric)})"
        parts = f"named_struct('type', tinyint(0), 'size', {self.width}, 'indices', concat({first}, {found}), 'values', concat(x, transform({found}, a -> 1D)))"
        kept = [c for c in rows.columns if c == "t"]
        path = f"{ensure_checkpoint_dir(spark)}/vectors-{uuid.uuid4().hex}"
        rows.selectExpr(f"{parts} as v", *kept).write.parquet(path)
        schema = T.StructType([T.StructField("v", VectorUDT())] + [T.StructField("t", rows.schema["t"].dataType) for _ in kept])
        read = spark.read.schema(schema).parquet(path)
        return read.select(F.col("v").alias(self.vector), *[F.col("t").alias(self.target) for _ in kept])

    def fit_projection(self, df: DataFrame, method: str, components: int | None) -> SparseProjection | None:
        vectors = self.encode(df).select(ref(self.vector))
        fit = fit_axes(vectors, self.width, method, components)
        if fit is None:
            return None
        centre, axes, explained = fit
        first = len(self.numeric)
        loads = pd.DataFrame({"at": np.arange(first, self.width, dtype="int32"), "load": list(axes[first:])})
        table = vectors.sparkSession.createDataFrame(loads, "at int, load array<double>")
        path = f"{ensure_checkpoint_dir(vectors.sparkSession)}/loadings-{uuid.uuid4().hex}"
        self.dictionary.join(table, "at").select("slot", "level", "load").write.partitionBy("slot").parquet(path)
        loadings = vectors.sparkSession.read.schema("level string, load array<double>, slot int").parquet(path)
        self.projection = SparseProjection(axes[:first], centre @ axes, loadings, explained)
        return self.projection

    def transform(self, df: DataFrame) -> DataFrame:
        if self.projection is None:
            return self.encode(df)
        p, slots, target = self.projection, len(self.categorical), self.target
        rows = self._joined(df, p.loadings, "load")
        numeric, shift, names = p.numeric, p.shift, p.names
        keeps = "t" in rows.columns

        def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            none = np.zeros(len(shift))
            for batch in batches:
                x = np.array([np.asarray(v, dtype=float) for v in batch["x"]]).reshape(len(batch), len(numeric))
                scores = x @ numeric - shift
                for k in range(slots):
                    scores = scores + np.array([none if v is None else v for v in batch[f"f{k}"]]).reshape(scores.shape)
                out = pd.DataFrame(scores, columns=names)
                if keeps:
                    out[target] = batch["t"].to_numpy()
                yield out

        schema = T.StructType([T.StructField(n, T.DoubleType()) for n in names])
        if keeps:
            schema = schema.add(target, rows.schema["t"].dataType)
        return rows.mapInPandas(project, schema)
