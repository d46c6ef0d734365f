"""Feature rows as points: one array column, equal points merged, block sizes.

Distance work is quadratic inside a task, so its inputs are blocks of bounded
size.  Merging equal points first turns any number of copies into one weighted
point, and a group of points that is still large is cut into chunks whose pairs
of chunks are independent tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import quoted, ref
from tabloom.session import settle

#: Points of one side of a block pair; a distance matrix of a pair has its square of cells.
BLOCK = 2_048


def point(df: DataFrame, features: list[str]) -> Column:
    """The features as one array of doubles; a single array column is taken as it is."""
    if len(features) == 1 and df.schema[features[0]].dataType.typeName() == "array":
        return ref(features[0]).cast("array<double>")
    # -0.0 and 0.0 are one point.
    return F.expr(f"array({', '.join(f'double({quoted(f)}) + 0D' for f in features)})")


def merged_points(df: DataFrame, features: list[str], *keys: Column) -> DataFrame:
    """Distinct (point ``x``, keys) with their count ``w`` and a stable ``id`` rising with ``x``.

    Written once, so that all later joins see the same ids.
    """
    named = [k.alias(f"k{i}") for i, k in enumerate(keys)]
    groups = (
        df.select(point(df, features).alias("x"), *named)
        .groupBy("x", *[f"k{i}" for i in range(len(keys))])
        .agg(F.count(F.lit(1)).alias("w"))
    )
    return settle(groups.orderBy("x", *[f"k{i}" for i in range(len(keys))]).withColumn(
        "id", F.monotonically_increasing_id()
    ))


def stack(points) -> np.ndarray:
    """Rows of array cells as one matrix."""
    return np.stack([np.asarray(p, dtype=float) for p in points])


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances, summed feature by feature: no cancellation, same order every time."""
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        gap = a[:, j, None] - b[None, :, j]
        total += gap * gap
    return total


def chunk_of(key: Column, chunks: Column) -> Column:
    """An even chunk number in 0 .. chunks-1 for a row key."""
    return F.pmod(F.xxhash64(key), F.greatest(chunks, F.lit(1))).cast("int")


def renewed(df: DataFrame) -> DataFrame:
    """The same columns under new identities, so that a table can meet itself in a cogroup."""
    return df.selectExpr(*[f"{c} as {c}" for c in df.columns])
