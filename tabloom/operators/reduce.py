"""Truncated SVD and PCA over feature columns or one sparse vector column.

The Gram matrix of narrow tables is summed inside the JVM as packed triangles, in a tree, and its eigenvectors are
found on the driver.  Beyond ``GRAM_COLUMNS`` columns the SVD multiplies the rows with vectors instead (Lanczos), so
that no matrix of (columns x columns) is ever built; PCA keeps to the covariance matrix, which Spark limits to 65,535 columns.
Projecting is one Arrow-batched matrix product per batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.columns import double_sql, number_sql, ref
from tabloom.operators.gram import means

DEFAULT_COMPONENTS = 50
#: Columns up to which the Gram matrix is built: 64 MB as a packed triangle.
GRAM_COLUMNS = 4_000


@dataclass
class Projection:
    """(x - centre) @ axes, as columns pc_1 .. pc_k."""

    inputs: list[str]
    centre: np.ndarray
    axes: np.ndarray
    explained: float

    @property
    def names(self) -> list[str]:
        return [f"pc_{k + 1}" for k in range(self.axes.shape[1])]

    def apply(self, df: DataFrame) -> DataFrame:
        """Replace the input columns by the components; other columns stay."""
        others = [n for n in df.columns if n not in set(self.inputs)]
        inputs, names, centre, axes = self.inputs, self.names, self.centre, self.axes

        def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                scores = (batch[inputs].to_numpy(dtype=float) - centre) @ axes
                out = pd.DataFrame(scores, columns=names)
                for name in others:
                    out[name] = batch[name].to_numpy()
                yield out

        schema = T.StructType(
            [T.StructField(n, T.DoubleType()) for n in names] + [df.schema[n] for n in others]
        )
        return df.select(*map(ref, inputs + others)).mapInPandas(project, schema)


def component_count(features: int, rows: int, wanted: int | None = None) -> int | None:
    """Components to keep, below both counts; None if there is nothing to reduce."""
    if features < 2 or rows < 2:
        return None
    wanted = min(DEFAULT_COMPONENTS, features) if wanted is None else wanted
    return max(1, min(wanted, features - 1, rows - 1))


def _completed(axes: np.ndarray, keep: int) -> np.ndarray:
    """The orthonormal axes, filled up to ``keep`` by those unit vectors that lie farthest outside their span."""
    while axes.shape[1] < keep:
        k = int(np.argmax(1.0 - (axes**2).sum(axis=1)))
        extra = -axes @ axes[k]
        extra[k] += 1.0
        extra -= axes @ (axes.T @ extra)
        axes = np.column_stack([axes, extra / np.linalg.norm(extra)])
    return axes


def _signed(axes: np.ndarray) -> np.ndarray:
    """Signs are arbitrary; each axis's largest entry is made positive so that runs agree.

    Flags of two levels have entries of one size and opposite signs; of entries equal but for rounding, the first counts.
    """
    sizes = np.abs(axes)
    first = (sizes >= sizes.max(axis=0) * (1.0 - 1e-6)).argmax(axis=0)
    return axes * np.where(axes[first, np.arange(axes.shape[1])] < 0, -1.0, 1.0)


def fit_axes(
    vectors: DataFrame, width: int, method: str = "svd", components: int | None = None, gram_columns: int = GRAM_COLUMNS
) -> tuple[np.ndarray, np.ndarray, float] | None:
    """(centre, axes, share of variance kept) of a table whose only column is a vector, dense or sparse, of ``width`` numbers."""
    if method not in ("svd", "pca"):
        raise ValueError(f"unknown method {method!r}: use 'svd', 'pca' or 'off'")
    if width < 2:
        return None
    name = vectors.columns[0]
    facts = vectors.select(Summarizer.metrics("count", "mean", "variance").summary(ref(name)).alias("s")).first().s
    rows = int(facts["count"])
    keep = component_count(width, rows, components)
    if keep is None:
        return None
    mean, total = facts["mean"].toArray(), float(facts["variance"].toArray().sum()) * (rows - 1)
    if total + rows * float(mean @ mean) == 0.0:
        return np.zeros(width), _completed(np.zeros((width, 0)), keep), 0.0
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, name), rows, width)
    if method == "svd" and width > gram_columns:
        found = matrix.computeSVD(keep)
        axes, squares = found.V.toArray(), found.s.toArray() ** 2
    elif method == "svd":
        squares, axes = np.linalg.eigh(matrix.computeGramianMatrix().toArray())
    else:
        squares, axes = np.linalg.eigh(matrix.computeCovariance().toArray() * (rows - 1))
    order = np.argsort(squares)[::-1][:keep]
    axes, squares = axes[:, order], squares[order]
    # Square sums about zero become those about the mean.
    kept = float(np.maximum(squares, 0.0).sum()) - (rows * float(((mean @ axes) ** 2).sum()) if method == "svd" else 0.0)
    axes = _completed(axes, keep)
    axes = _signed(axes)
    centre = mean if method == "pca" else np.zeros(width)
    return centre, axes, kept / total if total > 0 else 0.0


def fit_projection(
    df: DataFrame, names: list[str], method: str = "svd", components: int | None = None
) -> Projection | None:
    """Fit on numeric columns, a gap counting as the column's mean; None if there are too few columns or rows."""
    if method not in ("svd", "pca"):
        raise ValueError(f"unknown method {method!r}: use 'svd', 'pca' or 'off'")
    if len(names) < 2:
        return None
    filled = [f"coalesce({double_sql(df, n)}, {number_sql(m)})" for n, m in zip(names, means(df, names), strict=True)]
    fit = fit_axes(df.select(array_to_vector(F.expr(f"array({', '.join(filled)})")).alias("x")), len(names), method, components)
    return Projection(names, *fit) if fit else None


def reduce_dims(
    df: DataFrame, cols: list[str], method: str = "svd", components: int | None = None
) -> DataFrame:
    """Replace ``cols`` by principal components; unchanged if off or nothing to reduce."""
    if method in ("off", "none"):
        return df
    projection = fit_projection(df, cols, method, components)
    return projection.apply(df) if projection else df
