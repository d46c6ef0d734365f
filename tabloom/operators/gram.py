"""Sums over column pairs, built from per-partition matrix products.

Each Arrow batch adds its own matrix product.  A partition emits one row per column: the packed sums of that column
with all later ones, as one vector.  These rows are summed by column inside the JVM, so neither a row per cell nor
the whole matrix meets in one place, whatever the number of rows or columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import double_sql

#: Cells of one matrix that a task holds; wider tables are done in several passes, each over a stripe of the columns.
CELLS = 4_000_000
#: Sums kept per column pair, in the order in which they are packed.
PARTS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _stripe_sums(batches: Iterator[pd.DataFrame], centres: np.ndarray, low: int, high: int) -> Iterator[pd.DataFrame]:
    """Packed sums of the columns low .. high-1 with all later ones."""
    width = len(centres)
    shape = (high - low, width - low)
    sums = {part: np.zeros(shape) for part in PARTS}
    step = max(1, CELLS // width)
    seen = False
    for batch in batches:
        whole = batch.to_numpy(dtype=float)
        for first in range(0, len(whole), step):
            values = whole[first : first + step, low:]
            held = ~np.isnan(values)
            mask = held.astype(float)
            x = np.where(held, values - centres[low:], 0.0)
            xx = x * x
            rows = high - low
            sums["n"] += mask[:, :rows].T @ mask
            sums["sx"] += x[:, :rows].T @ mask
            sums["sy"] += mask[:, :rows].T @ x
            sums["sxx"] += xx[:, :rows].T @ mask
            sums["syy"] += mask[:, :rows].T @ xx
            sums["sxy"] += x[:, :rows].T @ x
            seen = True
    if seen:
        for k in range(min(high, width - 1) - low):
            yield pd.DataFrame({"i": [low + k], "cells": [np.concatenate([sums[p][k, k + 1 :] for p in PARTS])]})


def pair_sums(df: DataFrame, names: list[str], centres: list[float], cells: int = CELLS) -> DataFrame:
    """Per column pair i < j over rows where both are present, values less their centres:
    n, the sums of i and of j, of their squares, and of i times j."""
    shift = np.array(centres, dtype=float)
    width = len(names)
    slim = df.selectExpr(*[f"{double_sql(df, n)} as c{i}" for i, n in enumerate(names)])
    stripe = max(1, cells // max(1, width))
    parts = None
    for low in range(0, width - 1, stripe):
        high = min(width, low + stripe)
        part = slim.mapInPandas(
            lambda batches, low=low, high=high: _stripe_sums(batches, shift, low, high), "i int, cells array<double>"
        )
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return df.sparkSession.createDataFrame([], "i int, j int, " + ", ".join(f"{p} double" for p in PARTS))
    summed = parts.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("cells"))).alias("cells"))
    # Column i is packed with the width - 1 - i columns after it.
    later = f"{width - 1} - i"
    cut = [f"slice(cells, {k} * ({later}) + 1, {later}) as {p}" for k, p in enumerate(PARTS)]
    return (
        summed.selectExpr("i", *cut)
        .select("i", F.posexplode(F.arrays_zip(*PARTS)).alias("at", "pair"))
        .selectExpr("i", "i + 1 + at as j", "round(pair.n) as n", *[f"pair.{p} as {p}" for p in PARTS[1:]])
    )


def means(df: DataFrame, names: list[str]) -> list[float]:
    """Column means, 0 for a column without values."""
    row = df.agg(*[F.expr(f"avg({double_sql(df, n)})") for n in names]).first()
    return [0.0 if m is None or m != m else float(m) for m in row]
