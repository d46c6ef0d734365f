"""Exact k nearest neighbours of one table's points among another's.

Equal queries are asked once.  Training points are merged (copies become weights), of one
place only the k smallest labels can count and stay, and they are assigned to the nearest
of a bounded set of pivots.  The pivots bound each query's k-th distance, and the
triangle inequality leaves only cells that can hold a neighbour.  Large cells
are cut into chunks, so a task sees at most one chunk of each side, and only the
k best per query leave it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabloom.functions.columns import ref
from tabloom.operators.points import BLOCK, chunk_of, merged_points, point, squared_distances, stack
from tabloom.session import settle

MAX_PIVOTS = 2_048
_HITS = "qid bigint, d2 double, label double, w bigint"


@dataclass
class _Cells:
    """What is known of the pivots' cells: a bounded set, small enough for every task."""

    pivots: np.ndarray
    count: np.ndarray  # distinct training points
    radius: np.ndarray
    nearest: np.ndarray  # (pivots, k) smallest distances of cell points to the pivot, inf-padded
    slack: float


def _pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances by matrix product: fast, and good to the slack the bounds allow for."""
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2.0 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0.0))


def _with_cell(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add the nearest pivot's number ``cell`` and the distance ``r`` to it."""
    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            distances = _pivot_distances(stack(batch["x"]), pivots)
            cell = distances.argmin(axis=1)
            yield batch.assign(cell=cell.astype("int32"), r=distances[np.arange(len(cell)), cell])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.mapInPandas(assign, f"{schema}, cell int, r double")


def _candidates(queries: DataFrame, cells: _Cells, k: int) -> DataFrame:
    """(qid, x, cell) for each cell that can hold one of the k nearest."""
    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = stack(batch["x"])
            for start in range(0, len(x), 256):
                part, rows = x[start:start + 256], batch.iloc[start:start + 256]
                to_pivot = _pivot_distances(part, cells.pivots)
                reach = (to_pivot[:, :, None] + cells.nearest[None]).reshape(len(part), -1)
                within = np.partition(reach, k - 1, axis=1)[:, k - 1] if reach.shape[1] >= k else np.inf
                least = to_pivot - cells.radius[None, :]
                keep = (least <= np.reshape(within, (-1, 1)) + cells.slack) & (cells.count > 0)[None, :]
                row, cell = np.nonzero(keep)
                yield pd.DataFrame(
                    {"qid": rows["qid"].to_numpy()[row], "x": rows["x"].to_numpy()[row], "cell": cell.astype("int32")}
                )

    return queries.select("qid", "x").mapInPandas(bound, "qid bigint, x array<double>, cell int")


def _best_in_chunk(k: int):
    def best(key, train: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
        if train.empty or query.empty:
            return pd.DataFrame({"qid": [], "d2": [], "label": [], "w": []})
        train = train.sort_values("label", kind="stable")  # equal distances: smaller label first
        t, labels, weights = stack(train["x"]), train["label"].to_numpy(), train["w"].to_numpy()
        q, ids = stack(query["x"]), query["qid"].to_numpy()
        take = min(k, len(t))
        found = []
        for start in range(0, len(q), 512):
            d2 = squared_distances(q[start:start + 512], t)
            order = np.argsort(d2, axis=1, kind="stable")[:, :take]
            found.append(
                pd.DataFrame(
                    {
                        "qid": np.repeat(ids[start:start + 512], take),
                        "d2": np.take_along_axis(d2, order, axis=1).ravel(),
                        "label": labels[order].ravel(),
                        "w": weights[order].ravel(),
                    }
                )
            )
        return pd.concat(found)

    return best


def _chunks(counts: dict[int, int], block: int) -> Column:
    """Chunks of a cell as a lookup over the bounded set of cells."""
    sizes = [max(1, math.ceil(counts.get(c, 0) / block)) for c in range(max(counts, default=0) + 1)]
    return F.get(F.array(*[F.lit(s) for s in sizes]), F.col("cell")) if len(set(sizes)) > 1 else F.lit(sizes[0])


def nearest(
    train: DataFrame, label: str, queries: DataFrame, qid: str, features: list[str], k: int = 5,
    block: int = BLOCK, max_pivots: int = MAX_PIVOTS,
) -> DataFrame:
    """(qid, d2, label, take): the k nearest training rows per query row, copies as ``take``.

    ``qid`` must be a unique bigint column of ``queries``.  Equal distances go to the
    smaller label.
    """
    merged = merged_points(train, features, ref(label).cast("double")).withColumnRenamed("k0", "label")
    # Equal distances go to the smaller label, so of one place only its first k rows by label can be among the k nearest.
    place = Window.partitionBy("x").orderBy("label")
    points = settle(merged.withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= k).drop("_n"))
    total = points.count()
    every = queries.select(ref(qid).alias("qid"), point(queries, features).alias("_point"))
    # Equal queries have equal neighbours: each place is asked once, by a number of its own.
    asked = merged_points(queries, features).select(F.col("id").alias("qid"), "x")
    # Pivots: the points with the smallest hashes, a sample that is the same every time.
    wanted = max(1, min(max_pivots, math.isqrt(total))) if total > block else 1
    pivots = stack(
        r.x for r in points.orderBy(F.xxhash64("x"), "id").limit(wanted).select("x").collect()
    )
    assigned = _with_cell(points, pivots)
    top = F.slice(F.sort_array(F.collect_list("r")), 1, k)
    near = Window.partitionBy("cell").orderBy("r", "id")
    closest = (
        assigned.select("cell", "r", "id")
        .withColumn("_n", F.row_number().over(near)).filter(F.col("_n") <= k)
        .groupBy("cell").agg(top.alias("near"))
    )
    facts = (
        assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("radius"))
        .join(closest, "cell").collect()
    )
    count, radius = np.zeros(len(pivots), dtype=int), np.zeros(len(pivots))
    close = np.full((len(pivots), k), np.inf)
    for f in facts:
        count[f.cell], radius[f.cell] = f.n, f.radius
        close[f.cell, :len(f.near)] = f.near
    scale = 1.0 + float(np.abs(pivots).max(initial=0.0)) * pivots.shape[1] + float(radius.max(initial=0.0))
    cells = _Cells(pivots, count, radius, close, 1e-5 * scale)

    if len(pivots) == 1:
        targets = asked.select("qid", "x", F.lit(0).alias("cell"))
        per_cell = {0: asked.count()}
    else:
        targets = _candidates(asked, cells, k)
        per_cell = {r.cell: r["count"] for r in targets.groupBy("cell").count().collect()}
    train_chunks = _chunks(dict(enumerate(count.tolist())), block)
    query_chunks = _chunks(per_cell, 4 * block)
    # Each training chunk of a cell meets each query chunk of the cell exactly once.
    left = assigned.select(
        "cell", "x", "label", "w", chunk_of(F.col("id"), train_chunks).alias("tc"), query_chunks.alias("q")
    ).withColumn("qc", F.explode(F.sequence(F.lit(0), F.coalesce("q", F.lit(1)) - 1)))
    right = targets.select(
        "cell", "qid", "x", chunk_of(F.col("qid"), query_chunks).alias("qc"), train_chunks.alias("t")
    ).withColumn("tc", F.explode(F.sequence(F.lit(0), F.coalesce("t", F.lit(1)) - 1)))
    hits = (
        left.groupBy("cell", "tc", "qc")
        .cogroup(right.groupBy("cell", "tc", "qc"))
        .applyInPandas(_best_in_chunk(k), _HITS)
    )
    order = Window.partitionBy("qid").orderBy("d2", "label")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    found = (
        hits.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k)
        .withColumn("_before", F.coalesce(F.sum("w").over(upto), F.lit(0)))
        .filter(F.col("_before") < k)
        .select("qid", "d2", "label", F.least("w", F.lit(k) - F.col("_before")).alias("take"))
    )
    placed = found.join(asked, "qid").drop("qid")
    return every.join(placed, F.col("_point") == F.col("x")).select("qid", "d2", "label", "take")


def vote(neighbours: DataFrame) -> DataFrame:
    """(qid, prediction, score): most frequent label, smaller on a tie; score is the share of label 1."""
    counts = neighbours.groupBy("qid", "label").agg(F.sum("take").alias("n"))
    return counts.groupBy("qid").agg(
        F.min(F.struct(-F.col("n"), F.col("label"))).getField("label").alias("prediction"),
        F.try_divide(
            F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).cast("double"), F.sum("n").cast("double")
        ).alias("score"),
    )


def mean_label(neighbours: DataFrame) -> DataFrame:
    """(qid, prediction): mean label of the neighbours."""
    return neighbours.groupBy("qid").agg(
        F.try_divide(F.sum(F.col("label") * F.col("take")), F.sum("take").cast("double")).alias("prediction")
    )
