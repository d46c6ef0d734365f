"""DBSCAN: density clusters by cells, block pairs and connected components.

Copies are merged first.  Points fall into fine cells of a diagonal up to eps, whose
points are all neighbours: a cell of ``min_points`` rows is core as a whole, without a
distance, and the core points of a cell are one node of the link graph.  A coarse grid
over the (at most three) widest features brings cells, and points of sparse cells, to
what may be near them; crowded coarse cells are cut into chunks.  A pair of cells is
linked by its boxes or by a few extreme points where these decide; of the undecided
pairs only those of different components so far are tested by their points, and only by
points within eps of the other cell's box.  A group hands on at most one row per point or
cell, besides the undecided pairs of cells, never pairs of points.
"""

from __future__ import annotations

from itertools import product as combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import number_sql, ref
from tabloom.operators.points import BLOCK, chunk_of, merged_points, point, renewed, squared_distances, stack
from tabloom.plans.ordered import running_sums
from tabloom.session import settle

EPS = 0.5
MIN_POINTS = 5
GRID_FEATURES = 3
NOISE = -1
#: Links that a task of a component round reads at least, where there are as many.
LINKS_PER_TASK = 25_000


def _grid(points: DataFrame, reach: float, total: int, block: int) -> list[tuple[int, float]]:
    """(feature position, cell width) of the grid: the widest features, cells of about a block's points."""
    size = points.select(F.size("x")).first()[0]
    row = points.agg(
        *[F.expr(f"struct(min(x[{i}]) as low, max(x[{i}]) as high)") for i in range(size)]
    ).first()
    spans = sorted(((f.high - f.low, i) for i, f in enumerate(row)), reverse=True)[:GRID_FEATURES]
    per_side = max(1.0, (4.0 * total / block) ** (1.0 / len(spans)))
    return [(i, max(reach * (1 + 1e-9), span / per_side)) for span, i in spans if span > reach]


def _in_chunks(home: DataFrame, visiting: DataFrame, keys: list[str], block: int, work, schema: str) -> DataFrame:
    """Run ``work(key, home, visiting)`` so that rows of equal keys meet once, chunk by chunk.

    Groups are (keys, hc, vc): a chunk of either side, of about ``block`` rows.
    """
    # Only crowded keys are listed; Spark picks the join by the list's measured size.
    crowds = []
    for side, name in ((home, "h"), (visiting, "v")):
        counts = side.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
        crowds.append(counts.select(*keys, F.ceil(F.col("n") / F.lit(float(block))).cast("int").alias(name)))
    crowded = crowds[0].join(crowds[1], keys, "full")

    def keyed(side: DataFrame, own: str, other: str, own_key: str, other_key: str) -> DataFrame:
        one = F.lit(1)
        return (
            side.join(crowded, keys, "left")
            .withColumn(own_key, chunk_of(F.col("id"), F.coalesce(own, one)))
            .withColumn(other_key, F.explode(F.sequence(F.lit(0), F.coalesce(other, one) - 1)))
            .drop("h", "v")
        )

    groups = (*keys, "hc", "vc")
    left = keyed(home, "h", "v", "hc", "vc")
    right = renewed(keyed(visiting, "v", "h", "vc", "hc"))
    return left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInPandas(work, schema)


def _meet(
    residents: DataFrame, visitors: DataFrame, grid: list[tuple[int, float]], block: int, work, schema: str
) -> DataFrame:
    """Run ``work(key, home, visiting)`` where every visitor meets all residents of its surroundings once.

    Visitors are copied to the adjacent grid cells, so the smaller side should visit.
    """
    cell = [f"bigint(floor(x[{i}] / {number_sql(width)}))" for i, width in grid]
    steps = combinations((-1, 0, 1), repeat=len(grid))
    shifted = [", ".join(f"{c} + {d}" for c, d in zip(cell, step, strict=True)) for step in steps]
    around = F.expr(f"array({', '.join(f'cast(array({s}) as array<bigint>)' for s in shifted)})")
    here = F.expr(f"cast(array({', '.join(cell)}) as array<bigint>)")
    home = residents.withColumn("near", here)
    visiting = visitors.withColumn("near", F.explode(around))
    return _in_chunks(home, visiting, ["near"], block, work, schema)


def _close(home: pd.DataFrame, visiting: pd.DataFrame, eps: float) -> np.ndarray:
    return squared_distances(stack(home["x"]), stack(visiting["x"])) <= eps * eps


def _counts_within(eps: float):
    """Rows within eps of each visitor."""
    def count(key, home: pd.DataFrame, visiting: pd.DataFrame) -> pd.DataFrame:
        if home.empty or visiting.empty:
            return pd.DataFrame({"id": [], "n": []})
        n = home["w"].to_numpy(dtype=float) @ _close(home, visiting, eps)
        return pd.DataFrame({"id": visiting["id"], "n": n.astype("int64")})

    return count


def _least_root_within(eps: float):
    """The least root among the residents within eps of each visitor."""
    def border(key, home: pd.DataFrame, visiting: pd.DataFrame) -> pd.DataFrame:
        if home.empty or visiting.empty:
            return pd.DataFrame({"id": [], "root": []})
        none = np.iinfo("int64").max
        root = np.where(_close(home, visiting, eps), home["root"].to_numpy()[:, None], none).min(axis=0)
        found = root != none
        return pd.DataFrame({"id": visiting["id"].to_numpy()[found], "root": root[found]})

    return border


def _lowest_linked(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """The lowest position that each of ``size`` positions is linked to, directly or not."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[a], root[b])
        fresh = root.copy()
        np.minimum.at(fresh, root[a], low)
        np.minimum.at(fresh, root[b], low)
        fresh = fresh[fresh]
        if (fresh == root).all():
            return root
        root = fresh


def _cell_links(eps: float):
    """Links of cells that boxes or extreme points prove, and the pairs that these leave open.

    Links are a spanning set, at most one per cell; pairs that the links of the same
    group join already are not open.
    """
    limit = eps * eps

    def link(key, home: pd.DataFrame, visiting: pd.DataFrame) -> pd.DataFrame:
        if home.empty or visiting.empty:
            return pd.DataFrame({"a": [], "b": [], "sure": []})
        low, high = stack(home["lo"]), stack(home["hi"])
        other_low, other_high = stack(visiting["lo"]), stack(visiting["hi"])
        ids, other_ids = home["id"].to_numpy(), visiting["id"].to_numpy()
        nearest = np.zeros((len(ids), len(other_ids)))
        for j in range(low.shape[1]):
            gap = np.maximum(low[:, j, None] - other_high[None, :, j], other_low[None, :, j] - high[:, j, None])
            gap = np.maximum(gap, 0.0)
            nearest += gap * gap
        # Every pair is met from both sides; one of them is enough.
        one, two = np.nonzero((nearest <= limit) & (ids[:, None] < other_ids[None, :]))
        del nearest
        farthest = np.zeros(len(one))
        for j in range(low.shape[1]):
            gap = np.maximum(high[one, j] - other_low[two, j], other_high[two, j] - low[one, j])
            farthest += gap * gap
        sure = farthest <= limit
        # The points of a cell come as one flat list: Arrow crashes on the nested lists of an empty side.
        extremes = stack(home["extremes"]).reshape(len(ids), -1, low.shape[1])
        other_extremes = stack(visiting["extremes"]).reshape(len(other_ids), -1, low.shape[1])
        for r, s in combinations(range(extremes.shape[1]), range(other_extremes.shape[1])):
            left = np.flatnonzero(~sure)
            apart = np.zeros(len(left))
            for j in range(low.shape[1]):
                gap = extremes[one[left], r, j] - other_extremes[two[left], s, j]
                apart += gap * gap
            sure[left] = apart <= limit
        both, at = np.unique(np.concatenate([ids, other_ids]), return_inverse=True)
        here, there = at[: len(ids)], at[len(ids):]
        root = _lowest_linked(here[one[sure]], there[two[sure]], len(both))
        spanning = root != np.arange(len(both))
        left = ~sure & (root[here[one]] != root[there[two]])
        return pd.DataFrame(
            {
                "a": np.concatenate([both[root[spanning]], ids[one[left]]]),
                "b": np.concatenate([both[spanning], other_ids[two[left]]]),
                "sure": np.repeat([True, False], [spanning.sum(), left.sum()]),
            }
        )

    return link


def _any_close(eps: float):
    """One row if a point of one cell lies within eps of a point of the other."""
    def test(key, home: pd.DataFrame, visiting: pd.DataFrame) -> pd.DataFrame:
        linked = not (home.empty or visiting.empty) and _close(home, visiting, eps).any()
        return pd.DataFrame({"a": [key[0]], "b": [key[1]]} if linked else {"a": [], "b": []})

    return test


def _tasks_for(links: int) -> int:
    return max(1, -(-links // LINKS_PER_TASK))


def connected_components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, root): the least id each node is linked to, directly or not.

    Alternates two contractions (Kiveris et al., "Connected Components in MapReduce and
    Beyond", 2014): larger neighbours are moved to the least neighbour, then smaller
    ones; the links become stars after few rounds.  Each round is written, so the
    lineage stays short and survives lost executors, and read by no more tasks than
    its links are worth: a round shuffles several times, and every task writes a block
    for each partition.
    """
    pairs = settle(
        links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo").distinct()
    )
    tasks = _tasks_for(pairs.count())
    pairs = pairs.coalesce(tasks)
    state = None
    while True:
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = large.coalesce(tasks).distinct().coalesce(tasks)
        small_least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(small_least, "hi").coalesce(tasks)
        small = joined.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(
            joined.select("hi", F.col("m").alias("lo"))
        )
        pairs = settle(small.filter("hi <> lo").distinct().coalesce(tasks))
        mark = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if mark == state:
            break
        state, tasks = mark, _tasks_for(mark[0])
        pairs = pairs.coalesce(tasks)
    return nodes.join(pairs.select(F.col("hi").alias("id"), F.col("lo").alias("root")), "id", "left").select(
        "id", F.coalesce("root", "id").alias("root")
    )


#: Square of a box's diagonal, summed in the order of squared_distances.
DIAGONAL = "aggregate(zip_with(hi, lo, (h, l) -> (h - l) * (h - l)), 0D, (s, v) -> s + v)"

#: Square of a point's distance from a box, in the same order.
FROM_BOX = (
    "aggregate(zip_with(zip_with(x, lo, (v, l) -> l - v), zip_with(x, hi, (v, h) -> v - h), "
    "(u, o) -> greatest(u, o, 0D)), 0D, (s, v) -> s + v * v)"
)


def _cells(points: DataFrame, eps: float) -> DataFrame:
    """Points with their fine cell, whose diagonal is eps."""
    size = points.select(F.size("x")).first()[0]
    side = eps / size**0.5 * (1 - 1e-9)
    return points.withColumn("cell", F.expr(f"transform(x, v -> bigint(floor(v / {number_sql(side)})))"))


def _box(points: DataFrame) -> list[Column]:
    """The bounds of grouped points as aggregates ``lo`` and ``hi``."""
    size = points.select(F.size("x")).first()[0]
    return [
        F.expr(f"array({', '.join(f'{how}(x[{i}])' for i in range(size))})").alias(name)
        for how, name in (("min", "lo"), ("max", "hi"))
    ]


def _linked_cores(core: DataFrame, grid: list[tuple[int, float]], eps: float, block: int) -> DataFrame:
    """Core points with the least core point of their cluster as ``root``; core points of a cell are one node."""
    if core.isEmpty():
        return core.select("id", "x", F.col("id").alias("root"))
    ends = ["min_by(x, id)", *[f"{end}_by(x, x[{i}])" for i, _ in grid for end in ("min", "max")]]
    cells = settle(
        core.groupBy("cell", "alone").agg(
            F.min("id").alias("id"), *_box(core), F.expr(f"flatten(array({', '.join(ends)}))").alias("extremes")
        )
    )
    nodes = cells.select("id")
    members = core.join(cells.select("cell", "alone", F.col("id").alias("node")), ["cell", "alone"])
    members = members.select("id", "x", "node")
    # Low corners of boxes within eps of each other are within 2 eps: a box is at most eps wide.
    corners = cells.select("id", F.col("lo").alias("x"), "lo", "hi", "extremes")
    wide = _grid(corners, 2 * eps, cells.count(), block)
    met = settle(_meet(corners, corners, wide, block, _cell_links(eps), "a bigint, b bigint, sure boolean"))
    links = met.filter("sure").select("a", "b")
    found = settle(connected_components(links, nodes))
    open_pairs = met.filter("not sure").select("a", "b").distinct()
    for end in ("a", "b"):
        open_pairs = open_pairs.join(found.select(F.col("id").alias(end), F.col("root").alias(f"root_{end}")), end)
    open_pairs = settle(open_pairs.filter("root_a <> root_b").select("a", "b"))
    if not open_pairs.isEmpty():
        sides = []
        for own, other in (("a", "b"), ("b", "a")):
            bounds = cells.select(F.col("id").alias(other), "lo", "hi")
            asked = open_pairs.join(bounds, other).withColumn("node", F.col(own))
            near = members.join(asked, "node").filter(F.expr(f"{FROM_BOX} <= {number_sql(eps * eps)}"))
            sides.append(near.select("a", "b", "id", "x"))
        proved = _in_chunks(*sides, ["a", "b"], block, _any_close(eps), "a bigint, b bigint")
        found = connected_components(links.unionByName(proved.distinct()), nodes)
    return members.join(found.withColumnRenamed("id", "node"), "node").select("id", "x", "root")


def dbscan(
    df: DataFrame, features: list[str], eps: float = EPS, min_points: int = MIN_POINTS,
    label: str = "cluster", block: int = BLOCK,
) -> DataFrame:
    """Add the cluster number of each row, -1 for noise.

    A row is core if at least ``min_points`` rows (itself included) lie within
    ``eps``.  Clusters are numbered by their least core point in feature order; a
    border row within reach of several clusters joins the one with the least number.
    """
    points = merged_points(df, features)
    total = points.count()
    if not total:
        return df.withColumn(label, F.lit(NOISE))
    grid = _grid(points, eps, total, block)
    placed = _cells(points, eps)

    # A cell with a diagonal beyond eps comes from rounding only; its points are cells of their own.
    boxes = placed.groupBy("cell").agg(F.sum("w").alias("n"), *_box(placed))
    state = boxes.select("cell", F.expr(f"{DIAGONAL} <= {number_sql(eps * eps)}").alias("tight"), "n")
    placed = settle(
        placed.join(state, "cell").select(
            "id", "x", "w", "cell", F.when(F.col("tight"), F.lit(-1)).otherwise(F.col("id")).alias("alone"),
            (F.col("tight") & (F.col("n") >= min_points)).alias("dense"),
        )
    )
    sparse = placed.filter("not dense").select("id", "x")
    within = _meet(points, sparse, grid, block, _counts_within(eps), "id bigint, n bigint")
    counted = within.groupBy("id").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_points).select("id")
    core = placed.filter("dense").unionByName(placed.filter("not dense").join(counted, "id", "left_semi"))
    core = settle(core.select("id", "x", "cell", "alone"))

    rooted = settle(_linked_cores(core, grid, eps, block))
    others = placed.filter("not dense").select("id", "x").join(core.select("id"), "id", "left_anti")
    border = (
        _meet(rooted, others, grid, block, _least_root_within(eps), "id bigint, root bigint")
        .groupBy("id").agg(F.min("root").alias("root"))
    )
    roots = rooted.select("id", "root").unionByName(border)
    numbers = running_sums(
        rooted.select("root").distinct().withColumn("one", F.lit(1)), [F.col("root")], {"upto": "one"}
    ).select("root", (F.col("upto") - 1).alias("number"))
    labelled = (
        points.join(roots, "id", "left").join(numbers, "root", "left")
        .select(F.col("x").alias("_point"), F.coalesce("number", F.lit(NOISE)).cast("int").alias("_number"))
    )
    return df.withColumn("_own_point", point(df, features)).join(
        labelled, F.col("_own_point") == F.col("_point")
    ).select(
        *map(ref, df.columns), F.col("_number").alias(label)
    )
