"""Distance-based operators against brute force, with blocks small enough to be cut and joined."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import density, neighbours
from tabloom.operators import silhouette as silhouettes
from tabloom.operators.density import connected_components, dbscan
from tabloom.operators.linkage import ward, ward_labels
from tabloom.operators.neighbours import mean_label, nearest, vote
from tabloom.operators.points import chunk_of
from tabloom.operators.silhouette import silhouette


def points(spark, values, *extra):
    width = values.shape[1]
    rows = [(i, *map(float, v), *(e[i].item() for e in extra)) for i, v in enumerate(values)]
    ddl = ["id bigint", *[f"f{j} double" for j in range(width)], *[f"e{j} bigint" for j in range(len(extra))]]
    return spark.createDataFrame(rows, ", ".join(ddl)), [f"f{j}" for j in range(width)]


def distances(a, b):
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(-1))


@pytest.mark.parametrize("block", [16, 2_048])
@pytest.mark.parametrize("copies", [0, 150])
def test_nearest_equals_brute_force(spark, block, copies):
    rng = np.random.default_rng(2)
    train = rng.normal(size=(300, 3)).round(2)
    train[:copies] = train[0]  # a hot point
    labels = rng.integers(0, 3, 300)
    asked = np.vstack([rng.normal(size=(70, 3)), train[:10]])
    t, f = points(spark, train, labels)
    q, _ = points(spark, asked)
    found = nearest(t, "e0", q, "id", f, k=5, block=block)
    votes = {r.qid: (r.prediction, r.score) for r in vote(found).collect()}
    means = {r.qid: r.prediction for r in mean_label(found).collect()}
    d = distances(asked, train)
    for i in range(len(asked)):
        best = labels[np.lexsort((labels, (d[i] ** 2).round(12)))[:5]]
        counts = np.bincount(best, minlength=3)
        assert votes[i] == (counts.argmax(), counts[1] / 5)
        assert means[i] == pytest.approx(best.mean())


def test_nearest_meets_each_place_once(spark, monkeypatch):
    """Many labels at few places, asked for by many equal queries."""
    rng = np.random.default_rng(5)
    train = np.arange(4.0)[rng.integers(0, 4, 300)][:, None]
    labels = rng.permutation(300)
    asked = np.arange(4.0)[rng.integers(0, 4, 200)][:, None] + 0.1
    met = {}
    for step in ("_with_cell", "_candidates"):
        def counted(rows, *rest, step=step, real=getattr(neighbours, step)):
            met[step] = rows.count()
            return real(rows, *rest)

        monkeypatch.setattr(neighbours, step, counted)
    t, f = points(spark, train, labels)
    q, _ = points(spark, asked)
    means = {r.qid: r.prediction for r in mean_label(nearest(t, "e0", q, "id", f, k=5, block=8)).collect()}
    assert met == {"_with_cell": 4 * 5, "_candidates": 4}
    d = distances(asked, train)
    for i in range(len(asked)):
        assert means[i] == pytest.approx(labels[np.lexsort((labels, (d[i] ** 2).round(12)))[:5]].mean())


def test_nearest_with_fewer_rows_than_neighbours(spark):
    t, f = points(spark, np.array([[0.0], [1.0]]), np.array([4, 8]))
    q, _ = points(spark, np.array([[0.2]]))
    assert mean_label(nearest(t, "e0", q, "id", f)).first().prediction == 6.0


def brute_dbscan(x, eps, least):
    near = distances(x, x) <= eps
    core = near.sum(1) >= least
    order = np.lexsort(x.T[::-1])
    label = np.full(len(x), -1)
    number = 0
    for i in order:
        if not core[i] or label[i] >= 0:
            continue
        todo = [i]
        label[i] = number
        while todo:
            for j in np.flatnonzero(near[todo.pop()] & core & (label < 0)):
                label[j] = number
                todo.append(j)
        number += 1
    for i in np.flatnonzero(~core):
        reach = label[near[i] & core]
        label[i] = reach.min() if len(reach) else -1
    return label


@pytest.mark.parametrize("block", [8, 2_048])
@pytest.mark.parametrize("width", [1, 2, 4])
def test_dbscan_equals_brute_force(spark, block, width):
    rng = np.random.default_rng(7)
    centres = rng.uniform(-3, 3, (6, width))
    x = np.vstack([centres[i % 6] + rng.normal(0, 0.25, width) for i in range(150)] + [rng.uniform(-4, 4, (30, width))])
    x[:60] = x[0]  # a third of the rows are copies
    df, f = points(spark, x)
    rows = dbscan(df, f, block=block).orderBy("id").collect()
    assert [r.cluster for r in rows] == brute_dbscan(x, 0.5, 5).tolist()


def test_dbscan_all_noise_and_one_point(spark):
    df, f = points(spark, np.array([[0.0, 0.0], [9.0, 9.0]]))
    assert [r.cluster for r in dbscan(df, f).collect()] == [-1, -1]
    same, f = points(spark, np.zeros((6, 2)))
    assert {r.cluster for r in dbscan(same, f).collect()} == {0}


@pytest.mark.parametrize("shape", ["rings", "lattice", "far"])
def test_dbscan_of_close_calls(spark, shape):
    """Cells whose boxes meet while their points do not, distances of exactly eps, values beyond cell numbers."""
    if shape == "rings":
        turn = np.linspace(0, 2 * np.pi, 90, endpoint=False)
        x = np.vstack([r * np.column_stack([np.cos(turn), np.sin(turn)]) for r in (0.6, 1.06, 1.6)])
        eps = 0.47
    elif shape == "lattice":
        x = np.stack(np.meshgrid(np.arange(7.0), np.arange(7.0), np.arange(3.0)), -1).reshape(-1, 3) / 2
        x = np.vstack([x, x[:40] + 8])
        eps = 0.5
    else:
        x = np.array([[1e19 + 4096.0 * i, 0.0] for i in range(8)] + [[0.1 * i, 1.0] for i in range(9)])
        eps = 4096.0
    df, f = points(spark, x)
    rows = dbscan(df, f, eps=eps, min_points=3, block=32).orderBy("id").collect()
    assert [r.cluster for r in rows] == brute_dbscan(x, eps, 3).tolist()


def compared(spark, monkeypatch, x, block):
    """How many distances the groups of a run hold, and its labels."""
    groups = []
    real = density._in_chunks

    def counted(home, visiting, keys, block, work, schema):
        groups.append((home, visiting, keys))
        return real(home, visiting, keys, block, work, schema)

    with monkeypatch.context() as patch:
        patch.setattr(density, "_in_chunks", counted)
        df, f = points(spark, x)
        labels = [r.cluster for r in dbscan(df, f, block=block).orderBy("id").collect()]
    total = 0
    for home, visiting, keys in groups:
        sizes = [s.groupBy(*keys).count().withColumnRenamed("count", n) for s, n in ((home, "m"), (visiting, "n"))]
        total += sizes[0].join(sizes[1], keys).agg(F.sum(F.col("m") * F.col("n"))).first()[0] or 0
    return total, labels


def test_dbscan_of_a_dense_cell_is_linear(spark, monkeypatch):
    rng = np.random.default_rng(3)
    around = np.vstack([rng.uniform(-3, 3, (40, 2)), rng.normal(2, 0.2, (30, 2))])
    work = []
    for n in (400, 1_600):
        x = np.vstack([around, rng.uniform(0.01, 0.3, (n, 2))])  # one cell of distinct points
        done, labels = compared(spark, monkeypatch, x, block=64)
        assert labels == brute_dbscan(x, 0.5, 5).tolist()
        work.append(done)
    assert work[1] < 4.2 * work[0]
    assert work[1] < 1_600 * len(around) * 2


def test_dbscan_of_copied_rows_over_many_cells(spark):
    """Every cell is dense and most groups of cells have an empty side."""
    rng = np.random.default_rng(11)
    x = np.repeat(np.column_stack([rng.integers(0, 25, 1_000) * 0.139, rng.uniform(-1.7, 1.7, 1_000)]), 5, axis=0)
    df, f = points(spark, x)
    assert {r.cluster for r in dbscan(df, f).select("cluster").distinct().collect()} == {0}


def test_components_of_a_long_chain(spark):
    nodes = spark.range(201)
    chain = spark.range(99).selectExpr("(id * 37) % 100 as a", "((id * 37) % 100 + 1) % 101 as b").union(
        spark.createDataFrame([(150, 151), (151, 152), (200, 200)], "a bigint, b bigint")
    )
    roots = {r.id: r.root for r in connected_components(chain, nodes).collect()}
    assert roots[152] == 150 and roots[200] == 200 and roots[149] == 149
    assert len(roots) == 201


def test_few_links_are_read_by_one_task(spark, monkeypatch):
    """A small table is not dealt over all shuffle partitions round after round."""
    written = []
    monkeypatch.setattr(density, "settle", lambda df, real=density.settle: written.append(real(df)) or written[-1])
    changed = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in changed}
    for name, value in changed.items():
        spark.conf.set(name, value)
    try:
        links = spark.range(20).selectExpr("id as a", "id + 1 as b")
        assert {r.root for r in connected_components(links, spark.range(21)).collect()} == {0}
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len(written) > 2 and {df.rdd.getNumPartitions() for df in written[1:]} == {1}


def brute_silhouette(x, labels):
    d = distances(x, x)
    scores = []
    for i in range(len(x)):
        own = labels == labels[i]
        if own.sum() == 1:
            scores.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, labels == c].mean() for c in set(labels.tolist()) - {labels[i]})
        scores.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(scores))


@pytest.mark.parametrize("block", [16, 2_048])
def test_silhouette_equals_brute_force(spark, block):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 3)) + rng.integers(0, 3, 120)[:, None] * 2
    x[:40] = x[0]
    labels = rng.integers(-1, 3, 120)
    labels[5] = 9  # a cluster of one
    df, f = points(spark, x, labels)
    found = silhouette(df, f, "e0", block=block).first()[0]
    assert found == pytest.approx(brute_silhouette(x, labels))


def test_silhouette_of_many_features_in_few_blocks(spark, monkeypatch):
    """Blocks larger than a tile, copies in two clusters, and values far from zero."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 12)) + rng.integers(0, 3, 90)[:, None] * 2
    x[:20] = x[0]
    x[30:60] += 1e7
    labels = rng.integers(0, 3, 90)
    df, f = points(spark, x, labels)
    blocks = []
    monkeypatch.setattr(silhouettes, "MOST_BLOCKS", 2, raising=False)
    monkeypatch.setattr(silhouettes, "chunk_of", lambda key, n: blocks.append(str(n)) or chunk_of(key, n))
    found = silhouette(df, f, "e0", block=16).first()[0]
    assert found == pytest.approx(brute_silhouette(x, labels), abs=1e-9)
    assert blocks == [str(F.lit(2))]


def test_silhouette_needs_two_clusters_and_fewer_than_rows(spark):
    df, f = points(spark, np.arange(6.0).reshape(3, 2), np.array([0, 0, -1]))
    assert np.isnan(silhouette(df, f, "e0").first()[0])
    df, f = points(spark, np.arange(6.0).reshape(3, 2), np.array([0, 1, 2]))
    assert np.isnan(silhouette(df, f, "e0").first()[0])


def blobs(n=120):
    rng = np.random.default_rng(0)
    centres = np.array([[0, 0], [5, 5], [-5, 5]], dtype=float)
    truth = np.arange(n) % 3
    return centres[truth] + rng.normal(0, 0.5, (n, 2)), truth


def same_parts(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("limit", [500, 20])
def test_ward_finds_blobs(spark, limit):
    x, truth = blobs()
    df, f = points(spark, x, truth)
    rows = ward(df, f, k=3, limit=limit).collect()
    assert same_parts([r.cluster for r in rows], [r.e0 for r in rows])


def test_ward_weights_stand_for_copies():
    x = np.array([[0.0], [1.0], [1.9], [6.0]])
    sizes = np.array([1, 5, 1, 1])
    spread = np.repeat(x, sizes, axis=0)
    whole = ward_labels(spread, np.ones(len(spread)), 2)
    merged = ward_labels(x, sizes, 2)
    assert np.repeat(merged, sizes).tolist() == whole.tolist()
