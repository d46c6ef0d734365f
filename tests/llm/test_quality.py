"""The minimum-determinant search against random subsets in numpy."""

import glob

import numpy as np
import pyarrow.parquet as pq

import pytest
from pyspark.sql import functions as F

from tabloom.llm import quality
from tabloom.session import TEXT_GROUP_BYTES, ensure_checkpoint_dir


def log_det(rows):
    spreads = np.diag([least**2 for _, least in quality.FEATURES])
    return np.linalg.slogdet(np.cov(rows.T, bias=True) + spreads)[1]


def searched(x, rng, starts=60):
    """Least log-determinant over many random starts, each concentrated until it stays."""
    h, best = int(np.ceil(quality.SUPPORT * len(x))), np.inf
    spreads = np.diag([least**2 for _, least in quality.FEATURES])
    for _ in range(starts):
        rows = x[rng.choice(len(x), 10, replace=False)]
        for _ in range(30):
            gap = x - rows.mean(axis=0)
            d = np.einsum("ij,ij->i", gap @ np.linalg.inv(np.cov(rows.T, bias=True) + spreads), gap)
            rows = x[np.argsort(d)[:h]]
        best = min(best, log_det(rows))
    return best


def test_least_determinant_equals_many_random_starts(spark):
    rng = np.random.default_rng(8)
    width = len(quality.FEATURES)
    mix = np.eye(width) + 0.6 * np.tri(width, k=-1)
    clean = rng.normal(size=(320, width)) @ mix.T
    apart = rng.normal(size=(80, width)) * 0.3 + np.array([6.0, -5, 4, 6, -6, 5])
    x = np.vstack([clean, apart])
    df = spark.createDataFrame(
        [("g", *map(float, r)) for r in x] + [("one", *([1.0] * width)) for _ in range(5)],
        "_group string, " + ", ".join(f"_x{i} double" for i in range(width)),
    )
    found = {r._group: r for r in quality._least_determinant(df).collect()}
    best = searched(x, rng)
    # Whole bands of distance are taken, so a few rows more than the share may be in.
    assert best - 1e-6 <= found["g"]._log_det <= best + 0.15
    centre = np.array([found["g"][f"m{i}"] for i in range(width)])
    assert np.abs(centre - clean.mean(axis=0)).max() < 0.4
    assert [found["one"][f"m{i}"] for i in range(width)] == [1.0] * width


def test_no_rows(spark):
    empty = spark.createDataFrame([], "_group string, " + ", ".join(f"_x{i} double" for i in range(len(quality.FEATURES))))
    assert quality._least_determinant(empty).count() == 0


def test_groups_beyond_a_broadcast(spark, monkeypatch):
    """Joining by group and salt gives what a broadcast gives, with a group of most rows, null keys and repeated rows."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source")
    docs = docs.unionByName(docs.withColumn("lang", F.lit(None).cast("string"))).unionByName(docs.withColumn("source", F.lit("hot")))

    def verdicts():
        rows = quality.quality_rules(docs, carry=["doc_id", "lang", "source"]).select("_row.*", "n_words", "base_failed", "distance", "kept")
        return sorted(rows.collect(), key=lambda r: (r.doc_id, str(r.lang), str(r.source), r.distance or 0.0))

    sent = verdicts()
    monkeypatch.setattr(quality, "BROADCAST_BYTES", -1)
    salted = verdicts()
    assert len(sent) == len(salted) == docs.count()
    for one, two in zip(sent, salted, strict=True):
        assert one[:5] == two[:5] and one.kept == two.kept
        assert one.distance == pytest.approx(two.distance, rel=1e-6) if one.distance is not None else two.distance is None


def test_texts_are_written_in_small_row_groups(spark):
    """Long texts are staged whole, in row groups that bound what a reader holds; the session's batch size is as it was."""
    name, folder = "spark.sql.parquet.columnarReaderBatchSize", ensure_checkpoint_dir(spark).removeprefix("file:")
    before, seen = spark.conf.get(name), set(glob.glob(f"{folder}/table-*"))
    docs = spark.range(0, 3000, 1, 1).select(
        F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("web").alias("source"),
        F.expr("array_join(transform(sequence(1, 60), k -> sha2(concat(id, '-', k), 256)), ' ')").alias("text"),
    )
    found = quality.quality_rules(docs)
    assert found.agg(F.count("*"), F.sum(F.length("_row.text"))).first()[:] == (3000, 3000 * (60 * 65 - 1))
    assert spark.conf.get(name) == before
    tables = set(glob.glob(f"{folder}/table-*")) - seen
    files = [pq.ParquetFile(f).metadata for table in tables for f in glob.glob(f"{table}/*.parquet")]
    groups = [m.row_group(i).total_byte_size for m in files for i in range(m.num_row_groups)]
    assert sum(groups) > 3 * TEXT_GROUP_BYTES > max(groups)
