"""Every registered query that has SQL against DuckDB, at the smallest scale."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from check_queries import cells
from tabloom.plans.registered import scaled_customers

FOLDER = "/root/testdata/sf0.001"
#: Whole fits of the zoo, which test_experiments covers, and text operators; check_queries.py runs them all.
ELSEWHERE = ("classify_", "regress_", "cluster_k", "cluster_g", "cluster_w", "cluster_d", "study_of_customers", "experiments_", "op")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", [n for n in oracle_sql() if not n.startswith(ELSEWHERE)])
def test_query_equals_sql(spark, duck, name):
    ours = queries()[name](spark, FOLDER)
    result = duck.execute(oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(ours.columns) == sorted(columns)
    theirs = [dict(zip(columns, r, strict=True)) for r in result.fetchall()]
    assert sorted(cells(r.asDict()) for r in ours.collect()) == sorted(map(cells, theirs))


def test_customers_with_equal_values_are_all_clustered(spark, tmp_path):
    df = spark.read.parquet(f"{FOLDER}/customer.parquet")
    df.unionByName(df.withColumn("c_custkey", F.col("c_custkey") + 1_000_000)).write.parquet(f"{tmp_path}/customer.parquet")
    assert scaled_customers(spark, str(tmp_path)).df.count() == 2 * df.count()


def test_entry(spark):
    assert entry(spark).count() == 11
