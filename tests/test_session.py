import glob
import os
import random
import time

import pytest

from tabloom.llm.repeats import remove_repeats
from tabloom.session import staged

DROP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark):
    """Bytes of each shuffle file on this machine's disk."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f: os.path.getsize(f) for d in folders for f in glob.glob(f"{d.getPath()}/*/shuffle_*.data")}


def left_behind(spark, before, most):
    """Bytes of new shuffle files, after up to ten seconds for Spark to remove them."""
    for _ in range(50):
        left = sum(size for f, size in shuffle_files(spark).items() if f not in before)
        if left <= most:
            break
        time.sleep(0.2)
    return left


def test_repeats_keep_no_shuffle_files_between_rounds(spark):
    some = random.Random(7)
    words = [f"{some.getrandbits(40):x}" for _ in range(40_000)]
    docs = spark.createDataFrame([(i, " ".join(words[200 * i : 200 * i + 300])) for i in range(200)], "doc_id bigint, text string")
    before = shuffle_files(spark)
    found = remove_repeats(docs)
    assert left_behind(spark, before, 20_000) <= 20_000  # the rounds shuffle about a million bytes
    by = {r.doc_id: r for r in found.collect()}
    assert all(by[i].n_spans == 2 for i in range(1, 199)) and by[0].n_spans == by[199].n_spans == 1


@pytest.mark.parametrize("before", [None, "false", "true"])
def test_staging_puts_the_setting_back(spark, before):
    if before is None:
        spark.conf.unset(DROP)
    else:
        spark.conf.set(DROP, before)
    try:
        table = staged(spark.range(1000).repartition(4, "id"), drop_shuffles=True)
        assert spark.conf.get(DROP) == (before or "false")
        assert table.count() == 1000 and sorted(r.id for r in table.collect()) == list(range(1000))
        with pytest.raises(Exception):
            staged(spark.range(10).selectExpr("raise_error('no') AS x"), drop_shuffles=True)
        assert spark.conf.get(DROP) == (before or "false")
    finally:
        spark.conf.unset(DROP)
