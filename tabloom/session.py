"""Session helpers: a local test session and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows with whole texts are read in batches of so many, and written in row groups of about so many bytes.  Spark's 4,096
#: rows and 128 MB make arrays of tens of MB of such texts, for which a heap grows far beyond what is in use.
TEXT_ROWS, TEXT_GROUP_BYTES = 256, 2 << 20
_BATCH_ROWS = "spark.sql.parquet.columnarReaderBatchSize"
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = "*", app: str = "tabloom", **conf: str) -> SparkSession:
    """A session for tests and benches on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.scheduler.mode", "FAIR")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder checkpoints go to, as the session names it in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a
    cluster the folder has to be a shared one, so its absence is an error.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="tabloom-checkpoints-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def only_read(df: DataFrame) -> bool:
    """Whether ``df`` is Parquet files with columns worked out row by row, the same each time it is read."""
    plan = df._jdf.queryExecution().optimizedPlan()
    open_nodes = [plan]
    while open_nodes:
        node = open_nodes.pop()
        children = node.children()
        if node.nodeName() == "LogicalRelation":
            if not node.toString().rstrip().endswith(" parquet"):
                return False
        elif node.nodeName() not in ("Project", "Filter", "Union") or children.isEmpty():
            return False
        open_nodes += [children.apply(i) for i in range(children.size())]
    return plan.deterministic()


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the written copy.

    Used where a later step must see exactly the rows, ids or partition numbers
    of an earlier one, whatever executors are lost in between.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def _read_in_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Parquet read by jobs that start within comes in batches of so many rows at most; the setting is put back."""
    before = spark.conf.get(_BATCH_ROWS)
    spark.conf.set(_BATCH_ROWS, min(rows, int(before)))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_ROWS, before)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that start within remove their shuffle files when they end; the setting is put back."""
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)


def staged(df: DataFrame, texts: bool = False, drop_shuffles: bool = False) -> DataFrame:
    """Write ``df`` as a Parquet table in the checkpoint folder and read on from there.

    Used for a wide table that several passes go over: unlike a checkpoint, each
    pass then reads only the columns it needs.  With ``texts``, rows are read and
    written in small batches, so that long texts fill little memory at a time; a later
    pass never reads more than a row group at once.  With ``drop_shuffles``, the shuffle files that led
    to the table go as soon as it is written, instead of when the driver next collects its garbage; for
    steps that no other thread runs queries beside.
    """
    spark = df.sparkSession
    path, write = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}", df.write
    with ExitStack() as settings:
        if texts:
            settings.enter_context(_read_in_batches(spark, TEXT_ROWS))
            write = write.option("parquet.block.size", TEXT_GROUP_BYTES)
        if drop_shuffles:
            settings.enter_context(shuffles_dropped(spark))
        write.parquet(path)
    return spark.read.parquet(path)
