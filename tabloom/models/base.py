"""What a model of the zoo is, and the table views it works on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import quoted, ref
from tabloom.session import settle

SEED = 42
#: Rows a training partition should hold; small tables get few partitions, so that
#: iterative fits are not dominated by scheduling, and large ones enough for every core.
ROWS_PER_PARTITION = 25_000
#: Once every core has several partitions, narrow rows fill them up to this, since an iteration costs a task a partition.
MAX_ROWS_PER_PARTITION, VALUES_PER_PARTITION = 100_000, 2_000_000
PARTITIONS_PER_CORE = 4
#: Feature values of all rows up to which these are shared by the models as a copy in memory, which falls back to disk.
HELD_VALUES = 100_000_000


@dataclass
class Fold:
    """Training and test rows: ``id``, ``features`` (vector), ``x`` (array), ``label``.

    For clustering both sides are the same rows and ``label`` is absent.  Rows that are not
    ``held`` are read anew by each pass, and an ``id`` then holds for one pass only.
    """

    train: DataFrame
    test: DataFrame
    n_train: int
    n_test: int
    width: int
    classes: list = field(default_factory=list)
    class_rows: list[int] = field(default_factory=list)  # training rows per class
    held: bool = True

    def numbered_test(self) -> DataFrame:
        """The test rows with ids that hold for any number of passes."""
        return self.test if self.held else settle(self.test)


@dataclass(frozen=True)
class ModelSpec:
    """One fixed configuration.

    ``run`` fits on the fold and returns the test rows with ``prediction`` (and
    ``score`` for two classes), plus parameters found out at run time.
    """

    name: str
    family: str
    params: dict[str, str]
    run: Callable[[Fold], tuple[DataFrame, dict[str, str]]]


def vector_rows(df: DataFrame, features: list[str], *others: str) -> DataFrame:
    """Features as array ``x`` and vector ``features``, with further columns kept; one vector column is taken as it is, without ``x``."""
    if len(features) == 1 and isinstance(df.schema[features[0]].dataType, VectorUDT):
        return df.select(*others, ref(features[0]).alias("features"))
    x = F.expr(f"array({', '.join(f'double({quoted(f)})' for f in features)})")
    return df.select(*others, x.alias("x")).withColumn("features", array_to_vector("x"))


def with_array(rows: DataFrame) -> DataFrame:
    """``x`` from ``features``, worked out only where a model asks for it, so that rows are stored once and sparse ones never dense."""
    return rows if "x" in rows.columns else rows.withColumn("x", vector_to_array("features"))


def sized(df: DataFrame, rows: int, width: int = VALUES_PER_PARTITION) -> DataFrame:
    """Spread over as many partitions as the row count is worth, however few files the rows come from.

    ``width`` is the number of features of a row; without it rows count as wide.
    """
    wanted = max(1, -(-rows // ROWS_PER_PARTITION))
    enough = PARTITIONS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism
    if wanted > enough:
        fitting = max(ROWS_PER_PARTITION, min(MAX_ROWS_PER_PARTITION, VALUES_PER_PARTITION // max(1, width)))
        wanted = max(enough, -(-rows // fitting))
    return df.repartition(wanted) if wanted > 1 else df.coalesce(1)
