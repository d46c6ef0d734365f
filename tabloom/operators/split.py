"""Repeatable train / test split and class weights.

A row's place in the split is decided by a hash of its content, so it does not
depend on partitions or row order.  Exact shares come from histograms
of hash prefixes, which find each class's greatest test hash; the split itself
is then a comparison with it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabloom.functions.columns import content_hash, ref

TEST_SHARE = 0.25
SEED = 42
#: Hashes of one class that may be ordered in one task.
SINGLE_TASK_ROWS = 500_000
#: Classes up to which a table of one row per class is broadcast.
BROADCAST_CLASSES = 100_000
_PREFIX_DIGITS = 3  # hex digits a level: 4096 prefixes per class
_DIGITS = 32
_COPIES_PER_ROW = 100_000


def split_features(df: DataFrame, target: str | None) -> tuple[list[str], str | None]:
    """(feature columns, target or None if the table has no such column)."""
    if target is None or target not in df.columns:
        return list(df.columns), None
    return [c for c in df.columns if c != target], target


def _class_key(by: str | None) -> Column:
    """A text per class; null is the empty one, which no value's text is."""
    return F.lit("") if by is None else F.coalesce(F.concat(F.lit("="), ref(by).cast("string")), F.lit(""))


def sized_hint(per_class: DataFrame, classes: int) -> DataFrame:
    """Broadcast a table of one row per class while the classes are few; else Spark decides."""
    return F.broadcast(per_class) if classes <= BROADCAST_CLASSES else per_class


def _last_hashes(keyed: DataFrame, wanted: list[tuple[str, int, int]], limit: int) -> list[tuple[str, str, int, int]]:
    """Per class: greatest test hash, rows of that hash to take, rows that have it.

    ``wanted`` holds (class, test rows, rows).  Histograms of ever longer hash prefixes
    narrow a class down to at most ``limit`` rows (copies of one row stay one entry),
    then its full hashes are counted in order.
    """
    cuts = [(name, "", need) for name, need, _ in wanted]
    widest = max((n for _, _, n in wanted), default=0)
    known = digits = 0
    while digits < _DIGITS:
        digits = _DIGITS if widest <= limit else min(_DIGITS, known + _PREFIX_DIGITS)
        open_cuts = keyed.sparkSession.createDataFrame(cuts, "_class string, _cut string, _need bigint")
        inside = keyed.join(sized_hint(open_cuts, len(cuts)), "_class")
        if known:
            inside = inside.filter(F.substring("_hash", 1, known) == F.col("_cut"))
        histogram = inside.groupBy("_class", "_need", F.substring("_hash", 1, digits).alias("_prefix")).agg(
            F.count(F.lit(1)).alias("_n")
        )
        # At most 4096 longer prefixes, or ``limit`` full hashes, are left of a class.
        upto = Window.partitionBy("_class").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, 0)
        rows = (
            histogram.withColumn("_over", F.sum("_n").over(upto) - F.col("_need"))
            .filter((F.col("_over") >= 0) & (F.col("_over") < F.col("_n")))
            .select("_class", "_prefix", (F.col("_n") - F.col("_over")).alias("_need"), "_n")
            .collect()
        )
        cuts = [(r[0], r[1], r[2]) for r in rows]
        widest, known = max((r[3] for r in rows), default=0), digits
    return [tuple(r) for r in rows]


def _copies(rows: DataFrame, count: Column, flag: bool) -> DataFrame:
    """``count`` copies of each row, made in chunks so that no task builds them all."""
    chunks = F.sequence(F.lit(0), F.floor((count - 1) / _COPIES_PER_ROW))
    size = F.least(F.lit(_COPIES_PER_ROW), count - F.col("_chunk") * _COPIES_PER_ROW).cast("int")
    return (
        rows.filter(count > 0)
        .withColumn("_chunk", F.explode(chunks))
        .repartition(*map(ref, rows.columns), "_chunk")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), size)))
        .withColumn("is_test", F.lit(flag))
    )


def train_test_split(
    df: DataFrame,
    share: float = TEST_SHARE,
    by: str | None = None,
    seed: int = SEED,
    limit: int = SINGLE_TASK_ROWS,
    method: str = "xxhash64",
) -> DataFrame:
    """Add ``is_test``: exactly ceil(share * n) rows of each class, or of the whole table.

    Within a class the rows with the smallest content hash are the test rows.  If a
    class has a single row, or there are more classes than rows on one side, the
    split is not stratified.  The class list must fit the driver; it is one row per class.
    """
    names = df.columns
    keyed = df.withColumns({"_class": _class_key(by), "_hash": content_hash(df, seed, method)})
    sizes = keyed.groupBy("_class").agg(F.count(F.lit(1)).alias("n")).collect()
    total = sum(r.n for r in sizes)
    if by is not None and not _can_stratify([r.n for r in sizes], total, share):
        return train_test_split(df, share, None, seed, limit, method)
    wanted = [(r["_class"], math.ceil(share * r.n), r.n) for r in sizes]
    found = _last_hashes(keyed.select("_class", "_hash"), wanted, limit)
    last = df.sparkSession.createDataFrame(found, "_class string, _last string, _take bigint, _have bigint")
    # With few classes the split is one pass without a shuffle.
    placed = keyed.join(sized_hint(last, len(found)), "_class", "left")
    whole = placed.select(*map(ref, names), (F.col("_hash") <= F.col("_last")).alias("is_test"))
    if all(take == have for _, _, take, have in found):
        return whole
    # Some copies of one row belong to either side: count them and make that many.
    parted = (F.col("_hash") == F.col("_last")) & (F.col("_take") < F.col("_have"))
    decided = placed.filter(~parted).select(*map(ref, names), (F.col("_hash") <= F.col("_last")).alias("is_test"))
    grouped = placed.filter(parted).groupBy(*map(ref, names), "_take").agg(F.count(F.lit(1)).alias("_n"))
    for rows in (_copies(grouped, F.col("_take"), True), _copies(grouped, F.col("_n") - F.col("_take"), False)):
        decided = decided.unionByName(rows.select(*map(ref, names), "is_test"))
    return decided


def _can_stratify(sizes: list[int], total: int, share: float) -> bool:
    test = math.ceil(share * total)
    return min(sizes) >= 2 and test >= len(sizes) and total - test >= len(sizes)


def balanced_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Add the weight rows / (classes * rows of the class)."""
    counts = df.groupBy(ref(label).alias("_label")).agg(F.count(F.lit(1)).alias("_n"))
    facts = counts.agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("classes")).first()
    weights = counts.select(
        "_label",
        F.try_divide(F.lit(float(facts.rows or 0)), F.lit(float(facts.classes)) * F.col("_n")).alias(name),
    )
    joined = df.join(sized_hint(weights, facts.classes), ref(label).eqNullSafe(F.col("_label")))
    return joined.select(*map(ref, df.columns), name)


def positive_weight(train: DataFrame, label: str) -> DataFrame:
    """One row: majority / minority count of a two-class label, null otherwise."""
    counts = (
        train.filter(ref(label).isNotNull()).groupBy(ref(label)).agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.agg(
        F.when(
            F.count(F.lit(1)) == 2, F.try_divide(F.max("n").cast("double"), F.min("n").cast("double"))
        ).alias("positive_weight")
    )
