"""Order-based facts without ever sorting a table in one task.

``value_facts`` takes exact quantiles and distinct counts of all columns from one
histogram of their values in order.  ``order_statistics`` finds exact quantiles by narrowing value brackets with
map-side-combined aggregates.  ``running_sums`` adds cumulative sums over a
global order with a range partitioning and one offset per partition.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tabloom.functions.columns import as_double, is_fractional, is_integral, present_sql
from tabloom.session import shuffles_dropped, staged

#: Rows up to which a bracket or a running sum is finished in one task.
SINGLE_TASK_ROWS = 200_000
#: Values that are shuffled at once; more are dealt by their hash over rounds, and a round's files go before the next one.
VALUES_AT_ONCE = 100_000_000


@dataclass
class _Rank:
    """One sought order statistic: the value at 0-based rank ``k`` of column ``slot``."""

    slot: int
    k: int
    low: float | None = None  # None: unbounded
    high: float | None = None
    below: int = 0  # values <= low
    inside: int = 0  # values strictly between low and high
    value: float | None = None
    bounds: tuple[float, float] = field(default=(0.0, 0.0))


def _between(x: Column, rank: _Rank) -> Column:
    """The value where it lies strictly inside the bracket, else null."""
    inside = F.lit(True)
    if rank.low is not None:
        inside = inside & (x > F.lit(rank.low))
    if rank.high is not None:
        inside = inside & (x < F.lit(rank.high))
    return F.when(inside, x)


def _narrow(df: DataFrame, columns: list[Column], ranks: list[_Rank], accuracy: int) -> None:
    """Two passes: guess an inner bracket by sketch, then count exactly and keep what holds."""
    brackets: dict[tuple, list[_Rank]] = {}
    for r in ranks:
        brackets.setdefault((r.slot, r.low, r.high), []).append(r)
    sketches = []
    for group in brackets.values():
        fractions = []
        for r in group:
            centre, spread = (r.k - r.below) / max(1, r.inside - 1), 2.0 / accuracy
            fractions += [max(0.0, centre - spread), min(1.0, centre + spread)]
        sketches.append(F.percentile_approx(_between(columns[group[0].slot], group[0]), fractions, accuracy))
    for group, guess in zip(brackets.values(), df.agg(*sketches).first(), strict=True):
        for i, r in enumerate(group):
            r.bounds = (guess[2 * i], guess[2 * i + 1])

    counts: dict[tuple, Column] = {}
    for r in ranks:  # neighbouring ranks mostly share bracket and guess
        x = _between(columns[r.slot], r)
        a, b = (F.lit(v) for v in r.bounds)
        counts[r.slot, r.low, r.high, r.bounds] = F.struct(
            F.count_if(x < a).alias("lt_a"),
            F.count_if(x == a).alias("eq_a"),
            F.count_if((x > a) & (x < b)).alias("mid"),
            F.count_if(x == b).alias("eq_b"),
        )
    found = dict(zip(counts, df.agg(*counts.values()).first(), strict=True))
    asked = [(r, (r.slot, r.low, r.high, r.bounds)) for r in ranks]
    for r, c in [(r, found[key]) for r, key in asked]:
        a, b = r.bounds
        offset = r.k - r.below
        if offset < c.lt_a:
            r.high, r.inside = a, c.lt_a
        elif offset < c.lt_a + c.eq_a:
            r.value = a
        elif a < b and offset < c.lt_a + c.eq_a + c.mid:
            r.low, r.high = a, b
            r.below += c.lt_a + c.eq_a
            r.inside = c.mid
        elif a < b and offset < c.lt_a + c.eq_a + c.mid + c.eq_b:
            r.value = b
        else:
            seen = c.lt_a + c.eq_a + ((c.mid + c.eq_b) if a < b else 0)
            r.low = b
            r.below += seen
            r.inside -= seen


def order_statistics(
    df: DataFrame,
    columns: list[Column],
    wanted: list[tuple[int, int]],
    counts: list[int],
    limit: int = SINGLE_TASK_ROWS,
    accuracy: int = 10_000,
) -> dict[tuple[int, int], float]:
    """Exact values at (column slot, 0-based rank), each column of doubles without NaN.

    Every round cuts a bracket to about 4/accuracy of its rows and always drops
    its end points, so heavy ties cannot stall it.  A bracket of at most
    ``limit`` rows is finished by sorting it in one task.
    """
    ranks = {key: _Rank(slot=key[0], k=key[1], inside=counts[key[0]]) for key in wanted}
    while True:
        wide = [r for r in ranks.values() if r.value is None and r.inside > limit]
        if not wide:
            break
        _narrow(df, columns, wide, accuracy)
    last = [r for r in ranks.values() if r.value is None]
    if last:
        picks = [
            F.get(F.sort_array(F.collect_list(_between(columns[r.slot], r))), F.lit(r.k - r.below))
            for r in last
        ]
        for r, value in zip(last, df.agg(*picks).first(), strict=True):
            r.value = value
    return {key: r.value for key, r in ranks.items()}


def value_facts(
    df: DataFrame, names: list[str], fractions: list[float], counts: dict[str, int]
) -> dict[str, tuple[list[float | None], int]]:
    """(quantiles, distinct values) per numeric column, from the histogram of its values.

    The different values of all columns are counted, partial counts first, and put in one order by
    range partitioning.  The driver sees one count per column and partition; the
    partitions that hold a sought rank then add up their own counts.  Beyond ``VALUES_AT_ONCE`` values, which would
    fill the disk twice over, brackets are narrowed instead and distinct values are counted column by column in rounds.
    """
    if sum(counts[n] for n in names) > VALUES_AT_ONCE:
        quantiles_of = narrowed_quantiles(df, names, fractions, counts)
        return {n: (quantiles_of[n], _distinct_in_rounds(df, n, counts[n])) for n in names}
    result: dict[str, tuple[list[float | None], int]] = {n: ([None] * len(fractions), 0) for n in names}
    for family, members in by_family(df, [n for n in names if counts[n]]).items():
        slim = df.selectExpr(*[f"cast({present_sql(df, n)} as {family}) as `{i}`" for i, n in enumerate(members)])
        counted = (
            slim.unpivot([], slim.columns, "slot", "value").filter("value is not null")
            .groupBy("slot", "value").agg(F.count(F.lit(1)).alias("n"))
        )
        placed = staged(counted.repartitionByRange("slot", "value").withColumn("part", F.spark_partition_id()))
        parts = placed.groupBy("slot", "part").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct")).collect()
        sought, distinct = [], dict.fromkeys(members, 0)
        for slot, name in enumerate(members):
            ranks = sorted({f((counts[name] - 1) * q) for q in fractions for f in (math.floor, math.ceil)})
            at = 0
            for row in sorted((r for r in parts if int(r.slot) == slot), key=lambda r: r.part):
                distinct[name] += row.distinct
                sought += [(slot, row.part, rank, rank - at) for rank in ranks if at <= rank < at + row.n]
                at += row.n
        # At most two ranks for each column and fraction are looked for, in their partitions.
        held = placed.filter(" or ".join(f"(slot = {slot} and part = {part})" for slot, part in sorted({x[:2] for x in sought})))
        upto = F.sum("n").over(Window.partitionBy("slot", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
        ranks_of = "array(" + ", ".join(f"named_struct('s', {s}, 'p', {p}, 'k', {k}L, 'w', {w}L)" for s, p, k, w in sought) + ")"
        values = held.withColumn("upto", upto).select(
            "slot", F.col("value").cast("double").alias("value"),
            F.expr(f"filter({ranks_of}, r -> r.s = slot and r.p = part and r.w < upto and r.w >= upto - n).k").alias("ranks"),
        )
        found = {(int(r.slot), k): r.value for r in values.filter("size(ranks) > 0").collect() for k in r.ranks}
        for slot, name in enumerate(members):
            quantiles_of = []
            for q in fractions:
                place = (counts[name] - 1) * q
                quantiles_of.append(_between_ranks(found[slot, math.floor(place)], found[slot, math.ceil(place)], place))
            result[name] = (quantiles_of, distinct[name])
    return result


def _between_ranks(low: float, high: float, place: float) -> float:
    """The quantile at ``place`` from the values at the ranks around it."""
    return low + (high - low) * (place - math.floor(place)) if low != high else low


def rounds(key: str, values: int) -> list[str]:
    """Conditions that deal rows by the hash of ``key`` over rounds of about ``VALUES_AT_ONCE`` values; equal keys share one."""
    n = max(1, -(-values // VALUES_AT_ONCE))
    return [f"pmod(xxhash64({key}), {n}) = {i}" for i in range(n)] if n > 1 else ["true"]


def _distinct_in_rounds(df: DataFrame, name: str, count: int) -> int:
    """Exact distinct values of one column, compared in its family's type."""
    family = next(iter(by_family(df, [name])))
    values = df.selectExpr(f"cast({present_sql(df, name)} as {family}) as value").filter("value is not null")
    with shuffles_dropped(df.sparkSession):
        return sum(values.filter(cut).distinct().count() for cut in rounds("value", count)) if count else 0


def by_family(df: DataFrame, names: list[str]) -> dict[str, list[str]]:
    """Columns by the type their values are compared in."""
    families: dict[str, list[str]] = {}
    for name in names:
        dtype = df.schema[name].dataType
        if is_integral(dtype):
            family = "bigint"
        elif isinstance(dtype, T.DecimalType):
            family = dtype.simpleString()
        else:
            family = "double" if is_fractional(dtype) else "string"
        families.setdefault(family, []).append(name)
    return families


def quantiles(
    df: DataFrame, names: list[str], fractions: list[float], counts: dict[str, int]
) -> dict[str, list[float | None]]:
    """Exact linearly interpolated quantiles per numeric column; null where no value is present.

    ``counts`` holds the present values per column, which the caller has from an earlier pass.
    """
    if sum(counts[n] for n in names) > VALUES_AT_ONCE:
        return narrowed_quantiles(df, names, fractions, counts)
    return {n: q for n, (q, _) in value_facts(df, names, fractions, counts).items()}


def narrowed_quantiles(
    df: DataFrame, names: list[str], fractions: list[float], counts: dict[str, int], limit: int = SINGLE_TASK_ROWS
) -> dict[str, list[float | None]]:
    """As :func:`quantiles`, by narrowing brackets: shuffles no values, but reads the table several times."""
    filled = [n for n in names if counts[n] > 0]
    result: dict[str, list[float | None]] = {n: [None] * len(fractions) for n in names}
    sizes = [counts[n] for n in filled]
    places = {
        (slot, q): (size - 1) * q for slot, size in enumerate(sizes) for q in fractions
    }
    wanted = sorted(
        {(slot, k) for (slot, _), p in places.items() for k in (math.floor(p), math.ceil(p))}
    )
    found = order_statistics(df, [as_double(df, n) for n in filled], wanted, sizes, limit) if filled else {}
    for slot, name in enumerate(filled):
        values = []
        for q in fractions:
            place = places[slot, q]
            values.append(_between_ranks(found[slot, math.floor(place)], found[slot, math.ceil(place)], place))
        result[name] = values
    return result


def running_sums(
    df: DataFrame, order: list[Column], sums: dict[str, str], limit: int = SINGLE_TASK_ROWS
) -> DataFrame:
    """Add ``{new column: summed column}`` running sums over a global order without ties.

    Rows must already be one per order key (aggregate first).  A small table is
    one window.  A larger one is range partitioned on the order, written once so
    that partition numbers stay as they are, and each partition's window starts
    from the total of the partitions before it (one small row per partition).
    """
    if df.limit(limit + 1).count() <= limit:
        whole = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(c).over(whole).alias(new) for new, c in sums.items()])

    placed = staged(
        df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_part").agg(*[F.sum(c).alias(new) for new, c in sums.items()])
    offsets = totals.select(
        "_part",
        *[F.coalesce(F.sum(new).over(before), F.lit(0)).alias("_o_" + new) for new in sums],
    )
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # One offset row per shuffle partition: small whatever the data size.
    joined = placed.join(F.broadcast(offsets), "_part")
    return joined.select(
        *df.columns,
        *[(F.sum(c).over(within) + F.col("_o_" + new)).alias(new) for new, c in sums.items()],
    )
