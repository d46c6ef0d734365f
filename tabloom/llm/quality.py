"""Quality rules: fixed limits on text statistics, and robust outliers among what passes them.

The statistics of a text are made by built-in functions only.  Rows that pass the
fixed limits are put in groups of one language and source; small groups are merged
per language, and small languages into one.  For each group the location and scatter
of transformed statistics are estimated by the minimum covariance determinant: from
three deterministic starts, concentration steps re-estimate both from the share of
rows with the smallest Mahalanobis distances until no determinant falls any more, and each group keeps
the start with the least determinant.  A row far from its group is rejected.

One concentration step is one aggregate for all starts: rows are counted and summed per group and
narrow band of distance, and the bands up to the wanted share are added up.  A
group of any size is combined before the shuffle; no group meets in one task.

Defined cases: a null or empty text has no words and fails the limits; null language
or source is a value of its own; equal rows count as often as they occur; an
empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import ref
from tabloom.llm.common import UPPER, packed, words_of
from tabloom.session import staged

WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
SYMBOLS = "#*$%&|<>"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: The vector of a text: (SQL, least standard deviation that counts as spread of the group).
FEATURES = (
    ("ln(try_divide(word_chars, n_words))", 0.08),
    ("sqrt(try_divide(n_symbols, word_chars))", 0.05),
    ("sqrt(try_divide(n_upper, word_chars))", 0.05),
    ("sqrt(try_divide(n_dup_lines, n_words))", 0.04),
    ("sqrt(try_divide(n_repeat_words, n_words))", 0.14),
    ("sqrt(try_divide(n_stutters, n_words))", 0.12),
)
SUPPORT = 0.75
#: Fall of a log-determinant below which a start has settled.  It cannot fall for ever, as the least spreads bound it.
SETTLED = 1e-3
MIN_GROUP = 200
#: Squared distance beyond which a row is rejected, in units where its median is that of chi-square.
CUTOFF = 30.0
CHI_SQUARE_MEDIAN = 5.34812  # of as many degrees of freedom as features
BANDS_PER_OCTAVE = 16
#: Group facts up to this size as text are broadcast to the rows; larger ones meet them by group and salt.
BROADCAST_BYTES = 32 << 20
SALTS = 64

_K = range(len(FEATURES))
_PAIRS = list(combinations_with_replacement(_K, 2))


def _white_removed(text: Column) -> Column:
    return F.translate(text, " \t\n\x0b\x0c\r", "")


def with_statistics(rows: DataFrame, text: Column) -> DataFrame:
    """Add the statistics of a text, as longs, by built-in functions."""
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda line: _white_removed(line) != "")
    rows = rows.withColumn("_text", text)
    rows = rows.withColumn("_words", words_of(F.col("_text"))).withColumn("_lines", lines)
    rows = rows.withColumn(
        "_windows",
        F.when(
            F.size("_words") > WINDOW,
            F.transform(
                F.sequence(F.lit(1), F.size("_words") - WINDOW + 1), lambda i: F.xxhash64(F.slice("_words", i, WINDOW))
            ),
        ),
    )
    rows = rows.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    # `_sorted` and `_at` are columns of their own, so that no lambda makes them anew for each element.
    rows = rows.withColumn(
        "_at",
        F.expr(
            "array_sort(transform(filter(_sorted, (x, k) -> x.h = get(_sorted, k - 1).h or x.h = get(_sorted, k + 1).h),"
            " x -> x.i))"
        ),
    )
    covered = F.expr(
        f"aggregate(transform(_at, (v, k) -> least({WINDOW}, coalesce(get(_at, k + 1) - v, {WINDOW}))), 0, (a, b) -> a + b)"
    )
    kept = _white_removed(F.col("_text"))
    rows = rows.withColumn("word_chars", F.length(kept).cast("long"))
    return rows.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "n_symbols": (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long"),
            "n_upper": (F.length("_text") - F.length(F.translate("_text", UPPER, ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_stutters": F.expr("size(filter(_words, (w, i) -> w = get(_words, i - 1)))").cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        }
    ).drop("_text", "_words", "_lines", "_windows", "_sorted", "_at")


def _spread_join(rows: DataFrame, facts: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join rows with the facts of their group, so that no group's rows meet in one task.

    Facts whose size, as text, is within ``BROADCAST_BYTES`` are broadcast; beyond it they are repeated for each salt, and rows are
    shuffled by group and salt.  A shuffle by group alone would also serve the next sums, which would then not be pre-aggregated.
    """
    size = facts.agg(F.sum(F.octet_length(F.to_json(F.struct(*facts.columns))))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(facts), keys, how)
    repeated = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return rows.join(repeated, [*keys, "_salt"], how)


def _grouped(rows: DataFrame) -> DataFrame:
    """Add the group: (language, source), or language alone, or neither, by the rows that passed."""
    named = rows.withColumns({"_lang": F.struct(F.col("_lang")), "_source": F.struct(F.col("_source"))})
    passed = F.count_if(~F.col("base_failed"))
    pairs = named.groupBy("_lang", "_source").agg(passed.alias("_n"))
    small = pairs.filter(F.col("_n") < MIN_GROUP).groupBy("_lang").agg(F.sum("_n").alias("_rest"))
    keys = pairs.join(small, "_lang", "left").select(
        "_lang", "_source",
        F.when(F.col("_n") >= MIN_GROUP, F.to_json(F.struct("_lang", "_source")))
        .when(F.col("_rest") >= MIN_GROUP, F.to_json(F.struct("_lang")))
        .otherwise(F.lit("")).alias("_group"),
    )
    return _spread_join(named, staged(keys), ["_lang", "_source"]).drop("_lang", "_source")


def _starts(rows: DataFrame) -> DataFrame:
    """Three starts a group: medians with quartile spreads and no covariances, plain moments, and medians with the
    correlations of values pressed together by the hyperbolic tangent."""
    quartiles = [f"percentile_approx(_x{i}, array(0.25D, 0.5D, 0.75D), 1000) as q{i}" for i in _K]
    middle = staged(
        rows.groupBy("_group").agg(*[F.expr(q) for q in quartiles]).selectExpr(
            "_group",
            *[f"q{i}[1] as a{i}" for i in _K],
            *[f"sqrt(power((q{i}[2] - q{i}[0]) / 1.349, 2) + {FEATURES[i][1] ** 2}D) as b{i}" for i in _K],
        )
    )
    pressed = _spread_join(rows, middle, ["_group"]).withColumns({f"_y{i}": F.expr(f"tanh((_x{i} - a{i}) / b{i})") for i in _K})
    sums = [F.sum(f"_{v}{i}").alias(f"s{v}{i}") for v in "xy" for i in _K]
    sums += [F.sum(F.expr(f"_{v}{i} * _{v}{j}")).alias(f"p{v}{i}{j}") for v in "xy" for i, j in _PAIRS]
    facts = pressed.groupBy("_group").agg(F.count(F.lit(1)).alias("n"), *sums).join(middle, "_group")

    def moment(v: str, i: int, j: int) -> str:
        return f"(p{v}{i}{j} / n - (s{v}{i} / n) * (s{v}{j} / n))"

    def pressed_scatter(i: int, j: int) -> str:
        root = f"sqrt(greatest({moment('y', i, i)}, 0D) * greatest({moment('y', j, j)}, 0D))"
        return f"b{i} * b{j} * " + ("1D" if i == j else f"coalesce(try_divide({moment('y', i, j)}, {root}), 0D)")

    kinds = (
        (lambda i: f"a{i}", lambda i, j: f"b{i} * b{i}" if i == j else "0D"),
        (lambda i: f"sx{i} / n", lambda i, j: moment("x", i, j)),
        (lambda i: f"a{i}", pressed_scatter),
    )
    facts = staged(facts)
    found = [
        facts.selectExpr(
            "_group", f"{k} as _start", *[f"{mean(i)} as m{i}" for i in _K], *[f"{scatter(i, j)} as c{i}{j}" for i, j in _PAIRS]
        )
        for k, (mean, scatter) in enumerate(kinds)
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


def _factored(estimates: DataFrame) -> DataFrame:
    """Add the lower triangle of the scatter's Cholesky factor, after the least spreads are added."""
    for i in _K:
        for j in range(i + 1):
            rest = f"c{j}{i} + {FEATURES[i][1] ** 2 if i == j else 0.0}D"
            rest += "".join(f" - l{i}{m} * l{j}{m}" for m in range(j))
            # The added spread keeps the exact value positive; rounding must not push it below.
            step = f"sqrt(greatest({rest}, 1e-12D))" if i == j else f"({rest}) / l{j}{j}"
            estimates = estimates.withColumn(f"l{i}{j}", F.expr(step))
    return staged(estimates.withColumn("_log_det", F.expr("2D * (" + " + ".join(f"ln(l{i}{i})" for i in _K) + ")")))


def _distances(rows: DataFrame, estimates: DataFrame, how: str = "inner") -> DataFrame:
    """Add the squared Mahalanobis distance to each estimate of the row's group, by forward substitution."""
    joined = _spread_join(rows, estimates, ["_group"], how)
    for i in _K:
        rest = f"_x{i} - m{i}" + "".join(f" - l{i}{j} * z{j}" for j in range(i))
        joined = joined.withColumn(f"z{i}", F.expr(f"({rest}) / l{i}{i}"))
    return joined.withColumn("_d", F.expr(" + ".join(f"z{i} * z{i}" for i in _K)))


def _by_band(rows: DataFrame, *sums: Column) -> DataFrame:
    """Sums per group, start and band of distance, with the rows of nearer bands and of the group.

    The sums are written before the window, which would else have all partial sums of a group sent to one task.
    """
    band = F.floor(F.lit(float(BANDS_PER_OCTAVE)) * F.log2(F.col("_d") + F.lit(1e-3)))
    counted = staged(rows.groupBy("_group", "_start", band.alias("_band")).agg(F.count(F.lit(1)).alias("_n"), *sums))
    # A group has at most a few hundred bands, whatever its rows.
    return counted.selectExpr(
        "*", "sum(_n) over (partition by _group, _start order by _band) - _n as _nearer",
        "sum(_n) over (partition by _group, _start) as _all",
    )


def _concentrated(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """One concentration step: mean and scatter of the rows nearest to the present estimate."""
    sums = [F.sum(f"_x{i}").alias(f"s{i}") for i in _K]
    sums += [F.sum(F.expr(f"_x{i} * _x{j}")).alias(f"p{i}{j}") for i, j in _PAIRS]
    bands = _by_band(_distances(rows, estimates), *sums).filter(F.col("_nearer") < SUPPORT * F.col("_all"))
    total = bands.groupBy("_group", "_start").agg(
        F.sum("_n").alias("n"), *[F.sum(c).alias(c) for c in bands.columns if c[0] in "sp"]
    )
    return _factored(
        total.select(
            "_group", "_start",
            *[F.expr(f"s{i} / n as m{i}") for i in _K],
            *[F.expr(f"p{i}{j} / n - (s{i} / n) * (s{j} / n) as c{i}{j}") for i, j in _PAIRS],
        )
    )


def _least_determinant(rows: DataFrame) -> DataFrame:
    """The estimate of least determinant of each group, after concentration of every start until it has settled."""
    least = _concentrated(rows, _factored(_starts(rows)))
    fell = float("inf")
    while fell > SETTLED:
        before = least.select("_group", "_start", F.struct(*least.columns).alias("_before"))
        both = _concentrated(rows, least).join(before, ["_group", "_start"])
        fall = F.col("_before._log_det") - F.col("_log_det")
        now = F.struct(*least.columns)
        chosen = staged(both.select(fall.alias("_fall"), F.when(fall > 0, now).otherwise(F.col("_before")).alias("_kept")))
        fell = chosen.agg(F.max("_fall")).first()[0] or 0.0
        least = chosen.select("_kept.*")
    best = least.groupBy("_group").agg(F.min(F.struct("_log_det", *[c for c in least.columns if c not in ("_group", "_log_det")])).alias("_best"))
    return staged(best.select("_group", "_best.*"))


def quality_rules(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", cutoff: float = CUTOFF,
    carry: list[str] | None = None,
) -> DataFrame:
    """One row per input row: ``_row`` (the row as it was, or its ``carry`` columns), the statistics, ``base_failed``, ``distance``, ``kept``.

    ``distance`` is the squared robust distance, null where the fixed limits failed.
    """
    rows = packed(docs).withColumns(
        {"_lang": ref("_row").getField(lang).cast("string"), "_source": ref("_row").getField(source).cast("string")}
    )
    body = F.coalesce(F.col("_row").getField(text).cast("string"), F.lit(""))
    rows = with_statistics(rows, body)
    repeated = F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEATED_PERCENT) * F.col("n_words")
    rows = rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | repeated)
    if carry is not None:
        rows = rows.withColumn("_row", F.struct(*[F.col("_row").getField(c).alias(c) for c in carry]))
    # Salts are written with the rows, so that a task that runs again deals them alike.
    rows = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    rows = staged(rows.withColumns({f"_x{i}": F.expr(sql) for i, (sql, _) in enumerate(FEATURES)}), texts=True)
    rows = _grouped(rows)
    passed = rows.filter(~F.col("base_failed")).select("_group", "_salt", *[f"_x{i}" for i in _K])
    passed = staged(passed)
    estimates = _least_determinant(passed)
    bands = _by_band(_distances(passed, estimates)).filter(F.col("_nearer") < F.col("_all") / 2)
    middle = bands.groupBy("_group").agg(
        F.expr(f"greatest(power(2D, (max(_band) + 1) / {float(BANDS_PER_OCTAVE)}D) / {CHI_SQUARE_MEDIAN}D, 1D)").alias("_unit")
    )
    judged = _distances(rows, staged(estimates.join(middle, "_group")), "left")
    distance = F.when(~F.col("base_failed"), F.col("_d") / F.col("_unit"))
    return judged.select(
        "_row", *STATISTICS, "base_failed", distance.alias("distance"),
        (~F.col("base_failed") & (distance <= cutoff)).alias("kept"),
    )
