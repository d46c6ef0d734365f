"""Secret scans: three fixed patterns, and character Markov models of random strings and of ordinary words.

Spans are offsets in code points.  A pattern's matches and the text between them, cut at the
same matches, give the offsets without any code per row.  Long tokens outside those spans are judged by
the log-likelihood ratio of two first-order Markov models, one of random strings and one of ordinary words and identifiers.
Both are trained on a sample of about ``SAMPLE`` different texts, by their hash: random strings are
the secrets that the patterns find there and digests in the usual alphabets, ordinary ones all other tokens.
The models are one number per pair of characters.

Defined cases: a null or empty text has no spans; equal rows are scanned each, and count once in the
sample; texts of any length are scanned whole (texts above ``SAMPLE_CHARS`` are left out of the training sample only);
an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import ref
from tabloom.llm.common import hashed_sample, packed

#: The patterns, and the kinds in their order.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")

#: Tokens that the models judge: at least this long, within these characters.
TOKEN = "[A-Za-z0-9+/_=-]{20,}"
TRAINING_TOKEN = "[A-Za-z0-9+/_=-]{6,}"
SAMPLE = 2000
SAMPLE_CHARS = 100_000
SMOOTHING = 0.5
#: Least log-likelihood ratio, of a whole token and per character.
LEAST_RATIO = 8.0
LEAST_MEAN = 0.9
PLACEHOLDER = "[SECRET]"
_CODES = 128


def _with(name: str, value: str, body: str) -> str:
    """SQL of ``body`` where ``name`` stands for ``value``, which is worked out once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _running(values: str, merge: str) -> str:
    """SQL of the running results of an integer array; ``merge`` joins ``a`` and ``b``.

    An array that grows inside ``aggregate`` is copied with every entry, so it only grows within blocks of the cube root
    of its size: a million entries take some hundred million copied numbers, not five hundred thousand million.
    """
    start = "cast(null as int)"
    joined = f"coalesce({_with('b', 'get(v, i)', _with('a', 'r.at', merge))}, get(v, i))"
    inside = "sequence(j * w, least(size(v), (j + 1) * w) - 1)"
    total = f"aggregate({inside}, named_struct('at', {start}), (r, i) -> named_struct('at', {joined}), r -> r.at)"
    totals = f"transform(sequence(0, int((size(v) - 1) div w)), j -> {total})"
    grown = "cast(array() as array<int>)"
    before = (
        f"aggregate({totals}, named_struct('at', {start}, 'out', {grown}), (r, t) -> named_struct('at',"
        f" coalesce({_with('b', 't', _with('a', 'r.at', merge))}, t), 'out', array_append(r.out, r.at)), r -> r.out)"
    )
    block = (
        f"aggregate({inside}, named_struct('at', p, 'out', {grown}), (r, i) -> named_struct('at', {joined},"
        f" 'out', array_append(r.out, {joined})), r -> r.out)"
    )
    blocks = f"flatten(transform({before}, (p, j) -> {block}))"
    whole = _with("w", "greatest(1, int(cbrt(size(v))))", blocks)
    return _with("v", values, f"if(size(v) = 0, {grown}, {whole})")


def _located(rows: DataFrame, name: str, kind: int, pattern: str, gate: Column, group: int = 0) -> DataFrame:
    """Add the array of (start, kind, end, token) of a pattern's matches; ``token`` is the match's group."""
    rows = rows.withColumn("_gate", gate & F.col("_text").rlike(pattern))
    rows = rows.withColumns(
        {
            "_between": F.when(F.col("_gate"), F.split("_text", pattern, -1)),
            "_match": F.when(F.col("_gate"), F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))),
            "_inner": F.when(F.col("_gate"), F.regexp_extract_all("_text", F.lit(pattern), F.lit(group))),
        }
    )
    matches = "filter(arrays_zip(_between, _match, _inner), m -> m._match is not null)"
    steps = "transform(z, m -> length(m._between) + length(m._match))"
    spans = (
        "transform(z, (m, i) -> named_struct('start', get(ends, i) - length(m._match), 'kind', "
        f"{kind}, 'end', get(ends, i), 'token', m._inner))"
    )
    found = _with("z", matches, _with("ends", _running(steps, "a + b"), spans))
    none = "cast(array() as array<struct<start: int, kind: int, end: int, token: string>>)"
    return rows.withColumn(name, F.expr(f"if(size(_match) > 0, {found}, {none})")).drop("_gate", "_between", "_match", "_inner")


def _free(tokens: str, spans: str) -> str:
    """SQL of the tokens that overlap none of the spans, which are in the order of their starts.

    A token overlaps a span if, of the spans that start before its end, the one that reaches farthest ends after its
    start; one running maximum over all starts and ends in order tells that.
    """
    events = (
        f"array_sort(concat(transform({tokens}, t -> named_struct('at', t.end, 'base', 0, 'reach', 0, 'token', t)),"
        f" transform({spans}, x -> named_struct('at', x.start, 'base', 1, 'reach', x.end, 'token', x))))"
    )
    clear = "filter(e, (v, i) -> v.base = 0 and get(reach, i) <= v.token.start)"
    body = _with("reach", _running("transform(e, v -> v.reach)", "greatest(a, b)"), f"transform({clear}, v -> v.token)")
    return _with("e", events, body)


def _with_base(rows: DataFrame) -> DataFrame:
    """Add ``_base``, the spans of the fixed patterns, in order."""
    has = lambda part: F.contains(F.col("_text"), F.lit(part))
    rows = _located(rows, "_assign", 0, ASSIGN, has("=") | has(":"), group=2)
    rows = _located(rows, "_access", 1, ACCESS, has("AKIA"))
    # A run of hexadecimal digits is one match whatever its length, so the long runs can be asked for at once.
    rows = _located(rows, "_hex", 2, "[0-9a-f]{32,}", F.lit(True))
    rows = rows.withColumn(
        "_base",
        F.expr(
            "array_sort(concat(filter(_assign, x -> length(x.token) >= 8),"
            " filter(_access, x -> x.end - x.start >= 16), _hex))"
        ),
    )
    return rows.drop("_assign", "_access", "_hex")


def _transitions(tokens: DataFrame) -> DataFrame:
    """Pairs of neighbouring characters of ``token``, counted per ``label``."""
    pairs = f"transform(_chars, (c, i) -> ascii(c) * {_CODES} + ascii(get(_chars, i + 1)))"
    return (
        tokens.withColumn("_chars", F.split("token", "")).select("label", F.explode(F.expr(pairs)).alias("pair"))
        .filter("pair is not null").groupBy("label", "pair").count()
    )


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> list[float]:
    """Log-likelihood ratio of each pair of characters, by 128 x the first code + the second."""
    body = F.coalesce(ref(text).cast("string"), F.lit("")).alias("_text")
    rows = _with_base(hashed_sample(docs.select(body).filter(F.length("_text") <= SAMPLE_CHARS), "_text", sample))
    digest = "sha2(_text, 256)"
    made = F.array(
        F.expr(digest), F.upper(F.expr(digest)), F.base64(F.unhex(F.expr(digest))), F.base64(F.unhex(F.sha2(F.reverse("_text"), 256)))
    )
    random = rows.select(F.lit(1).alias("label"), F.explode(F.expr("transform(_base, x -> x.token)")).alias("token"))
    random = random.unionByName(rows.select(F.lit(1).alias("label"), F.explode(made).alias("token")))
    # Ordinary tokens are those that no span of the patterns holds.
    ordinary = rows.select(
        F.lit(0).alias("label"),
        F.explode(
            F.expr(
                f"filter(regexp_extract_all(_text, '{TRAINING_TOKEN}', 0),"
                " t -> not exists(_base, x -> contains(t, x.token) or contains(x.token, t)))"
            )
        ).alias("token"),
    )
    counts = {(r.label, r.pair): r["count"] for r in _transitions(random.unionByName(ordinary)).collect()}
    used = [ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]
    ratios = [0.0] * (_CODES * _CODES)
    for a in used:
        total = [sum(counts.get((label, a * _CODES + b), 0) for b in used) for label in (0, 1)]
        for b in used:
            chance = [
                (counts.get((label, a * _CODES + b), 0) + SMOOTHING) / (total[label] + SMOOTHING * len(used)) for label in (0, 1)
            ]
            ratios[a * _CODES + b] = round(math.log(chance[1] / chance[0]), 4)
    return ratios


def secret_scan(docs: DataFrame, text: str = "text", ratios: list[float] | None = None) -> DataFrame:
    """One row per input row: ``_row``, ``spans`` (start, kind, end, token) in order, and ``base``, those of the fixed patterns."""
    ratios = train(docs, text) if ratios is None else ratios
    rows = packed(docs).withColumn("_text", F.coalesce(F.col("_row").getField(text).cast("string"), F.lit("")))
    rows = _with_base(rows)
    rows = _located(rows, "_tokens", 3, TOKEN, F.lit(True))
    # The table is one constant array; folding turns the text into it before the query runs.
    table = f"cast(split('{','.join(map(str, ratios))}', ',') as array<double>)"
    ratio = (
        "aggregate(split(t.token, ''), named_struct('last', -1, 'sum', 0D), (a, c) -> named_struct('last', ascii(c), 'sum',"
        f" a.sum + if(a.last < 0, 0D, get({table}, a.last * {_CODES} + ascii(c)))), a -> a.sum)"
    )
    judged = (
        f"filter(transform({_free('_tokens', '_base')}, t -> named_struct('t', t, 'ratio', {ratio})),"
        f" j -> j.ratio >= {LEAST_RATIO}D and j.ratio >= {LEAST_MEAN}D * length(j.t.token))"
    )
    rows = rows.withColumn("_random", F.expr(f"transform({judged}, j -> j.t)"))
    return rows.select("_row", F.col("_base").alias("base"), F.expr("array_sort(concat(_base, _random))").alias("spans"))


def spans_text(spans: str) -> str:
    """SQL of kind:start:end of each span, comma-joined."""
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, x -> concat(get(array({kinds}), x.kind), ':', x.start, ':', x.end)), ',')"


def redacted(text: str, spans: str) -> str:
    """SQL of the text with every span, or run of overlapping spans, replaced by a placeholder."""
    step = (
        "(a, x) -> named_struct('at', greatest(a.at, x.end), 'out', if(x.start < a.at and a.at > 0, a.out,"
        f" concat(a.out, substring({text}, a.at + 1, x.start - a.at), '{PLACEHOLDER}')))"
    )
    walk = (
        f"aggregate({spans}, named_struct('at', 0, 'out', ''), {step}, a -> concat(a.out, substring({text}, a.at + 1)))"
    )
    return f"if(size({spans}) > 0, {walk}, {text})"


def without_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows as they were, with a placeholder for every secret in the text; a null text stays null."""
    found = secret_scan(docs, text).withColumn("_text", F.col("_row").getField(text).cast("string"))
    cleaned = F.expr(redacted("_text", "spans"))
    return found.select(*[cleaned.alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns])
