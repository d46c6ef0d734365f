"""The running results behind spans, and what the character models find."""

import random
import re
import string

from tabloom.llm import secrets


def test_running_results_equal_plain_ones(spark):
    rng = random.Random(4)
    for size in (0, 1, 2, 7, 30, 200):
        values = [rng.randrange(100) for _ in range(size)]
        df = spark.createDataFrame([(values,)], "x array<int>")
        row = df.selectExpr(secrets._running("x", "a + b") + " as a", secrets._running("x", "greatest(a, b)") + " as b").first()
        assert row.a == [sum(values[: k + 1]) for k in range(size)]
        assert row.b == [max(values[: k + 1]) for k in range(size)]


def test_tokens_that_overlap_a_span_are_not_judged(spark):
    rng = random.Random(5)
    kind = "array<struct<start: int, kind: int, end: int, token: string>>"
    for _ in range(5):
        at, tokens = 0, []
        for _ in range(40):
            at += rng.randrange(1, 6)
            tokens.append((at, 3, at + rng.randrange(1, 6), "t"))
            at = tokens[-1][2]
        spans = sorted((s, 0, s + rng.randrange(1, 12), "s") for s in (rng.randrange(at) for _ in range(12)))
        df = spark.createDataFrame([(tokens, spans)], f"tokens {kind}, spans {kind}")
        found = [tuple(t) for t in df.selectExpr(secrets._free("tokens", "spans") + " as f").first().f]
        assert found == [t for t in tokens if not any(x[0] < t[2] and t[0] < x[2] for x in spans)]


def test_planted_random_strings_and_identifiers(spark):
    """At least 95 of 100 random strings are found and at most 5 of 100 identifiers are marked."""
    rng = random.Random(6)
    prose = [
        "the quiet river moves along the valley and the village wakes before the market opens",
        "a network engineer writes configuration files and checks every connection of the server",
        "les enfants jouent dans le jardin pendant que la pluie tombe sur les toits de la maison",
    ]
    words = sorted({w for line in prose for w in line.split() if len(w) > 3})
    letters = string.ascii_letters + string.digits
    random_strings = ["".join(rng.choice(letters) for _ in range(rng.randrange(24, 41))) for _ in range(100)]
    names = ["_".join(rng.choice(words) for _ in range(4)) for _ in range(50)] + ["/".join(rng.choice(words) for _ in range(4)) for _ in range(50)]
    ratios = secrets.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    text = " ".join(f"see {a} and {b} here" for a, b in zip(random_strings, names, strict=True))
    spans = secrets.secret_scan(spark.createDataFrame([(1, text)], "doc_id int, text string"), ratios=ratios).first().spans
    assert all(text[s.start : s.end] == s.token for s in spans)
    marked = {s.token for s in spans}
    assert sum(t in marked for t in random_strings) >= 95
    assert sum(any(n in m for m in marked) for n in names) <= 5


def test_very_many_matches_in_one_text(spark):
    parts = [f"{i:040x}" for i in range(20_000)]
    text = " ".join(parts)
    row = secrets.secret_scan(spark.createDataFrame([(1, text)], "doc_id int, text string"), ratios=[0.0] * (128 * 128)).first()
    assert [(s.start, s.end) for s in row.spans] == [m.span() for m in re.finditer("[0-9a-f]{32,}", text)]
