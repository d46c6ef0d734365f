"""License scans: exact phrases, and an exact set-similarity join of text blocks with license templates.

A block is ``BLOCK`` words; blocks begin every half block, so that a passage of up to half
a block lies whole in one.  A block matches a template if it contains at least
``CONTAINMENT`` of the template's token set.  Templates are ordered by the frequency of
their tokens in all rows, rarest first.  A template of T tokens that needs k of them in a block has one of
its first T - k + 1 in it: texts without any such token end there (prefix filter).
Blocks with less than k tokens, or whose first common token leaves less than k places in the template,
are ruled out before the sets are intersected (length and positional filter).

The template list is fixed and small, so the join is done in the row and shuffles nothing; only the
token counts, one row per template token, are gathered.

Defined cases: a null or empty text has no words and no label; equal rows are scanned each; texts of any length
are scanned whole; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import LOWER, UPPER, packed

#: What separates words after lower-casing, and the phrases with their labels.
NOT_A_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: Notices by which licenses are commonly named, as words of this library's form.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under the creative commons attribution sharealike license"),
    ("cc-by", "licensed under the creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced without permission of the publisher"),
)
CONTAINMENT = 0.9
BLOCK = 128


def _literal(words: list[str]) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def _with_words(rows: DataFrame, text: Column) -> DataFrame:
    """Add ``_norm``, the words with one blank around each, and ``_words``."""
    lowered = F.translate(text, UPPER, LOWER)
    rows = rows.withColumn("_norm", F.concat(F.lit(" "), F.trim(F.regexp_replace(lowered, NOT_A_WORD, " ")), F.lit(" ")))
    return rows.withColumn(
        "_words", F.when(F.trim("_norm") == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(F.trim("_norm"), " "))
    )


def _frequencies(rows: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Rows that contain each template token."""
    tokens = rows.select(F.explode(F.expr(f"array_intersect(_words, {_literal(vocabulary)})")).alias("token"))
    return {r.token: r["count"] for r in tokens.groupBy("token").count().collect()}


def license_scan(
    docs: DataFrame, text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, containment: float = CONTAINMENT
) -> DataFrame:
    """One row per input row: ``_row``, ``n_words``, the places of the phrases, labels and ``score``.

    ``score`` is 1 with a phrase, else the greatest containment that reached the threshold, else 0.
    """
    body = F.coalesce(F.col("_row").getField(text).cast("string"), F.lit(""))
    rows = _with_words(packed(docs), body)
    sets = [(label, list(dict.fromkeys(notice.split()))) for label, notice in templates]
    vocabulary = sorted({token for _, tokens in sets for token in tokens})
    counts = _frequencies(_with_words(packed(docs.select(text)), body), vocabulary)

    entries, prefixes = [], set()
    for label, tokens in sets:
        tokens = sorted(tokens, key=lambda t: (counts.get(t, 0), t))
        need = math.ceil(containment * len(tokens))
        prefix = tokens[: len(tokens) - need + 1]
        prefixes.update(prefix)
        entries.append(
            f"named_struct('label', '{label}', 'tokens', {_literal(tokens)}, 'prefix', {_literal(prefix)}, 'need', {need})"
        )
    rows = rows.withColumn(
        "_templates",
        F.expr(
            f"if(arrays_overlap(_words, {_literal(sorted(prefixes))}),"
            f" filter(array({', '.join(entries)}), t -> size(_words) >= t.need and arrays_overlap(t.prefix, _words)), null)"
        ),
    )
    half = BLOCK // 2
    rows = rows.withColumn(
        "_blocks",
        F.expr(
            f"if(size(_templates) > 0, transform(sequence(1, greatest(size(_words) - {half}, 1), {half}),"
            f" i -> array_distinct(slice(_words, i, {BLOCK}))), null)"
        ),
    )
    # A template's first token in the block, at place p, leaves T - p + 1 tokens for the overlap.
    first = "array_position(transform(t.prefix, x -> array_contains(b, x)), true)"
    rows = rows.withColumn(
        "_found",
        F.expr(
            "filter(transform(_templates, t -> named_struct('label', t.label, 'share', array_max(transform(filter(_blocks,"
            f" b -> size(b) >= t.need and {first} > 0 and size(t.tokens) - {first} + 1 >= t.need),"
            " b -> size(array_intersect(t.tokens, b)) / size(t.tokens))), 'least', t.need / size(t.tokens))),"
            " m -> m.share >= m.least)"
        ),
    )
    places = []
    for label, phrase in PHRASES:
        n = len(phrase.split())
        at = (
            f"transform(filter(sequence(1, size(_words) - {n - 1}), i -> slice(_words, i, {n}) = {_literal(phrase.split())}),"
            f" i -> named_struct('start', cast(i - 1 as bigint), 'label', '{label}'))"
        )
        places.append(f"if(contains(_norm, ' {phrase} '), {at}, array())")
    rows = rows.withColumn("_places", F.expr(f"concat({', '.join(places)})"))
    base = "transform(_places, p -> p.label)"
    return rows.select(
        "_row",
        F.size("_words").cast("long").alias("n_words"),
        F.size("_places").cast("long").alias("n_base"),
        F.expr("array_min(transform(_places, p -> p.start))").alias("first_word"),
        F.expr("array_max(transform(_places, p -> p.start))").alias("last_word"),
        F.expr(f"array_join(array_sort(array_distinct({base})), ',')").alias("base_labels"),
        F.expr(
            f"array_join(array_sort(array_distinct(concat({base}, coalesce(transform(_found, m -> m.label), array())))), ',')"
        ).alias("labels"),
        F.expr(
            "if(size(_places) > 0, 1D, coalesce(array_max(transform(_found, m -> cast(m.share as double))), 0D))"
        ).alias("score"),
    )
