"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import LOWER, UPPER, read
from tabloom.llm.contamination import decontaminate
from tabloom.llm.fixed_blocks import remove_repeated_words
from tabloom.llm.hard_negatives import hard_negatives
from tabloom.llm.html_extraction import extract_text
from tabloom.llm.language import identify_languages
from tabloom.llm.lexical_search import lexical_search
from tabloom.llm.licenses import license_scan
from tabloom.llm.near_duplicates import near_duplicates
from tabloom.llm.packing import pack_documents
from tabloom.llm.quality import STATISTICS, quality_rules
from tabloom.llm.repeats import remove_repeats
from tabloom.llm.secrets import secret_scan, spans_text
from tabloom.llm.sources import tokenizer_file
from tabloom.llm.wordpieces import count_tokens, vocabulary_of


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(read(spark, folder, "documents"), tokenizer_file("word_bpe_49k.json"))


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = license_scan(read(spark, folder, "documents").select("doc_id", "text"))
    return found.select(F.col("_row.doc_id").alias("doc_id"), *found.columns[1:])


def op3_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract_text(read(spark, folder, "pages"))


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(read(spark, folder, "documents"), vocabulary_of(tokenizer_file("word_bpe_49k.json")))


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    columns = ["doc_id", "text"]
    found = decontaminate(docs.select(*columns), read(spark, folder, "benchmark"))
    return found.select(F.col("_row.doc_id").alias("doc_id"), "contaminated", "n_items", "item_id", "share")


def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan(read(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        F.col("_row.doc_id").alias("doc_id"),
        *[F.expr(f"cast(size(filter(base, x -> x.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(("assign", "access", "hex"))],
        F.expr(f"sha2({spans_text('base')}, 256)").alias("base_sha256"),
        F.expr(spans_text("spans")).alias("spans"),
    )


def op7_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(read(spark, folder, "documents"))


def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    return identify_languages(read(spark, folder, "documents"))


def op9_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(read(spark, folder, "documents"), width=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    found = quality_rules(docs, carry=["doc_id"])
    return found.select(F.col("_row.doc_id").alias("doc_id"), *STATISTICS, "base_failed", "kept", "distance")


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    table = read(spark, folder, "embeddings")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = table.select(
        F.col("vec_id").alias("id"),
        F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.when(finite, F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))).alias("vector"),
    )
    return hard_negatives(rows, F.col("id") % 100 == 0)


def op12_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeated_words(read(spark, folder, "documents"))


def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_license_scan": op2_license_scan,
    "op3_html_extraction": op3_html_extraction,
    "op4_token_counts": op4_token_counts,
    "op5_decontamination": op5_decontamination,
    "op6_secret_scan": op6_secret_scan,
    "op7_repeats": op7_repeats,
    "op8_language": op8_language,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_quality_rules": op10_quality_rules,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_lexical_search": op13_lexical_search,
}

#: What can be stated in SQL; the other operators are held against plain Python in tests/llm.
NEAR_DUPLICATES_SQL = f"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[ \\t-\\x0d]+'), lambda x: x <> '') AS w
    FROM documents),
g AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM w),
n AS (SELECT doc_id, len(g) AS n FROM g),
e AS (SELECT doc_id, unnest(g) AS t FROM g),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, o.b FROM r JOIN both_ways o ON r.b = o.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""

HARD_NEGATIVES_SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
    SELECT anchor_id, other AS positive_id, score AS positive_score,
           row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS n
    FROM s WHERE same),
r AS (
    SELECT p.anchor_id, positive_id, positive_score, other AS negative_id, score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS rank
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND n <= 5
    WHERE 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 10
"""

SUBSTRING_DEDUP_SQL = """
WITH d AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\x0d]+'), lambda x: x <> '') AS w FROM documents),
g AS (
    SELECT doc_id, unnest(range(1, len(w) - 11)) AS s,
           unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS t
    FROM d WHERE len(w) >= 13),
h AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY t) AS least FROM g) WHERE least < doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS i FROM h),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT p.doc_id, p.i, p.word FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.i = p.i WHERE c.i IS NULL),
j AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN j ON j.doc_id = d.doc_id
"""

LEXICAL_SEARCH_SQL = f"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
           '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
q AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
           '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark),
g AS (SELECT count(*)::BIGINT AS nn, sum(len(w))::BIGINT AS ll FROM d WHERE len(w) > 0),
f AS (SELECT doc_id, t, count(*)::BIGINT AS tf, any_value(n)::BIGINT AS n
      FROM (SELECT doc_id, unnest(w) AS t, len(w) AS n FROM d) GROUP BY doc_id, t),
w AS (SELECT t, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, g GROUP BY t),
s AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))))::BIGINT AS score
    FROM q JOIN w USING (t) JOIN f USING (t), g GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
      FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""

ORACLES: dict[str, str] = {
    "op9_near_duplicates": NEAR_DUPLICATES_SQL,
    "op11_hard_negatives": HARD_NEGATIVES_SQL,
    "op12_substring_dedup": SUBSTRING_DEDUP_SQL,
    "op13_lexical_search": LEXICAL_SEARCH_SQL,
}
