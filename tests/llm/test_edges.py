"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib

import pytest

from tabloom.llm.contamination import decontaminate
from tabloom.llm.html_extraction import extract_text
from tabloom.llm.language import identify_languages
from tabloom.llm.licenses import license_scan
from tabloom.llm.near_duplicates import near_duplicates, without_near_duplicates
from tabloom.llm.packing import pack_documents
from tabloom.llm.quality import quality_rules
from tabloom.llm.repeats import remove_repeats
from tabloom.llm.secrets import secret_scan, without_secrets
from tabloom.llm.sources import tokenizer_file
from tabloom.llm.wordpieces import count_tokens, vocabulary_of

LONG = "a long line of plain words that goes on and on " * 4000
#: Columns named as those the operators make or use inside.
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, _row string, _text string, mark bigint, "
    "key string, spans string, start int, _words string, `odd.name` string"
)


def rows():
    texts = [
        (1, None), (2, ""), (3, "   \n\t "), (4, "one two three"), (4, "one two three"), (5, "one two three"), (None, "one two three"),
        (None, None), (6, LONG), (7, "ünïcode ünd 漢字 token = 'abcdefgh1234' 𝒳 end"), (8, "x" * 5000), (9, "!!! ??? ..."), (None, LONG),
    ]
    return [(i, t, None if n % 3 else "en", None if n % 2 else "s", 1, False, "r", "t", 5, "k", "s", 0, "w", "o") for n, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def per_row(spark):
    items = spark.createDataFrame([(1, "one two three"), (2, None), (3, "")], "item_id bigint, text string")
    nothing = spark.createDataFrame([], "item_id bigint, text string")
    definition = tokenizer_file("word_bpe_49k.json")
    return {
        "quality": quality_rules,
        "near": lambda d: near_duplicates(d, 3, 85),
        "contamination": lambda d: decontaminate(d, items),
        "contamination by nothing": lambda d: decontaminate(d, nothing),
        "secrets": secret_scan,
        "licenses": license_scan,
        "language": identify_languages,
        "tokens": lambda d: count_tokens(d, vocabulary_of(definition)),
        "repeats": remove_repeats,
        "clean": without_secrets,
    }


NAMES = ("quality", "near", "contamination", "contamination by nothing", "secrets", "licenses", "language", "tokens", "repeats", "clean")


@pytest.mark.parametrize("name", NAMES)
def test_one_row_per_row(spark, docs, none, name):
    run = per_row(spark)[name]
    assert len(run(docs).collect()) == len(rows())
    assert run(none).collect() == []


def test_quality_of_edges(docs):
    found = quality_rules(docs).select("_row.text", "n_words", "base_failed", "kept", "n_repeat_words").collect()
    for r in found:
        assert r.n_words == len((r.text or "").split()) and (not r.kept or not r.base_failed)
        if r.text == LONG:
            assert r.n_repeat_words == r.n_words and r.base_failed


def test_near_duplicate_edges(docs):
    found = {(r.doc_id, r.n_shingles): r for r in near_duplicates(docs, 3, 85).collect()}
    assert found[4, 1].component_id == 4 and found[5, 1].component_id == 4 and not found[5, 1].kept
    assert found[None, 1].component_id == 4 and not found[None, 1].kept
    assert found[1, 0].component_id == 1 and found[1, 0].kept and found[2, 0].kept
    assert found[8, 1].kept and found[6, 11].component_id == 6


def test_one_row_of_each_group_stays(docs, none):
    found = without_near_duplicates(docs, 3, 85)
    assert found.columns == docs.columns
    texts = sorted((r.text or "") for r in found.collect())
    # The rows without any word are in no group.
    assert texts == sorted(["", "", "", "   \n\t ", "one two three", LONG, rows()[9][1], "x" * 5000, "!!! ??? ..."])
    assert without_near_duplicates(none).collect() == []


def test_contamination_edges(spark, docs):
    items = spark.createDataFrame([(1, "One two, three"), (2, None)], "item_id bigint, text string")
    found = decontaminate(docs, items).select("_row.text", "contaminated", "item_id").collect()
    assert all(r.contaminated == (r.text == "one two three") for r in found)


def test_secret_edges(docs):
    cleaned = {r.doc_id: r.text for r in without_secrets(docs).collect() if r.doc_id in (1, 2, 7)}
    assert cleaned == {1: None, 2: "", 7: "ünïcode ünd 漢字 [SECRET]' 𝒳 end"}


def test_language_edges(docs):
    found = {r.doc_id: r for r in identify_languages(docs).collect()}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (1, 2, 3, 9))
    assert all(found[i].lang_pred in ("en", "und") and 0 <= found[i].score <= 1 for i in found)


def test_repeat_edges(docs):
    found = [r for r in remove_repeats(docs).collect()]
    by = {r.doc_id: r for r in found}
    assert by[1].n_bytes == 0 and by[1].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[6].n_removed == by[6].n_bytes == len(LONG.encode()) and by[6].n_spans == 1
    assert by[8].n_removed == 5000 and by[4].n_removed == 0


def test_packing_edges(docs, none):
    found = pack_documents(docs, tokenizer_file("word_bpe_49k.json")).collect()
    assert sum(r.length for r in found if r.doc_id == 1) == 1
    assert sum(r.length for r in found if r.doc_id == 4) == 2 * 4
    assert max(r.offset + r.length for r in found) <= 4096
    assert pack_documents(none, tokenizer_file("word_bpe_49k.json")).collect() == []


def test_html_edges(spark):
    schema = "page_id bigint, url string, html string, text string, n_chars int"
    pages = spark.createDataFrame(
        [
            (1, None, None, "t", 0), (2, "u", "", "t", 0), (None, "u", "<", "t", 0), (3, "u", "<article><p>some words of a page.</p></article>", "t", 0),
            (3, "u", "<article><p>some words of a page.</p></article>", "t", 0), (4, "u", "<p>" + "word <b>deep " * 20000, "t", 0),
            (5, "u", "<a href='x>unclosed <script>never ends", "t", 0),
        ],
        schema,
    )
    found = extract_text(pages).collect()
    assert len(found) == 7 and all(r.n_chars == len(r.text) for r in found)
    assert all(r.text == "" for r in found if r.page_id in (1, 2))
    assert extract_text(pages.filter("false")).collect() == []
