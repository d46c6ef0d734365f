"""The registered text queries against plain Python on the smallest tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from tokenizers import Tokenizer

from tabloom.llm.common import read
from tabloom.llm.html_blocks import blocks_of
from tabloom.llm.queries import QUERIES
from tabloom.llm.sources import tokenizer_file
from tabloom.llm.wordpieces import ANY_PIECE, build, vocabulary_of

FOLDER = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    docs = pd.read_parquet(f"{FOLDER}/documents.parquet")
    return dict(zip(docs.doc_id, docs.text.fillna(""), strict=True))


def rows(spark, name):
    return QUERIES[name](spark, FOLDER).collect()


def test_packing(spark, texts):
    found = rows(spark, "op1_packing")
    tokenizer = Tokenizer.from_str(tokenizer_file("word_bpe_49k.json"))
    for key, text in texts.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], dtype="<u4")
        pieces = sorted((r for r in found if r.doc_id == key), key=lambda r: r.start)
        assert [r.start for r in pieces] == list(np.cumsum([0, *[r.length for r in pieces]])[:-1])
        assert sum(r.length for r in pieces) == len(ids) == pieces[0].doc_tokens
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in pieces)
    for _, own in pd.DataFrame([r.asDict() for r in found]).sort_values("offset").groupby("sequence_id"):
        assert (own.offset == own.length.cumsum() - own.length).all() and own.length.sum() <= 4096


def test_licenses(spark, texts):
    phrases = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
    for r in rows(spark, "op2_license_scan"):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[r.doc_id].translate(FOLD))
        places = [
            (i, label) for label, phrase in phrases for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()
        ]
        starts = [i for i, _ in places] or [None]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(starts), max(starts))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_html(spark):
    pages = {r.page_id: r.html for r in read(spark, FOLDER, "pages").collect()}
    for r in rows(spark, "op3_html_extraction"):
        html = pages[r.page_id]
        article = html[html.index("<article>") : html.index("</article>")]
        assert r.text == " ".join(b.text for b in blocks_of(article)) and r.n_chars == len(r.text)


def test_token_counts(spark, texts):
    vocabulary = {*vocabulary_of(tokenizer_file("word_bpe_49k.json")), *(bytes([b]) for b in range(256))}
    longest, known = max(map(len, vocabulary)), {}

    def greedy(word):
        if word not in known:
            at = n = 0
            while at < len(word):
                at += next(k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in vocabulary)
                n += 1
            known[word] = n
        return known[word]

    for r in rows(spark, "op4_token_counts"):
        words = ANY_PIECE.findall(texts[r.doc_id].lower())
        assert (r.n_words, r.n_tokens) == (len(words), sum(greedy(w.encode()) for w in words))


def test_automaton_pops_over_several_nodes():
    automaton = build([b"ab", b"abcde", b"cd", b"bcx", b"e"])
    assert automaton.counts([b"abcdx", b"abcde", b"abcx", b"", b"abcdab"]).tolist() == [3, 1, 3, 0, 3]


def test_contamination(spark, texts):
    grams = collections.defaultdict(set)
    norm = lambda t: re.findall(r"\w+", t.lower())
    for r in read(spark, FOLDER, "benchmark").collect():
        words = norm(r.text)
        for k in range(len(words) - 7):
            grams[tuple(words[k : k + 8])].add(r.item_id)
    for r in rows(spark, "op5_decontamination"):
        words = norm(texts[r.doc_id])
        items = set().union(*[grams.get(tuple(words[k : k + 8]), set()) for k in range(len(words) - 7)])
        assert r.contaminated == bool(items) and (not items or r.item_id == min(items))


def test_secrets(spark, texts):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for r in rows(spark, "op6_secret_scan"):
        text = texts[r.doc_id]
        spans = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        joined = [f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert set(joined) <= set(r.spans.split(","))


def test_repeats(spark, texts):
    seen = collections.Counter(t[s : s + 200] for t in map(str.encode, texts.values()) for s in range(len(t) - 199))
    for r in rows(spark, "op7_repeats"):
        text = texts[r.doc_id].encode()
        cover = np.zeros(len(text) + 1, dtype=int)
        for s in range(len(text) - 199):
            if seen[text[s : s + 200]] > 1:
                cover[s] += 1
                cover[s + 200] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        kept = hashlib.sha256(bytes(np.frombuffer(text, dtype=np.uint8)[~gone])).hexdigest()
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(text), int(gone.sum()), spans, kept)


def test_language(spark):
    truth = {r.doc_id: r.lang for r in read(spark, FOLDER, "documents").collect()}
    found = rows(spark, "op8_language")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def shingles(text):
    words = WORD.findall(text.translate(FOLD))
    return frozenset(tuple(words[i : i + 3]) for i in range(len(words) - 2)) if len(words) > 2 else frozenset([tuple(words)] if words else [])


def test_near_duplicates(spark, texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(k for k in sets if sets[k])
    for i, a in enumerate(keys):
        for b in keys[:i]:
            common = len(sets[a] & sets[b])
            if 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    for r in rows(spark, "op9_near_duplicates"):
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)


def test_quality(spark, texts):
    labels = {r.doc_id: r.quality for r in read(spark, FOLDER, "labels").collect()}
    good = {}
    for r in rows(spark, "op10_quality_rules"):
        text, seen, dup = texts[r.doc_id], set(), 0
        words = WORD.findall(text)
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        repeated = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
        symbols = sum(text.count(c) for c in "#*$%&|<>")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(words), sum(map(len, words)), symbols, dup, len(repeated)
        )
        assert r.base_failed == (len(words) < 20 or 100 * len(repeated) > 30 * len(words))
        if r.doc_id in labels and not r.base_failed:
            good.setdefault(labels[r.doc_id], []).append(r.kept)
    assert all(good[1]) and sum(good[0]) <= 0.2 * len(good[0])


def test_pipeline(spark, texts):
    import corpus_pipeline

    found = corpus_pipeline.run(spark, FOLDER).collect()
    kept = {r.doc_id for r in found}
    quality = {r.doc_id for r in rows(spark, "op10_quality_rules") if r.kept}
    contaminated = {r.doc_id for r in rows(spark, "op5_decontamination") if r.contaminated}
    assert kept <= quality and not kept & contaminated and len(kept) > 0.5 * len(texts)
    assert all(len({texts[k] for k in kept}) == len(kept) for _ in (0,))
