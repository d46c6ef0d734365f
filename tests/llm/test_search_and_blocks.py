"""Hard negatives, repeated words, ranked search and near duplicates: SQL, plain Python, edge cases and small blocks."""

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from check_queries import cells
from tabloom.llm import fixed_blocks, lexical_search, near_duplicates
from tabloom.llm.hard_negatives import Lists, hard_negatives
from tabloom.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    theirs = sorted(cells(dict(zip(columns, r, strict=True))) for r in result.fetchall())
    assert sorted(cells(r.asDict()) for r in QUERIES[name](spark, FOLDER).collect()) == theirs


def vectors():
    rng = np.random.default_rng(3)
    rows = [(i, int(i % 3), rng.integers(-9, 10, 4).tolist()) for i in range(150)]
    rows += [(200 + i, 1, [1, 1, 1, 1]) for i in range(40)] + [(300, 0, [0, 0, 0, 0]), (310, 2, []), (320, 2, [5])]
    return rows


def test_hard_negatives_in_small_blocks(spark):
    schema = "id bigint, label int, vector array<bigint>, rank int, block bigint, score string"
    odd = [(400, None, [1, 2, 3, 4]), (410, 1, None), (420, 1, [1, None, 3, 4]), (None, 1, [1, 2, 3, 4]), vectors()[5], vectors()[5]]
    table = spark.createDataFrame([(*r, 0, 0, "x") for r in vectors() + odd], schema).repartition(3)
    found = hard_negatives(table, F.col("id") % 10 == 0, positives=3, negatives=4, block=16, anchor_block=3).collect()
    padded = [(i, label, np.array([*v, 0, 0, 0, 0][:4])) for i, label, v in vectors()]
    expected = []
    for anchor, own, a in padded:
        if anchor % 10 == 0:
            scored = sorted(((-int(a @ v), i, label) for i, label, v in padded if i != anchor))
            for ps, positive, _ in [s for s in scored if s[2] == own][:3]:
                inside = [s for s in scored if s[2] != own and 30 * -ps <= 100 * -s[0] <= 90 * -ps][:4]
                expected += [(anchor, positive, k + 1, i, -ps, -s) for k, (s, i, _) in enumerate(inside)]
    assert sorted(tuple(r) for r in found) == sorted(expected)
    assert hard_negatives(table.filter("false"), F.col("id") % 10 == 0).collect() == []


def test_threshold_stops_before_the_end():
    rng = np.random.default_rng(5)
    lists = Lists((rng.normal(size=(4096, 2)) * 100).astype(np.int64))
    anchor = np.array([90, -40])
    reads = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            reads.append(np.size(key) if isinstance(key, np.ndarray) else 0)
            return super().__getitem__(key)

    lists.vectors = lists.vectors.view(Counted)
    low, high = np.array([-(1 << 62)]), np.array([1 << 62])
    (place, scores), = lists.best(anchor, lists.thresholds(anchor[None, :])[0], np.ones(4096, bool), np.arange(4096), low, high, 5)
    truth = np.asarray(lists.vectors) @ anchor
    assert np.array(scores).tolist() == sorted(truth.tolist(), reverse=True)[:5] and sum(reads) < 1000


def plain_removed(rows, window):
    first = {}
    words = {key: re.findall(r"[^\x20\x09-\x0D]+", text or "") for key, text in rows if key is not None}
    for key in sorted(words):
        for s in range(len(words[key]) - window + 1):
            first.setdefault(tuple(words[key][s : s + window]), key)
    for key, text in rows:
        own = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = {
            k for s in range(len(own) - window + 1) if key is not None and first[tuple(own[s : s + window])] < key for k in range(s, s + window)
        }
        kept = [w for k, w in enumerate(own) if k not in gone]
        yield key, len(own), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()


@pytest.mark.parametrize("window", [13, 5])
def test_repeated_words_over_many_chunks(spark, monkeypatch, window):
    rng = random.Random(window)
    passage = [f"p{i}" for i in range(60)]
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (4, "one two"), (None, " ".join(passage)), (5, "a " * 30000), (6, "a b " * 40)]
    for i in range(10, 90):
        a = rng.randrange(40)
        rows.append((i, " ".join([f"w{rng.randrange(9)}" for _ in range(rng.randrange(30))] + passage[a : a + rng.randrange(30)] + ["x"] * (i % 20))))
    rows += [(95, rows[20][1]), (9, rows[21][1])]
    monkeypatch.setattr(fixed_blocks, "CHUNK_BYTES", 1500)
    monkeypatch.setattr(fixed_blocks, "BUCKET_BYTES", 9000)
    docs = spark.createDataFrame([(*r, 1, b"d") for r in rows], "doc_id bigint, text string, chunk int, data binary").repartition(3)
    found = sorted((tuple(r) for r in fixed_blocks.remove_repeated_words(docs, window).collect()), key=str)
    assert found == sorted(plain_removed(rows, window), key=str)
    assert fixed_blocks.remove_repeated_words(docs.filter("false")).collect() == []


def test_search_over_several_item_blocks(spark, monkeypatch):
    rng = random.Random(1)
    common = [f"t{int(rng.paretovariate(0.6)) % 300}" for _ in range(4000)]
    rows = [(i, " ".join(rng.choices(common, k=rng.randrange(80)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "?!"), (None, rows[7][1]), (2000, rows[7][1]), (2001, rows[7][1]), (2002, "T1 ÜX t1 " * 9000)]
    items = [(1, "T1 t2 t3 t4"), (2, None), (3, ""), (4, "t7-t8,ÜX ünseen"), (4, "t7-t8,ÜX ünseen"), (5, rows[7][1]), (6, "never")]
    docs = spark.createDataFrame([(*r, 0, 1) for r in rows], "doc_id bigint, text string, n int, item int").repartition(3)
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(lexical_search, "FIRST", 20)
    found = [tuple(r) for r in lexical_search.lexical_search(docs, asked, top=9, block=2).collect()]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    terms = [(key, split(text)) for key, text in rows]
    total, length = sum(bool(t) for _, t in terms), sum(len(t) for _, t in terms)
    expected = []
    for item, text in dict.fromkeys(items):
        weight = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * sum(t in own for _, own in terms) + 1))) for t in split(text)}
        scored = []
        for key, own in terms:
            m = 50 + (50 * len(own) * total) // length
            score = sum(w * ((10**9 * own.count(t)) // (1000 * own.count(t) + 20 * m)) for t, w in weight.items())
            if score:
                scored.append((-score, key is None, key))
        ranked = sorted(scored, key=lambda s: (s[0], s[1], s[2] or 0))[:9]
        expected += [(item, k + 1, key, -s) for k, (s, _, key) in enumerate(ranked)]
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert lexical_search.lexical_search(docs.filter("false"), asked).collect() == []
    assert lexical_search.lexical_search(docs, asked.filter("false")).collect() == []


@pytest.mark.parametrize(("width", "percent"), [(5, 80), (3, 85)])
def test_near_duplicates_in_small_blocks(spark, monkeypatch, width, percent):
    rng = random.Random(percent)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(160):
        own = list(base)
        for _ in range(rng.randrange(4)):
            own[rng.randrange(80)] = f"n{rng.randrange(30)}"
        rows.append((i, " ".join(own)))
    sets = {i: {tuple(t.split()[k : k + width]) for k in range(81 - width)} for i, t in rows}
    root = dict(zip(sets, sets, strict=True))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    monkeypatch.setattr(near_duplicates, "BLOCK", 16)
    monkeypatch.setattr(near_duplicates, "BLOCK_SHINGLES", 2000)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(docs, width, percent).collect()}
    assert found == {i: find(i) for i in sets}
