"""Ranked lexical search by norm buckets: the best documents of each item by an integer term-frequency score.

A document is a sparse vector of impacts over the terms of the items, an item a sparse vector of term weights.
Documents are put in order of their vector's length and cut into buckets.  Against the kth best score so far, an item leaves
out a bucket whose longest vector cannot reach it by the Cauchy-Schwarz inequality; inside a bucket the coordinates of the
item's heaviest terms are added up, and the same inequality bounds what the others can add.  Only documents whose bound
reaches the kth score are rescored, exactly, in integers; bounds have some slack for rounding and equal scores always
pass, so nothing is lost.

Texts are read once for each block of items and leave one short row per document.  The longest vectors are searched first, in one task of
bounded size; their kth scores then cut the table before it is shuffled, and every task goes on from them.

Defined cases: a null or empty text, or one without terms, counts in no statistic and is never found; rows without id are found, with
a null id, after others of the same score; equal rows are found each; equal items are one, an item without terms
finds nothing; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.columns import ref
from tabloom.llm.common import LOWER, UPPER, whole_text
from tabloom.session import staged

TOP = 50
#: Documents of a bucket, and of the first search.
BUCKET = 1024
FIRST = 4096
#: Heaviest terms of an item whose coordinates are looked at before any other.
FOCUS = 6
#: Items, and characters of items, that are searched for at a time.
ITEMS, ITEM_CHARS = 1000, 4 << 20
SLACK = 1 + 1e-9

#: Letters and digits stay, A to Z folded; every other ASCII character parts terms; bytes of other characters stay.
_FOLDED = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))
FOUND = "item int, doc_id bigint, score bigint"


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLDED).split()


def _counted(number: dict[bytes, int]):
    """The terms of the items that each text holds, by number, with their counts."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), 1000):
                rows = batch.iloc[low : low + 1000]
                lengths, terms, counts = [], [], []
                for text in rows["text"]:
                    words = terms_of(text)
                    known = np.array([i for i in map(number.get, words) if i is not None], dtype=np.int32)
                    term, count = np.unique(known, return_counts=True)
                    lengths.append(len(words))
                    terms.append(term)
                    counts.append(count)
                yield pd.DataFrame({"doc_id": rows["doc_id"].array, "n": lengths, "terms": terms, "counts": counts})

    return work


class _Bucket:
    """Vectors of some documents by term."""

    def __init__(self, rows: pd.DataFrame):
        self.none = rows["doc_id"].isna().to_numpy()
        self.ids = rows["doc_id"].fillna(0).to_numpy(dtype=np.int64)
        self.square = rows["square"].to_numpy(dtype=np.float64)
        self.longest = math.sqrt(self.square.max())
        sizes = [len(t) for t in rows["terms"]]
        terms = np.concatenate(rows["terms"].to_list())
        by = np.argsort(terms, kind="stable")
        self.terms = terms[by]
        self.docs = np.repeat(np.arange(len(rows)), sizes)[by]
        self.impacts = np.concatenate(rows["impacts"].to_list()).astype(np.int64)[by]

    def postings(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents, impacts and weights of some terms, one after another."""
        low, high = np.searchsorted(self.terms, terms), np.searchsorted(self.terms, terms, "right")
        sizes = high - low
        at = np.arange(sizes.sum()) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)
        return self.docs[at], self.impacts[at], np.repeat(weights, sizes)

    def search(self, item: Item, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that score at least ``least``, and their scores."""
        none = np.zeros(0, dtype=np.int64)
        if item.length * self.longest * SLACK < least:
            return none, none
        docs, impacts, weights = self.postings(item.terms[:FOCUS], item.weights[:FOCUS])
        part = np.zeros(len(self.ids), dtype=np.int64)
        np.add.at(part, docs, impacts * weights)
        seen = np.bincount(docs, weights=np.square(impacts.astype(np.float64)), minlength=len(part))
        rest = np.sqrt(np.maximum(self.square - seen, 0)) * item.rest
        able = part + rest * SLACK + 1 >= least
        if not able.any():
            return none, none
        docs, impacts, weights = self.postings(item.terms[FOCUS:], item.weights[FOCUS:])
        kept = able[docs]
        np.add.at(part, docs[kept], impacts[kept] * weights[kept])
        found = np.flatnonzero(able & (part >= least))
        return found, part[found]


class Item:
    """Terms of an item, heaviest first, and the lengths of its vector and of what is beyond the focus."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray):
        by = np.lexsort((terms, -weights))
        self.terms, self.weights = terms[by], weights[by]
        self.length = math.sqrt(float(np.square(self.weights.astype(np.float64)).sum()))
        self.rest = math.sqrt(float(np.square(self.weights[FOCUS:].astype(np.float64)).sum()))


def _searched(items: list[Item], least: list[int], top: int):
    """The best documents of each item among a task's rows, from the scores known so far."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        floor = list(least)
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * len(items)
        for batch in batches:
            batch = batch.sort_values("square", ascending=False, kind="stable", ignore_index=True)
            for low in range(0, len(batch), BUCKET):
                bucket = _Bucket(batch.iloc[low : low + BUCKET])
                for i, item in enumerate(items):
                    found, scores = bucket.search(item, floor[i])
                    if len(found):
                        ids, none, known = best[i]
                        ids, none = np.append(ids, bucket.ids[found]), np.append(none, bucket.none[found])
                        known = np.append(known, scores)
                        first = np.lexsort((ids, none, -known))[:top]
                        best[i] = ids[first], none[first], known[first]
                        if len(first) == top:
                            floor[i] = max(floor[i], int(known[first[-1]]))
        for i, (ids, none, known) in enumerate(best):
            if len(ids):
                yield pd.DataFrame({"item": i, "doc_id": pd.arrays.IntegerArray(ids, none), "score": known})

    return work


def _search_block(docs: DataFrame, items: list[tuple[int, list[bytes]]], top: int) -> DataFrame:
    vocabulary = sorted({term for _, terms in items for term in terms})
    number = {term: i for i, term in enumerate(vocabulary)}
    counted = staged(docs.mapInPandas(_counted(number), "doc_id bigint, n bigint, terms array<int>, counts array<bigint>"))
    documents, length = counted.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = dict(counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1))).collect())
    weights = np.array(
        [math.floor(1000 * math.log((2 * documents + 2) / (2 * held.get(i, 0) + 1))) for i in range(len(vocabulary))], dtype=np.int64
    )
    vectors = (
        counted.filter("size(terms) > 0").withColumn("m", F.expr(f"50 + (50 * n * {documents}L) div {max(1, length)}L"))
        .select("doc_id", "terms", F.expr("transform(counts, c -> (1000000000 * c) div (1000 * c + 20 * m))").alias("impacts"))
        .withColumn("square", F.expr("aggregate(impacts, 0D, (s, x) -> s + cast(x as double) * x)"))
    )
    known = [np.array([number[t] for t in terms], dtype=np.int32) for _, terms in items]
    queries = [Item(terms, weights[terms]) for terms in known]

    longest = vectors.orderBy(F.desc("square"), "doc_id").limit(FIRST)
    seen = longest.mapInPandas(_searched(queries, [1] * len(queries), top), FOUND)
    least = dict(seen.groupBy("item").agg(F.when(F.count(F.lit(1)) >= top, F.min("score")).otherwise(1)).collect())
    floor = [int(least.get(i, 1)) for i in range(len(queries))]
    needed = min((at / (q.length * SLACK) for at, q in zip(floor, queries, strict=True) if q.length), default=math.inf)
    able = vectors.filter(F.col("square") >= float(needed * needed / SLACK))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = able.repartitionByRange(parts, F.desc("square"), F.xxhash64(F.monotonically_increasing_id())).sortWithinPartitions(F.desc("square"))
    found = ordered.mapInPandas(_searched(queries, floor, top), FOUND)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    names = F.array(*[F.lit(name).cast("bigint") for name, _ in items])
    return ranked.select(F.get(names, F.col("item")).alias("item_id"), "rank", "doc_id", "score")


def lexical_search(
    docs: DataFrame, items: DataFrame, top: int = TOP, text: str = "text", key: str = "doc_id", item_text: str = "text",
    item_key: str = "item_id", block: int = ITEMS,
) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score`` of the ``top`` best documents of each item with a score above 0."""
    wanted = docs.select(ref(key).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    lowered = F.translate(whole_text(item_text), UPPER, LOWER)
    asked = items.select(ref(item_key).cast("long").alias("item_id"), lowered.alias("text")).distinct()
    count, chars = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, math.ceil(count / block), math.ceil(chars / ITEM_CHARS))
    asked = asked.withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    result = None
    for number in range(blocks):
        own = asked.filter(F.col("_block") == number).orderBy("item_id", "text").collect()
        terms = [(r.item_id, sorted(set(terms_of(r.text)))) for r in own]
        found = _search_block(wanted, terms, top)
        result = found if result is None else result.unionByName(found)
    return result
