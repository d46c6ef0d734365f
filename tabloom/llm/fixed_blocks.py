"""Substring removal by fixed-block anchors: words covered by a window of ``WINDOW`` words that also starts in a smaller document.

Every document is indexed by its blocks of ``BLOCK`` words that do not overlap, and probed with all its rolling windows of that many words.
As two blocks less one word fit into a window, every window of the earlier document holds a whole indexed block, which the later
document meets with one of its probes.  Hits are then extended to the windows around them, and windows
that agree in the earlier document unite to maximal exact repeats.

Rows are dealt into chunks of bounded size, written once as a bucketed table, so that the passes over the texts need no
further shuffle of them.

1. Each chunk sends the different hashes of its probes, marked where one is an indexed block; a hash that two chunks
   have, one of them as a block, is sent back to both.
2. Each chunk sends the different windows around such hits, with the least document that has them; a chunk
   whose least document is not the least of all is told the least.
3. Each chunk covers the windows whose least document, in the chunk or elsewhere, is smaller than its own.

A chunk sends one entry for each different window, so copies within it cost nothing, and entries never meet in pairs.  Where documents share a
window, only the least of them matters, so an extension is compared with the least document of each window instead of with every
document that has it.  The hashes of the first step only choose candidates; windows are compared by 96 bits.

Defined cases: a null or empty text has no words; rows without id neither lose words nor make others lose them; rows of
one id do not make each other lose words; a text shorter than a window loses nothing; an empty table gives an empty result; other columns are not
read.  A single text has to fit in a task's memory.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import ref
from tabloom.llm.common import bucketed, whole_text
from tabloom.llm.shingles import mixed, window_hashes, word_hashes
from tabloom.session import staged

WINDOW = 13
#: Bytes of text of a chunk, and for which there is one bucket of entries.
CHUNK_BYTES, BUCKET_BYTES = 4 << 20, 12 << 20
#: Buckets of the table of texts at most; one then holds several chunks.
TABLE_BUCKETS = 4096
PACKED = "bucket bigint, chunk bigint, data binary"
#: A hash of the first step without its bucket: 47 bits, and a last bit for an indexed block.
LOW = np.uint64((1 << 48) - 2)
ENTRY = np.dtype([("window", "<u8"), ("more", "<u4"), ("doc_id", "<i8")])


class _Words:
    """All words of a chunk, its documents in order of their id, those without id last."""

    def __init__(self, rows: pd.DataFrame):
        self.rows = rows.sort_values("doc_id", kind="stable", na_position="last", ignore_index=True)
        self.texts = [t.encode("utf-8", "surrogatepass") for t in self.rows["text"]]
        self.hashes, self.bounds = word_hashes(self.texts)
        self.named = self.rows["doc_id"].notna().to_numpy()
        self.ids = self.rows["doc_id"].fillna(0).to_numpy(dtype=np.int64)
        sizes = np.diff(self.bounds)
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        self.place = np.arange(len(self.row)) - np.repeat(self.bounds[:-1], sizes)
        self.left = np.repeat(self.bounds[1:], sizes) - np.arange(len(self.row))

    def starts(self, width: int) -> np.ndarray:
        """Which words begin a run of ``width`` words of a document with an id."""
        return (self.left >= width) & self.named[self.row] if len(self.row) else np.zeros(0, dtype=bool)

    def probes(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of all rolling runs of ``width`` words."""
        at = np.flatnonzero(self.starts(width))
        return at, window_hashes(self.hashes, width)[at]

    def windows(self, width: int, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the chosen runs of ``width`` words, with two hashes of each."""
        at = np.flatnonzero(self.starts(width) & chosen)
        other = mixed(self.hashes + np.uint64(0x9E3779B97F4A7C15))
        return at, window_hashes(self.hashes, width)[at], (window_hashes(other, width)[at] >> np.uint64(32)).astype(np.uint32)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets by the upper bits, in the order of the hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _cuts(sorted_keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Each key with the range of its places."""
    if len(sorted_keys):
        begins = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1]))
        yield from zip(sorted_keys[begins].tolist(), begins.tolist(), [*begins[1:].tolist(), len(sorted_keys)], strict=True)


def _frame(found: list[tuple[int, int, bytes]]) -> pd.DataFrame:
    return pd.DataFrame(found, columns=["bucket", "chunk", "data"])


def _short(values: np.ndarray) -> bytes:
    """The lower 48 bits of each value."""
    return (values >> np.uint64(16)).astype("<u4").tobytes() + values.astype("<u2").tobytes()


def _long(data: bytes) -> np.ndarray:
    n = len(data) // 6
    return (np.frombuffer(data, "<u4", n).astype(np.uint64) << np.uint64(16)) | np.frombuffer(data, "<u2", n, 4 * n).astype(np.uint64)


def _sent_probes(block: int, buckets: int):
    def work(rows: pd.DataFrame) -> pd.DataFrame:
        words = _Words(rows)
        at, hashes = words.probes(block)
        indexed = (words.place[at] % block == 0).astype(np.uint64)
        marked = np.unique((hashes & ~np.uint64(1)) | indexed)
        # Of a hash that stands both ways the indexed entry is kept.
        kept = np.append((marked[1:] ^ marked[:-1]) != 1, True) if len(marked) else np.zeros(0, dtype=bool)
        marked = marked[kept]
        chunk = int(rows["chunk"].iloc[0])
        return _frame([(b, chunk, _short(marked[i:j])) for b, i, j in _cuts(_bucket(marked, buckets))])

    return work


def _hit(rows: pd.DataFrame) -> pd.DataFrame:
    """The hashes of a bucket that several chunks have, one of them as an indexed block, for each of these chunks."""
    parts = [_long(d) for d in rows["data"]]
    chunk = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    marked = np.concatenate(parts)
    order = np.argsort(marked & LOW, kind="stable")
    marked, chunk = marked[order], chunk[order]
    begins = np.append(True, (marked[1:] & LOW) != (marked[:-1] & LOW))
    run = np.cumsum(begins) - 1
    met = (np.bincount(run) > 1) & (np.bincount(run, weights=(marked & np.uint64(1)).astype(np.float64)) > 0)
    marked, chunk = marked[met[run]] & LOW, chunk[met[run]]
    order = np.argsort(chunk, kind="stable")
    bucket, chunks = int(rows["bucket"].iloc[0]), rows["chunk"].to_numpy()
    return _frame([(bucket, int(chunks[c]), _short(marked[order[i:j]])) for c, i, j in _cuts(chunk[order])])


def _sent_windows(window: int, block: int, buckets: int):
    def work(rows: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or hits.empty:
            return _frame([])
        words = _Words(rows)
        at, hashes = words.probes(block)
        hits = hits.sort_values("bucket")
        known = np.concatenate([_long(d) | np.uint64(b << 48) for b, d in zip(hits["bucket"], hits["data"], strict=True)])
        known.sort()
        own = (hashes & LOW) | (_bucket(hashes, buckets).astype(np.uint64) << np.uint64(48))
        hit = np.zeros(len(words.hashes) + 1, dtype=np.int64)
        hit[at[known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own] + 1] = 1
        hit = np.cumsum(hit)
        # A window goes on if one of its runs of a block's length is a hit.
        ends = np.minimum(np.arange(len(words.hashes)) + window - block + 1, len(words.hashes))
        at, first, second = words.windows(window, hit[ends] > hit[:-1])
        entries = np.zeros(len(at), dtype=ENTRY)
        entries["window"], entries["more"], entries["doc_id"] = first, second, words.ids[words.row[at]]
        entries = _least(entries)
        chunk = int(rows["chunk"].iloc[0])
        return _frame([(b, chunk, _columns(entries[i:j])) for b, i, j in _cuts(_bucket(entries["window"], buckets))])

    return work


def _least(entries: np.ndarray) -> np.ndarray:
    """One entry of each window, in order: the first, which has the least document."""
    entries = entries[np.lexsort((entries["more"], entries["window"]))]
    return entries[_begins(entries)]


def _begins(entries: np.ndarray) -> np.ndarray:
    if not len(entries):
        return np.zeros(0, dtype=bool)
    same = (entries["window"][1:] == entries["window"][:-1]) & (entries["more"][1:] == entries["more"][:-1])
    return np.append(True, ~same)


def _columns(entries: np.ndarray) -> bytes:
    """The entries column by column, which compresses better."""
    return b"".join(np.ascontiguousarray(entries[name]).tobytes() for name in ENTRY.names)


def _entries(data: bytes) -> np.ndarray:
    n, at = len(data) // ENTRY.itemsize, 0
    entries = np.empty(n, dtype=ENTRY)
    for name in ENTRY.names:
        entries[name] = np.frombuffer(data, ENTRY[name], n, at)
        at += n * ENTRY[name].itemsize
    return entries


def _told(rows: pd.DataFrame) -> pd.DataFrame:
    """For each chunk the windows that have a smaller document elsewhere, with the least document."""
    parts = [_entries(d) for d in rows["data"]]
    chunk = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    entries = np.concatenate(parts)
    order = np.lexsort((entries["more"], entries["window"]))
    entries, chunk = entries[order], chunk[order]
    begins = np.flatnonzero(_begins(entries))
    sizes = np.diff(np.append(begins, len(entries)))
    least = np.repeat(np.minimum.reduceat(entries["doc_id"], begins), sizes)
    later = np.flatnonzero(entries["doc_id"] > least)
    entries, chunk = entries[later], chunk[later]
    entries["doc_id"] = least[later]
    order = np.argsort(chunk, kind="stable")
    entries = entries[order]
    bucket, chunks = int(rows["bucket"].iloc[0]), rows["chunk"].to_numpy()
    return _frame([(bucket, int(chunks[c]), _columns(entries[i:j])) for c, i, j in _cuts(chunk[order])])


def _removed(window: int):
    def work(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({"doc_id": [], "n_words": [], "n_removed": [], "kept_sha256": []})
        words = _Words(rows)
        at, first, second = words.windows(window, np.ones(len(words.row), dtype=bool))
        # Told entries come first: their document is smaller than any of the chunk that has the window.
        own = np.zeros(len(at), dtype=ENTRY)
        own["window"], own["more"], own["doc_id"] = first, second, words.ids[words.row[at]]
        other = np.concatenate([np.zeros(0, ENTRY), *[_entries(d) for d in told["data"]]])
        entries = np.concatenate([other, own])
        order = np.lexsort((entries["more"], entries["window"]))
        begins = _begins(entries[order])
        least = entries["doc_id"][order][begins][np.cumsum(begins) - 1] if len(order) else entries["doc_id"]
        later = order[entries["doc_id"][order] > least] - len(other)
        change = np.zeros(len(words.row) + 1, dtype=np.int64)
        change[at[later]] += 1
        np.add.at(change, at[later] + window, -1)
        kept = np.cumsum(change)[:-1] == 0
        found = []
        for text, a, b in zip(words.texts, words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
            flags, own_words = kept[a:b], text.split()
            left = own_words if flags.all() else compress(own_words, flags.tolist())
            found.append((b - a, b - a - int(flags.sum()), hashlib.sha256(b" ".join(left)).hexdigest()))
        frame = pd.DataFrame(found, columns=["n_words", "n_removed", "kept_sha256"])
        frame.insert(0, "doc_id", words.rows["doc_id"].array)
        return frame

    return work


def remove_repeated_words(docs: DataFrame, window: int = WINDOW, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256``."""
    block = (window + 1) // 2
    body = whole_text(text)
    total = docs.select(F.sum(F.octet_length(body))).first()[0] or 0
    chunks, buckets = max(1, math.ceil(total / CHUNK_BYTES)), max(1, math.ceil(total / BUCKET_BYTES))
    rows = docs.select(ref(key).cast("long").alias("doc_id"), body.alias("text")).withColumn(
        "chunk", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks))
    )
    table = bucketed(rows, min(chunks, TABLE_BUCKETS), "chunk")
    probes = table.groupBy("chunk").applyInPandas(_sent_probes(block, buckets), PACKED)
    hits = staged(probes.groupBy("bucket").applyInPandas(_hit, PACKED))
    around = table.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInPandas(_sent_windows(window, block, buckets), PACKED)
    told = staged(around.groupBy("bucket").applyInPandas(_told, PACKED))
    return table.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(
        _removed(window), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
    )
