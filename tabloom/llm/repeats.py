"""Repeated passages by prefix-free parsing: bytes covered by a string of ``LENGTH`` bytes that starts anywhere else too.

A rolling hash of ``TRIGGER`` bytes marks one position in ``EVERY``: the parse.  A window of ``LENGTH`` bytes is
named by its first mark, at most three quarters of a window in; since the mark depends on the
window's own bytes, equal windows have it at the same offset.  All windows that share a first mark, and a range of
offsets from it, are one entry with two hashes: of the bytes that all of them hold (the core: what
follows the mark), and of all the bytes they span (the block).

Only the first ``LENGTH`` bytes of a suffix matter here, so instead of full suffix arrays the suffixes of the parse are
ordered by core and block, which brings together those that agree so far.  Entries of equal blocks are repeated as a whole.  Where a core has
several blocks, the windows of each block, of repeated ones once, are ordered in a second
round one by one; all other windows occur once.  Windows without a mark in reach are ordered one by one in
the first round.  So the work per byte is one entry for ``EVERY`` bytes, and windows only at the ends of repeats.

Tasks resolve what repeats within them before anything is shuffled, send one entry of each kind, and spread a core
with many blocks over buckets; a bucket is some megabytes at every size.  Between rounds only
ranges are kept, and a round's shuffle files are removed when it is written; texts are read again and joined with them by their row's id and hash.

Entries are compared by two hashes of 64 bits.  Defined cases: a null or empty text has no bytes; a text shorter than the length has nothing to remove;
equal rows are repeats of each other; no match crosses two rows; an empty table gives an empty result; other columns are not read.
A single text has to fit in a task's memory.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import ref
from tabloom.llm.common import whole_text
from tabloom.llm.shingles import CHUNK, _power_tables, mixed
from tabloom.session import staged

LENGTH = 200
TRIGGER = 8
EVERY = 32
#: Offsets of a window's first mark, as shares of its length, up to which entries are kept apart; beyond the last one the window stands alone.
LEVELS = (0.32, 0.64, 0.8)
#: Entries that a task holds before it sends them, and blocks of a core in them from which on it is spread.
HELD = 250_000
CROWDED = 64
#: Bytes of text per bucket of entries.
BUCKET_BYTES = 8 << 20

ENTRY = np.dtype([("core", "<u8"), ("block", "<u8"), ("row", "<u4"), ("low", "<u4"), ("span", "<u2"), ("flags", "<u1")])
MANY, SPREAD, MARKER = 1, 2, 4
RANGE = np.dtype([("row", "<u4"), ("low", "<u4"), ("high", "<u4")])
ROW = np.dtype([("row", "<u4"), ("none", "<u1"), ("doc_id", "<i8"), ("mark", "<i8")])
PACKED = "bucket bigint, part bigint, kind int, data binary"
RESOLVED = "kind int, number bigint, low bigint, high bigint, doc_id bigint, mark bigint"
ENTRIES, RANGES, ROWS, EDGES = range(4)


class _Text:
    """Some texts one after another, with the hash of any of their substrings."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.ends = np.cumsum([len(t) for t in texts]).astype(np.int64)
        self.starts = self.ends - np.array([len(t) for t in texts], dtype=np.int64)
        powers, self.back = _power_tables(len(self.data) + 1)
        self.sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers[: len(self.data)], out=self.sums[1:])

    def hashes(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return mixed((self.sums[high] - self.sums[low]) * self.back[low] + (high - low).astype(np.uint64))

    def marks(self) -> np.ndarray:
        """Positions whose next bytes, of the same text, are a trigger."""
        n = len(self.data) - TRIGGER + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64)
        hashed = (self.sums[TRIGGER:] - self.sums[:n]) * self.back[:n]
        hashed ^= hashed >> np.uint64(29)
        hashed *= np.uint64(0xBF58476D1CE4E5B9)
        at = np.flatnonzero((hashed >> np.uint64(40)) % np.uint64(EVERY) == 0)
        return at[at + TRIGGER <= self.ends[np.searchsorted(self.ends, at, side="right")]]

    def entries(self, length: int, first_row: int) -> np.ndarray:
        """The entries of all windows."""
        bounds = [int(length * share) for share in LEVELS]
        last = self.ends - length  # of a window's start
        marks = self.marks()
        text = np.searchsorted(self.ends, marks, side="right")
        previous = np.full(len(marks), -1, dtype=np.int64)
        previous[1:] = marks[:-1]
        low = np.maximum(np.maximum(previous + 1, self.starts[text]), marks - bounds[-1] + 1)
        high = np.minimum(marks, last[text])
        parts, covered = [], np.zeros(len(self.data) + 1, dtype=np.int32)
        for level, upto in enumerate(bounds):
            least = bounds[level - 1] if level else 0
            a, b = np.maximum(low, marks - upto + 1), np.minimum(high, marks - least)
            real = a <= b
            a, b, m, t = a[real], b[real], marks[real], text[real]
            part = np.zeros(len(a), dtype=ENTRY)
            part["core"] = self.hashes(m, m + length - upto + 1) + np.uint64(level)
            shape = ((m - a) * 512 + (b - a)).astype(np.uint64)
            part["block"] = mixed(self.hashes(a, b + length) + shape * np.uint64(0x9E3779B97F4A7C15))
            part["row"], part["low"], part["span"] = t + first_row, a - self.starts[t], b - a
            parts.append(part)
            np.add.at(covered, a, 1)
            np.add.at(covered, b + 1, -1)
        valid = np.zeros(len(self.data) + 1, dtype=np.int32)
        long = last >= self.starts
        np.add.at(valid, self.starts[long], 1)
        np.add.at(valid, last[long] + 1, -1)
        alone = np.flatnonzero((np.cumsum(valid) > 0) & (np.cumsum(covered) == 0))
        parts.append(self.windows(alone, length, first_row))
        return np.concatenate(parts)

    def windows(self, at: np.ndarray, length: int, first_row: int) -> np.ndarray:
        """An entry for each single window."""
        text = np.searchsorted(self.ends, at, side="right")
        part = np.zeros(len(at), dtype=ENTRY)
        part["core"] = self.hashes(at, at + length) ^ np.uint64(0xA5A5A5A5A5A5A5A5)
        part["block"] = self.hashes(at + length // 2, at + length)
        part["row"], part["low"] = text + first_row, at - self.starts[text]
        return part


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and which places of it begin a run of them."""
    order = np.lexsort(keys[::-1])
    begins = np.ones(len(order), dtype=bool)
    if len(order):
        same = np.ones(len(order) - 1, dtype=bool)
        for key in keys:
            ordered = key[order]
            same &= ordered[1:] == ordered[:-1]
        begins[1:] = ~same
    return order, begins


def _merged(number: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of each number, united where they meet."""
    if not len(low):
        return number, low, high
    order = np.lexsort((low, number))
    number, low, high = number[order], low[order].astype(np.int64), high[order].astype(np.int64)
    _, group = np.unique(number, return_inverse=True)
    shift = group.astype(np.int64) * (int(high.max()) + 2)
    reach = np.maximum.accumulate(high + shift)
    begins = np.ones(len(low), dtype=bool)
    begins[1:] = (low + shift)[1:] > reach[:-1]
    at = np.flatnonzero(begins)
    stops = np.append(at[1:], len(low)) - 1
    return number[at], low[at], reach[stops] - shift[at]


def _sent(entries: np.ndarray, rows: np.ndarray, length: int, buckets: int, part: int) -> pd.DataFrame:
    """What a task sends: one entry of each block, the ranges that it has resolved, and its rows."""
    order, begins = _runs(entries["core"], entries["block"])
    entries = entries[order]
    size = np.diff(np.append(np.flatnonzero(begins), len(entries)))
    many = np.repeat(size > 1, size)
    done = entries[many]
    number, low, high = _merged(done["row"], done["low"].astype(np.int64), done["low"].astype(np.int64) + done["span"] + length)
    ranges = np.zeros(len(low), dtype=RANGE)
    ranges["row"], ranges["low"], ranges["high"] = number, low, high
    one = entries[begins]
    one["flags"] = np.where(size > 1, MANY, 0)
    cores = np.flatnonzero(np.append(True, one["core"][1:] != one["core"][:-1])) if len(one) else np.zeros(0, dtype=np.int64)
    blocks = np.diff(np.append(cores, len(one)))
    spread = np.repeat(blocks > CROWDED, blocks)
    marker = one[cores[blocks > CROWDED]].copy()
    marker["flags"] = MARKER
    one["flags"][spread] |= SPREAD
    one = np.concatenate([one, marker])
    key = np.where(one["flags"] & SPREAD > 0, mixed(one["core"] ^ one["block"]), one["core"])
    place = (mixed(key) % np.uint64(buckets)).astype(np.int64)
    found = []
    for kind, table, at in (
        (ENTRIES, one, place), (RANGES, ranges, ranges["row"].astype(np.int64) % buckets), (ROWS, rows, rows["row"].astype(np.int64) % buckets)
    ):
        by = np.argsort(at, kind="stable")
        table, at = table[by], at[by]
        cuts = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else at
        for a, b in zip(cuts, [*cuts[1:], len(at)] if len(at) else cuts, strict=True):
            found.append((int(at[a]), part, kind, table[a:b].tobytes()))
    return pd.DataFrame(found, columns=["bucket", "part", "kind", "data"])


def _encoded(texts: pd.Series) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in texts]


def _encoded_chunks(texts: pd.Series, limit: int) -> Iterator[tuple[int, list[bytes]]]:
    """The texts as bytes, about ``limit`` bytes at a time, with the place of each first one."""
    low, size, held = 0, 0, []
    for at, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass")
        if held and size + len(data) > limit:
            yield low, held
            low, size, held = at, 0, []
        held.append(data)
        size += len(data)
    if held:
        yield low, held


def _known_rows(batch: pd.DataFrame, first: int) -> np.ndarray:
    rows = np.zeros(len(batch), dtype=ROW)
    rows["row"] = np.arange(first, first + len(batch))
    rows["none"] = batch["doc_id"].isna().to_numpy()
    rows["doc_id"], rows["mark"] = batch["doc_id"].fillna(0).to_numpy(dtype=np.int64), batch["mark"].to_numpy()
    return rows


def _sending(length: int, buckets: int, entries_of):
    """Send entries in groups of some ``HELD``; ``entries_of`` gives those of some texts piece by piece."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, row = TaskContext.get().partitionId(), 0
        held, rows, size = [], [], 0
        for batch in batches:
            rows.append(_known_rows(batch, row))
            for low, texts in _encoded_chunks(batch["text"], CHUNK):
                for entries in entries_of(batch, low, texts, row + low):
                    held.append(entries)
                    size += len(entries)
                    if size > HELD:
                        yield _sent(np.concatenate(held), np.concatenate([np.zeros(0, ROW), *rows]), length, buckets, part)
                        held, rows, size = [], [], 0
            row += len(batch)
        if held or rows:
            yield _sent(np.concatenate([np.zeros(0, ENTRY), *held]), np.concatenate([np.zeros(0, ROW), *rows]), length, buckets, part)

    return work


def _parsed(length: int, buckets: int):
    def entries(batch: pd.DataFrame, low: int, texts: list[bytes], row: int) -> Iterator[np.ndarray]:
        yield _Text(texts).entries(length, row)

    return _sending(length, buckets, entries)


def _windows(length: int, buckets: int):
    """Entries of the single windows of a text's edges."""

    def entries(batch: pd.DataFrame, low: int, texts: list[bytes], row: int) -> Iterator[np.ndarray]:
        some = _Text(texts)
        for k in range(len(texts)):
            edges = np.asarray(batch["edges"].iloc[low + k], dtype=np.int64)
            first, last = edges >> 32, edges & 0xFFFFFFFF
            sizes = last - first + 1
            offset = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            at = np.unique(some.starts[k] + np.repeat(first, sizes) + offset)
            for begin in range(0, len(at), HELD):
                yield some.windows(at[begin : begin + HELD], length, row)

    return _sending(length, buckets, entries)


def _resolved(length: int):
    def work(bucket: pd.DataFrame) -> pd.DataFrame:
        def tables(kind: int, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
            own = bucket[bucket["kind"] == kind]
            parts = [np.frombuffer(d, dtype=dtype) for d in own["data"]]
            table = np.concatenate([np.zeros(0, dtype), *parts])
            number = np.repeat(own["part"].to_numpy(dtype=np.int64) << 32, [len(p) for p in parts]) + table["row"]
            return table, number

        def found(kind: int, number, low=0, high=0, doc_id=None, mark=None) -> pd.DataFrame:
            frame = pd.DataFrame({"kind": kind, "number": number})
            frame["low"], frame["high"], frame["doc_id"], frame["mark"] = low, high, doc_id, mark
            return frame.astype({"kind": "int32", "low": "int64", "high": "int64", "doc_id": "Int64", "mark": "Int64"})

        entries, number = tables(ENTRIES, ENTRY)
        order, begins = _runs(entries["core"], entries["flags"] & MARKER, entries["block"])
        entries, number = entries[order], number[order]
        run = np.cumsum(begins) - 1
        weight = np.where(entries["flags"] & MANY > 0, 2, 1)
        repeated = (np.bincount(run, weights=weight, minlength=1) > 1)[run] & (entries["flags"] & MARKER == 0)
        # Several blocks of a core meet here, or its task has told that there are more elsewhere.
        core = np.cumsum(np.append(True, entries["core"][1:] != entries["core"][:-1])) - 1 if len(entries) else run
        several = (np.bincount(core, weights=begins, minlength=1) > 1)[core] | (entries["flags"] & SPREAD > 0)
        edge = several & (~repeated | begins) & (entries["flags"] & MARKER == 0)
        ranges, of = tables(RANGES, RANGE)
        rows, row_number = tables(ROWS, ROW)
        low = entries["low"].astype(np.int64)
        last = low + entries["span"]
        united = _merged(
            np.concatenate([number[repeated], of]), np.concatenate([low[repeated], ranges["low"].astype(np.int64)]),
            np.concatenate([last[repeated] + length, ranges["high"].astype(np.int64)]),
        )
        known = pd.arrays.IntegerArray(rows["doc_id"].copy(), rows["none"].astype(bool))
        return pd.concat(
            [
                found(RANGES, *united), found(EDGES, number[edge], low[edge], last[edge]),
                found(ROWS, row_number, doc_id=known, mark=rows["mark"]),
            ]
        )

    return work


def _removed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = []
        for text, ranges in zip(_encoded(batch["text"]), batch["ranges"], strict=True):
            cuts, at, removed, spans = [], 0, 0, 0
            if ranges is not None and len(ranges):
                packed = np.asarray(ranges, dtype=np.int64)
                _, low, high = _merged(np.zeros(len(packed), dtype=np.int64), packed >> 32, packed & 0xFFFFFFFF)
                for a, b in zip(low.tolist(), high.tolist(), strict=True):
                    cuts.append(text[at:a])
                    at, removed, spans = b, removed + b - a, spans + 1
            cuts.append(text[at:])
            found.append((len(text), removed, spans, hashlib.sha256(b"".join(cuts)).hexdigest()))
        frame = pd.DataFrame(found, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
        frame.insert(0, "doc_id", batch["doc_id"].array)
        yield frame


def remove_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``."""
    body = whole_text(text)
    number = ref(key).cast("long")
    total = docs.select(F.sum(F.octet_length(body))).first()[0] or 0
    buckets = max(1, math.ceil(total / BUCKET_BYTES))
    # A row is named by its id, 0 where there is none, and a hash of its text and of whether it has an id.
    rows = docs.select(
        number.alias("doc_id"), body.alias("text"), F.coalesce(number, F.lit(0)).alias("name"), F.xxhash64(number.isNull(), body).alias("mark")
    )

    def resolved(packed: DataFrame) -> DataFrame:
        return staged(packed.groupBy("bucket").applyInPandas(_resolved(length), RESOLVED), drop_shuffles=True)

    first = resolved(rows.select("doc_id", "text", "mark").mapInPandas(_parsed(length, buckets), PACKED))

    def of_rows(found: DataFrame, kind: int, name: str) -> DataFrame:
        known = found.filter(F.col("kind") == ROWS).select("number", F.coalesce("doc_id", F.lit(0)).alias("name"), "mark")
        ranges = found.filter(F.col("kind") == kind).select("number", ((F.col("low") * F.lit(1 << 32)) + F.col("high")).alias("_range"))
        return ranges.join(known, "number").groupBy("name", "mark").agg(F.collect_set("_range").alias(name))

    edges = rows.join(of_rows(first, EDGES, "edges"), ["name", "mark"]).select("doc_id", "mark", "text", "edges")
    second = resolved(edges.mapInPandas(_windows(length, buckets), PACKED))
    both = of_rows(first, RANGES, "ranges").unionByName(of_rows(second, RANGES, "ranges"))
    ranges = both.groupBy("name", "mark").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    joined = rows.join(ranges, ["name", "mark"], "left").select("doc_id", "text", "ranges")
    return joined.mapInPandas(_removed, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
