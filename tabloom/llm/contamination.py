"""Benchmark decontamination by templates, which also catches questions asked again with other values.

A text is cut into words; numbers, units after a number and names (a capital inside a
sentence) become typed slots, all else is lower-cased.  Windows of ``WIDTH`` words are hash-joined with
those of the benchmark items at three levels: the lower-cased words themselves, with slots for numbers and units,
and with slots for names too.  Windows of equal words count whatever their slots say, so a copy in
other capitals is found as well.  Windows equal by slots alone count if their slot values fit a one-to-one map from the
values of the item to those of the document at that alignment; the map takes values that stay the same first, then
the pairs of most windows, and a window with a pair outside it is dropped alone.
A document is contaminated if the counted windows make up ``COVERAGE`` of an item's windows or, at one alignment,
``RUN`` words.

Only windows with a hash of the benchmark leave the Python stage.  The hashes are sent to the tasks if
they number at most ``SENT``; beyond that all windows go to the join, with the same result.

Defined cases: a null or empty text or item has no words and shares nothing; an item shorter than a window is one window of
its own length; equal rows are judged each, the same item given twice counts once per id; an empty table on either
side gives no contamination; other columns are not read.  A name that was changed is a slot only where capitals show it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import ref
from tabloom.llm.shingles import _power_tables, chunks, mixed, window_hashes
from tabloom.session import staged

WIDTH = 8
COVERAGE = 0.5
RUN = 20
SENT = 2_000_000
#: Words that are a unit right after a number, and marks that end a sentence.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg ounce ounces pound pounds ton tons ml l liter liters "
    "litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "percent degree degrees dollar dollars cent cents euro euros meter meters metre metres kilometer kilometers gram grams kilogram kilograms"
).split()
STOPS = b".!?:;\n\r\"("

_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[65:91] = True
_WORD = _DIGIT | _CAPITAL
_WORD[97:123] = _WORD[128:] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(STOPS)] = True
NUMBER, NAME, UNIT = (np.uint64(n) for n in (11, 13, 17))


def _flags_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, which of them were capitals, and which belong to words."""
    capital = _CAPITAL[data]
    accented = np.zeros(len(data), dtype=bool)  # the capitals of Latin-1, in UTF-8
    accented[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    capital |= accented
    word = _WORD[data]
    digit = _DIGIT[data]
    inside = np.zeros(len(data), dtype=bool)
    inside[1:-1] = digit[:-2] & digit[2:] & ((data[1:-1] == 46) | (data[1:-1] == 44))
    return np.where(capital, data + 32, data).astype(np.uint8), capital, word | inside


def _sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=out[1:])
    return out


def template_words(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of all words of some texts at each level (own, numbers and units as slots, names too), and where each text begins."""
    data = np.frombuffer(b"\n".join([b"", *texts, b""]), dtype=np.uint8)
    lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    lowered, capital, word = _flags_of(data)
    starts = np.flatnonzero(~word[:-1] & word[1:]) + 1
    stops = np.flatnonzero(word[:-1] & ~word[1:]) + 1
    powers, back = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((lowered.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    own = mixed((sums[stops] - sums[starts]) * back[starts] + (stops - starts).astype(np.uint64))
    digits, capitals, ends = _sums(_DIGIT[data]), _sums(capital), _sums(_STOP[data])
    number = _DIGIT[data[starts]] & _DIGIT[data[stops - 1]] & (digits[stops] - digits[starts] >= (stops - starts + 1) // 2)
    before = np.concatenate([[0], stops[:-1]])
    first = ends[starts] > ends[before]
    name = ~number & ~first & (capitals[stops] - capitals[starts] == 1) & (capitals[np.minimum(starts + 2, stops)] > capitals[starts])
    name &= stops - starts > 1
    unit = np.zeros(len(starts), dtype=bool)
    unit[1:] = number[:-1] & np.isin(own[1:], _UNIT_HASHES)
    numbers = own.copy()
    numbers[number] = NUMBER
    names = numbers.copy()
    names[name] = NAME
    for level in (numbers, names):
        level[unit] = UNIT
    bounds = np.searchsorted(starts, np.concatenate([[0], 1 + np.cumsum(lengths)]))
    return [own, numbers, names], bounds


_UNIT_HASHES = np.zeros(0, dtype=np.uint64)
_UNIT_HASHES = np.sort(template_words([u.encode() for u in UNITS])[0][0])


def _encoded(texts: pd.Series) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in texts]


def _slots(template: np.ndarray, own: np.ndarray, at: int, width: int) -> list[int]:
    """Own hashes of the slots of a window, 0 for plain words; none if it has no slot."""
    part = template[at : at + width]
    slot = (part == NUMBER) | (part == NAME) | (part == UNIT)
    return np.where(slot, own[at : at + width], np.uint64(0)).astype(np.int64).tolist() if slot.any() else []


def _levels(levels: list[np.ndarray], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Window hashes of each level, and where they differ from those of the level below (at the first: everywhere)."""
    below = None
    for level, words in enumerate(levels):
        hashes = window_hashes(words, width)
        yield level, hashes, np.arange(len(hashes)) if below is None else np.flatnonzero(hashes != below)
        below = hashes


def _item_windows(width: int):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            levels, bounds = template_words(_encoded(batch["text"]))
            for item, a, b in zip(batch["item_id"].tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                size = min(width, b - a)
                if size:
                    for level, hashes, at in _levels([words[a:b] for words in levels], size):
                        for k, h in zip(at.tolist(), hashes[at].astype(np.int64).tolist(), strict=True):
                            # Equal words stand for themselves, in all slots.
                            slots = _slots(levels[level or 2], levels[0], a + k, size)
                            rows.append((h, size, level, item, k, len(hashes), slots))
            if rows:
                yield pd.DataFrame(rows, columns=["hash", "width", "level", "item_id", "item_at", "item_windows", "item_slots"])

    return work


def _document_windows(widths: list[int], sent):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, marks = batch["doc_id"].array, batch["mark"].to_numpy()
            texts = _encoded(batch["text"])
            for low, high in chunks(texts):
                levels, bounds = template_words(texts[low:high])
                found = []
                for width in widths:
                    for level, hashes, at in _levels(levels, width):
                        if sent is not None:
                            known, bits = sent.value
                            at = at[bits[(hashes[at] >> np.uint64(40)).astype(np.int64)]]
                            place = np.searchsorted(known, hashes[at])
                            at = at[known[np.minimum(place, len(known) - 1)] == hashes[at]]
                        row = np.searchsorted(bounds, at, side="right") - 1
                        inside = at + width <= bounds[row + 1]
                        for k, r in zip(at[inside].tolist(), row[inside].tolist(), strict=True):
                            slots = _slots(levels[level], levels[0], k, width) if level else []
                            found.append((r + low, k - int(bounds[r]), int(hashes[k].astype(np.int64)), width, level, slots))
                if not found:
                    continue
                rows = [f[0] for f in found]
                yield pd.DataFrame(
                    {
                        "doc_id": ids[rows], "mark": marks[rows], "at": [f[1] for f in found], "hash": [f[2] for f in found],
                        "width": [f[3] for f in found], "level": [f[4] for f in found], "slots": [f[5] for f in found],
                    }
                )

    return work


def agreeing(windows: list[list[int]]) -> int:
    """How many windows of one alignment count.  A window is its place in the item, its level, the slots of the item
    (0 for plain words) and, above the level of equal words, those of the document."""
    best: dict[int, tuple[int, list[tuple[int, int]]]] = {}
    for at, level, *slots in windows:
        if at not in best or level < best[at][0]:
            half = len(slots) // 2 if level else 0
            best[at] = level, [p for p in zip(slots[: half or None], slots[half:], strict=True) if p[0]]
    if not any(level for level, _ in best.values()):
        return len(best)
    votes = Counter(p for _, pairs in best.values() for p in set(pairs))
    there: dict[int, int] = {}
    back: dict[int, int] = {}
    for one, other in sorted(votes, key=lambda p: (p[0] != p[1], -votes[p], p)):
        if one not in there and other not in back:
            there[one], back[other] = other, one
    return sum(not level or all(there.get(a) == b for a, b in pairs) for level, pairs in best.values())


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        n = [agreeing([w.tolist() for w in windows]) for windows in batch["windows"]]
        yield batch.drop(columns="windows").assign(n=n)


def contaminated_pairs(
    docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id",
    width: int = WIDTH, coverage: float = COVERAGE, run: int = RUN,
) -> DataFrame:
    """``doc_id``, ``mark`` (a hash of the text), ``item_id``, ``share`` of the item's windows: one row per contaminated pair."""
    body = F.coalesce(ref(text).cast("string"), F.lit(""))
    wanted = docs.select(ref(key).cast("long").alias("doc_id"), body.alias("text")).withColumn("mark", F.xxhash64("text"))
    asked = items.select(ref(item_key).cast("long").alias("item_id"), F.coalesce(ref(item_text).cast("string"), F.lit("")).alias("text"))
    windows = staged(
        asked.distinct().mapInPandas(
            _item_windows(width), "hash bigint, width int, level int, item_id bigint, item_at int, item_windows int, item_slots array<bigint>"
        )
    )
    spark = docs.sparkSession
    widths = sorted(r.width for r in windows.select("width").distinct().collect())
    sent = None
    if windows.count() <= SENT:
        known = np.unique(np.array([r.hash for r in windows.select("hash").collect()], dtype=np.int64).astype(np.uint64))
        bits = np.zeros(1 << 24, dtype=bool)
        bits[(known >> np.uint64(40)).astype(np.int64)] = True
        sent = spark.sparkContext.broadcast((known, bits))
    found = wanted.mapInPandas(
        _document_windows(widths if widths else [], sent), "doc_id bigint, mark bigint, at int, hash bigint, width int, level int, slots array<bigint>"
    )
    shared = found.join(windows, ["hash", "width", "level"])
    # As a set: equal rows of documents give the same windows.
    aligned = (
        shared.groupBy("doc_id", "mark", "item_id", (F.col("at") - F.col("item_at")).alias("shift"))
        .agg(
            F.first("item_windows").alias("item_windows"), F.first("width").alias("width"),
            F.expr("collect_set(concat(array(cast(item_at as bigint), cast(level as bigint)), item_slots, slots))").alias("windows"),
        )
        .select("doc_id", "mark", "item_id", "item_windows", "width", "windows")
        .mapInPandas(_counted, "doc_id bigint, mark bigint, item_id bigint, item_windows int, width int, n bigint")
        .filter("n > 0")
    )
    share = F.least(F.sum("n") / F.first("item_windows"), F.lit(1.0))
    return (
        aligned.groupBy("doc_id", "mark", "item_id")
        .agg(share.alias("share"), F.max(F.col("n") + F.col("width") - 1).alias("longest"))
        .filter((F.col("share") >= coverage) | (F.col("longest") >= run))
        .select("doc_id", "mark", "item_id", "share")
    )


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """One row per input row: ``_row``, ``contaminated``, ``n_items`` it shares, the least of their ids, the greatest share."""
    hits = staged(
        contaminated_pairs(docs, items, text, key, **options).groupBy("doc_id", "mark").agg(
            F.count(F.lit(1)).alias("n_items"), F.min("item_id").alias("item_id"), F.max("share").alias("share")
        )
    ).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "n_items", "item_id", "share")
    rows = docs.select(
        F.struct(*[ref(c) for c in docs.columns]).alias("_row"), ref(key).cast("long").alias("_doc"),
        F.xxhash64(F.coalesce(ref(text).cast("string"), F.lit(""))).alias("_text"),
    )
    joined = rows.join(hits, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_mark")), "left")
    return joined.select(
        "_row", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "item_id",
        F.coalesce("share", F.lit(0.0)).alias("share"),
    )
