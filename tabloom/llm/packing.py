"""Packing: token pieces of documents into sequences of one capacity, by multiway differencing.

Every document is tokenized and ends with an end id.  It is cut at multiples of the
capacity: whole cuts fill sequences of their own, the rest is one piece shorter than the
capacity.  Pieces are dealt into blocks of bounded size by a hash of a number given
once, when the pieces are written; in a block Karmarkar-Karp differencing spreads them over windows
of near-equal length.  It starts with the least number of windows that could hold them and
takes one more while the longest window exceeds the capacity.  Waste is about one
window per block, and no step needs to see all pieces.

Defined cases: a null or empty text is its end id alone; equal rows are packed each;
texts of any length are cut; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import ref
from tabloom.llm.tokens import shared_cache
from tabloom.session import staged

CAPACITY = 4096
END = 2
#: Pieces that one task packs at a time.
BLOCK = 1024


def karmarkar_karp(sizes: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The set (0 to k - 1) of each size, and the sums of the sets, which are near equal.

    A partial partition is ``k`` sums, greatest first, with a node for each set.  The two
    partial partitions with the greatest spread are merged, the greatest sum of one
    with the least of the other, until one is left.
    """
    n = len(sizes)
    left, right = [], []  # nodes from n on have two children
    heap = []
    for number, size in enumerate(sizes):
        sums, nodes = np.zeros(k, dtype=np.int64), np.full(k, -1, dtype=np.int64)
        sums[0], nodes[0] = size, number
        heap.append((-size if k > 1 else 0, number, sums, nodes))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, sums_a, nodes_a = heapq.heappop(heap)
        _, serial, sums_b, nodes_b = heapq.heappop(heap)
        sums, other = sums_a + sums_b[::-1], nodes_b[::-1]
        nodes = np.maximum(nodes_a, other)
        both = np.flatnonzero((nodes_a >= 0) & (other >= 0))
        nodes[both] = np.arange(n + len(left), n + len(left) + len(both))
        left += nodes_a[both].tolist()
        right += other[both].tolist()
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), serial, sums, nodes))
    _, _, sums, nodes = heap[0]
    home = np.full(n + len(left), -1, dtype=np.int64)
    home[nodes[nodes >= 0]] = np.flatnonzero(nodes >= 0)
    for node in range(n + len(left) - 1, n - 1, -1):
        home[left[node - n]] = home[right[node - n]] = home[node]
    return home[:n], sums


def windows(sizes: list[int], capacity: int) -> np.ndarray:
    """A window for each size, near equal, none above the capacity.

    From the least possible number on, the number of windows rises, by the share of the
    excess and one at least, while the longest window exceeds the capacity.
    """
    k = max(1, math.ceil(sum(sizes) / capacity))
    while True:
        home, sums = karmarkar_karp(sizes, k)
        if sums[0] <= capacity:
            return home
        k += max(1, int(k * (int(sums[0]) - capacity) / capacity / 2))


def _tokenized(definition: str, capacity: int, end: int):
    mark = np.array([end], dtype="<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = shared_cache(definition)
        for batch in batches:
            for low in range(0, len(batch), 1000):
                rows = batch.iloc[low : low + 1000]
                of, start, length, crc, total = [], [], [], [], []
                for at, ids in enumerate(cache.batch(rows["text"].tolist())):
                    ids += mark
                    for begin in range(0, len(ids), 4 * capacity):
                        piece = ids[begin : begin + 4 * capacity]
                        of.append(at)
                        start.append(begin // 4)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(len(ids) // 4)
                yield pd.DataFrame(
                    {"doc_id": rows["doc_id"].array[of], "start": start, "length": length, "ids_crc32": crc, "doc_tokens": total}
                )

    return cut


def _packed(capacity: int):
    def pack(block: pd.DataFrame) -> pd.DataFrame:
        # Sorted by number, so that a task run again gives the same sequences.
        block = block.sort_values("_piece", ignore_index=True)
        window = windows(block["length"].tolist(), capacity)
        block["sequence_id"] = (block["_block"].to_numpy() << 32) + window
        block["offset"] = block.groupby("sequence_id")["length"].cumsum() - block["length"]
        return block[[*PIECE_COLUMNS, "sequence_id", "offset"]]

    return pack


PIECE_COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
#: Sequences that one whole cut fills are numbered from here on.
FULL = 1 << 62


def pack_documents(
    docs: DataFrame, definition: str, text: str = "text", key: str = "doc_id",
    capacity: int = CAPACITY, end: int = END, block: int = BLOCK,
) -> DataFrame:
    """One row per piece: where it was cut from, and its sequence and place there.

    ``definition`` is the content of a tokenizer file, read by the caller and sent
    with the tasks, so that executors need no file of their own.
    """
    wanted = docs.select(ref(key).cast("long").alias("doc_id"), F.coalesce(ref(text).cast("string"), F.lit("")).alias("text"))
    pieces = wanted.mapInPandas(
        _tokenized(definition, capacity, end),
        "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint",
    )
    # The number of a piece is written with it: what depends on it stays the same if tasks run again.
    pieces = staged(pieces.withColumn("_piece", F.monotonically_increasing_id()))
    full = pieces.filter(F.col("length") == capacity).select(
        *PIECE_COLUMNS, (F.lit(FULL) + F.col("_piece")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = pieces.filter(F.col("length") < capacity)
    blocks = max(1, math.ceil(rest.count() / block))
    dealt = rest.withColumn("_block", F.pmod(F.xxhash64("_piece"), F.lit(blocks)))
    schema = ", ".join(f"{c} bigint" for c in (*PIECE_COLUMNS, "sequence_id", "offset"))
    return full.unionByName(dealt.groupBy("_block").applyInPandas(_packed(capacity), schema))
