"""Hard-negative mining by the threshold algorithm over sorted lists of each dimension.

Candidates are dealt into blocks of bounded size; a block holds its integer vectors and, for each dimension, its rows
in order of that component.  Anchors are dealt into blocks too, and each two blocks meet in one task.  There an
anchor goes down the list of every dimension in which it is not zero, from the top or the bottom as the
sign of its component says, scores each row that it meets for the first time by an integer inner product, and stops as soon as
the threshold (the score of a row that stands at the current depth of every list) is strictly below the kth score of
each of its windows, so ties are never lost.  A window is a range of scores; a window is also
settled once the threshold is below the range.  The best k of every block are then merged by anchor and window.

Two searches: the positives, rows of the anchor's label with any score, then the negatives, rows of another label in
the score range that each positive sets.  Depths double, so a list is read to at most twice the depth needed.

Defined cases: rows without id, label or vector, or with a null component, take no part; of several rows with one id the one with
the least label and vector counts; a shorter vector counts as filled with zeros; a negative positive score sets an
empty range; an empty table gives an empty result; other columns are not read.  Scores have to stay below 2**62.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.columns import ref
from tabloom.session import staged

POSITIVES, NEGATIVES = 5, 10
#: The range of a negative's score, in hundredths of the positive's.
LOW, HIGH = 30, 90
#: Rows and anchors of a block.
ROWS, ANCHORS = 8192, 128
FIRST_DEPTH = 16
NONE = -(1 << 62)


class Lists:
    """Rows of one block, with the sorted list of each dimension."""

    def __init__(self, vectors: np.ndarray, order: np.ndarray | None = None):
        self.vectors = vectors
        self.rows = len(vectors)
        self.order = np.argsort(vectors, axis=0, kind="stable").T if order is None else order
        depths = [FIRST_DEPTH << i for i in range(64) if FIRST_DEPTH << i < self.rows]
        self.depths = [*depths, self.rows]
        columns = np.arange(vectors.shape[1])
        self.least = np.array([vectors[self.order[:, d - 1], columns] for d in self.depths])
        self.most = np.array([vectors[self.order[:, self.rows - d], columns] for d in self.depths])

    def thresholds(self, anchors: np.ndarray) -> np.ndarray:
        """For each anchor and depth, the most that a row not met up to there can score."""
        return np.maximum(anchors, 0) @ self.most.T + np.minimum(anchors, 0) @ self.least.T

    def best(
        self, anchor: np.ndarray, threshold: np.ndarray, fit: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, k: int
    ) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places and scores of the first ``k`` fitting rows of each window, by score, then id."""
        up, down = self.order[anchor > 0], self.order[anchor < 0]
        met = np.zeros(self.rows, dtype=bool)
        scores = np.zeros(self.rows, dtype=np.int64)
        top, at = int(high.max()), 0
        for depth, limit in zip(self.depths, threshold.tolist(), strict=True):
            if limit >= top and depth < self.rows:
                continue  # no window can be settled here yet
            fresh = np.zeros(self.rows, dtype=bool)
            fresh[up[:, self.rows - depth : self.rows - at].ravel()] = True
            fresh[down[:, at:depth].ravel()] = True
            if not len(up) and not len(down):
                fresh[:] = True  # all score zero
            fresh &= ~met
            met |= fresh
            some = np.flatnonzero(fresh & fit)
            scores[some] = self.vectors[some] @ anchor
            at = depth
            places = np.flatnonzero(met & fit)
            own = scores[places]
            inside = [places[(own >= a) & (own <= b)] for a, b in zip(low.tolist(), high.tolist(), strict=True)]
            if all(limit < self._settled(scores[p], int(a), k) or a > b for p, a, b in zip(inside, low, high, strict=True)):
                break
        found = []
        for place in inside:
            by = np.lexsort((ids[place], -scores[place]))[:k]
            found.append((place[by], scores[place[by]]))
        return found

    @staticmethod
    def _settled(scores: np.ndarray, low: int, k: int) -> int:
        """No row below this score can come into the window's first ``k``."""
        return max(low, int(np.partition(scores, len(scores) - k)[len(scores) - k])) if len(scores) >= k else low


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    matrix = np.zeros((len(vectors), width), dtype=np.int64)
    for i, vector in enumerate(vectors):
        matrix[i, : len(vector)] = vector
    return matrix


def _block(width: int, lists: bool):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", ignore_index=True)
        matrix = _matrix(rows["vector"], width)
        order = Lists(matrix).order.astype("<i4").tobytes() if lists else b""
        return pd.DataFrame(
            {
                "block": [rows["block"].iloc[0]], "ids": [rows["id"].to_numpy("<i8").tobytes()],
                "labels": [rows["label"].to_numpy("<i8").tobytes()], "vectors": [matrix.astype("<i8").tobytes()], "order": [order],
            }
        )

    return pack


BLOCK_SCHEMA = "block bigint, ids binary, labels binary, vectors binary, order binary"
FOUND = "id bigint, positive_id bigint, positive_score bigint, other bigint, score bigint"


def _block_of(blocks: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(blocks))


def _blocks(rows: DataFrame, blocks: int, width: int, lists: bool) -> DataFrame:
    return rows.withColumn("block", _block_of(blocks)).groupBy("block").applyInPandas(_block(width, lists), BLOCK_SCHEMA)


def _unpacked(row: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], dtype="<i8")
    return ids, np.frombuffer(row["labels"], dtype="<i8"), np.frombuffer(row["vectors"], dtype="<i8").reshape(len(ids), width)


def _search(width: int, k: int, share: tuple[int, int] | None):
    """The best rows of a block for each anchor of another: of its label, or of other labels in the ranges of its positives."""

    def search(candidates: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({c: pd.array([], dtype="Int64") for c in ("id", "positive_id", "positive_score", "other", "score")})]
        if candidates.empty or anchors.empty:
            return found[0]
        ids, labels, vectors = _unpacked(candidates.iloc[0], width)
        own_ids, own_labels, own = _unpacked(anchors.iloc[0], width)
        if width * int(np.abs(vectors).max()) * int(np.abs(own).max()) >= -NONE:
            raise ValueError("the components are too large for 64-bit scores")
        lists = Lists(vectors, np.frombuffer(candidates["order"].iloc[0], dtype="<i4").reshape(width, len(ids)))
        thresholds = lists.thresholds(own)
        # Per window: the anchor, its positive and the positive's score.
        windows = np.array([[i, 0, 0] for i in own_ids] if share is None else list(anchors["windows"].iloc[0]), dtype=np.int64)
        windows = windows.reshape(-1, 3)[np.argsort(windows.reshape(-1, 3)[:, 0], kind="stable")]
        for i, (a, b) in enumerate(zip(np.searchsorted(windows[:, 0], own_ids), np.searchsorted(windows[:, 0], own_ids, "right"), strict=True)):
            if share is None:
                fit, low, high = (labels == own_labels[i]) & (ids != own_ids[i]), np.array([NONE]), np.array([-NONE])
            else:
                fit, low, high = labels != own_labels[i], -(-windows[a:b, 2] * share[0] // 100), windows[a:b, 2] * share[1] // 100
            real = np.flatnonzero(low <= high)
            if len(real):
                best = lists.best(own[i], thresholds[i], fit, ids, low[real], high[real], k)
                for (_, positive, score), (place, scores) in zip(windows[a + real].tolist(), best, strict=True):
                    found.append(
                        pd.DataFrame(
                            {"id": own_ids[i], "positive_id": positive, "positive_score": score, "other": ids[place], "score": scores}
                        )
                    )
        return pd.concat(found, ignore_index=True)

    return search


def hard_negatives(
    rows: DataFrame, anchors: Column, vector: str = "vector", label: str = "label", key: str = "id",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    block: int = ROWS, anchor_block: int = ANCHORS,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``vector`` is an array of integers; ``anchors`` says which rows are anchors; ``low`` and ``high`` bound a
    negative's score, in hundredths of the positive's.
    """
    wanted = rows.select(
        ref(key).cast("long").alias("id"), ref(label).cast("long").alias("label"), ref(vector).cast("array<bigint>").alias("vector"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"),
    ).filter("id is not null and label is not null and vector is not null and forall(vector, x -> x is not null)")
    wanted = staged(wanted.groupBy("id").agg(F.min(F.struct("label", "vector", "anchor")).alias("_row")).select("id", "_row.*"))
    count, chosen, width = wanted.agg(
        F.count(F.lit(1)), F.count_if("anchor"), F.coalesce(F.max(F.size("vector")), F.lit(1))
    ).first()
    width = max(1, width)
    groups, anchor_groups = max(1, math.ceil(count / block)), max(1, math.ceil(chosen / anchor_block))
    candidates = staged(_blocks(wanted, groups, width, True))
    own = staged(_blocks(wanted.filter("anchor"), anchor_groups, width, False))

    def each(number: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(number - 1)).cast("array<bigint>"))

    def met(asking: DataFrame, k: int, share: tuple[int, int] | None) -> DataFrame:
        left = candidates.withColumn("ask", each(anchor_groups))
        right = asking.withColumnRenamed("block", "ask").withColumn("block", each(groups))
        return left.groupBy("block", "ask").cogroup(right.groupBy("block", "ask")).applyInPandas(_search(width, k, share), FOUND)

    def first(found: DataFrame, k: int, *by: str) -> DataFrame:
        ordered = Window.partitionBy(*by).orderBy(F.desc("score"), "other")
        return found.withColumn("rank", F.row_number().over(ordered)).filter(F.col("rank") <= k)

    best = first(met(own, positives, None), positives, "id")
    # The anchors of a block have a bounded number of windows together.
    windows = best.groupBy(_block_of(anchor_groups).alias("block")).agg(F.collect_list(F.array("id", "other", "score")).alias("windows"))
    found = first(met(own.join(windows, "block"), negatives, (low, high)), negatives, "id", "positive_id")
    return found.select(
        F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )
