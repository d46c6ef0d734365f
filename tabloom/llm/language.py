"""Language of documents by a string kernel with landmarks and kernel ridge regression.

A text is the set of its byte n-grams of 1 to 4 bytes, lower-cased; the kernel of two texts is the number of
n-grams they share, over the geometric mean of their own numbers, on the n-grams of the landmarks
(a blended spectrum of presence).  Landmarks are training texts; the kernels of a text with them, whitened by the
landmarks' own kernel matrix, are its Nystroem features.  One ridge regression per language against the
rest is solved in closed form on the training texts, which are at most about ``PER_LANGUAGE`` of each language, chosen by a hash
of the text among all rows that may be learned from.  Scoring is two matrix products per batch of texts.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without any row to learn from every
text is ``und``; rows of null language are not learned from; equal rows are scored each; texts of any length are read
whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import ref
from tabloom.llm.shingles import chunks

ORDERS = (1, 2, 3, 4)
PER_LANGUAGE = 250
LANDMARKS_PER_LANGUAGE = 60
RIDGE = 1e-2
#: n-grams are numbered by a hash of this many bits.
HASH_BITS = 20
UNKNOWN = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    column: np.ndarray  # of each hashed n-gram among those of the landmarks, -1 for the others
    landmarks: np.ndarray  # n-grams x landmarks, 0 or 1, over the root of the landmark's number
    weights: np.ndarray  # landmarks x languages


def _coded(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: hashed n-grams, and the number of the text each is from."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.uint64)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    code = np.zeros(len(data), dtype=np.uint64)
    for order in ORDERS:
        if len(data) < order:
            return
        code = code[: len(data) - order + 1] * np.uint64(257) + data[order - 1 :] + np.uint64(1)
        hashed = (code * np.uint64(0x9E3779B97F4A7C15 | 1)) >> np.uint64(64 - HASH_BITS)
        inside = owner[: len(code)] == owner[order - 1 :]
        yield hashed[inside].astype(np.int64), owner[: len(code)][inside]


def _lowered(texts: list[str]) -> list[bytes]:
    return [t.lower().encode("utf-8", "surrogatepass") for t in texts]


def _presence(texts: list[bytes], column: np.ndarray, size: int) -> np.ndarray:
    found = np.zeros((len(texts), size), dtype=np.float32)
    for hashed, owner in _coded(texts):
        at = column[hashed]
        known = at >= 0
        found[owner[known], at[known]] = 1.0
    return found


def _kernel(texts: list[bytes], column: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    present = _presence(texts, column, len(landmarks))
    own = np.sqrt(np.maximum(present.sum(axis=1, keepdims=True), 1.0))
    return (present @ landmarks) / own


def fit(texts: list[str], languages: list[str]) -> LanguageModel | None:
    """Fit on labelled texts in the given order; the first of each language are its landmarks."""
    if not texts:
        return None
    names = sorted(set(languages))
    coded = _lowered(texts)
    rank = pd.Series(languages).groupby(languages).cumcount().to_numpy()
    marks = [t for t, r in zip(coded, rank, strict=True) if r < LANDMARKS_PER_LANGUAGE]
    column = np.full(1 << HASH_BITS, -1, dtype=np.int32)
    used = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *[h for h, _ in _coded(marks)]]))
    column[used] = np.arange(len(used), dtype=np.int32)
    landmarks = _presence(marks, column, len(used)).T
    landmarks /= np.sqrt(np.maximum(landmarks.sum(axis=0, keepdims=True), 1.0))
    values, vectors = np.linalg.eigh((landmarks.T @ landmarks).astype(np.float64))
    whole = values > 1e-6 * max(values.max(), 1e-12)
    whiten = vectors[:, whole] / np.sqrt(values[whole])
    kernels = np.concatenate([_kernel(coded[i : i + 64], column, landmarks) for i in range(0, len(coded), 64)])
    features = kernels.astype(np.float64) @ whiten
    wanted = np.where(np.array(languages)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    solved = np.linalg.solve(features.T @ features + RIDGE * len(texts) * np.eye(features.shape[1]), features.T @ wanted)
    return LanguageModel(names, column, np.ascontiguousarray(landmarks), (whiten @ solved).astype(np.float32))


def predict(model: LanguageModel | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    lettered = [i for i, t in enumerate(texts) if isinstance(t, str) and any(map(str.isalpha, t))]
    if model is None:
        return names, scores
    coded = _lowered([texts[i] for i in lettered])
    for low, high in chunks(coded, 1 << 20):
        for a in range(low, high, 128):
            b = min(a + 128, high)
            margins = _kernel(coded[a:b], model.column, model.landmarks) @ model.weights
            likely = np.exp(4.0 * (margins - margins.max(axis=1, keepdims=True)))
            likely /= likely.sum(axis=1, keepdims=True)
            for i, best, row in zip(lettered[a:b], margins.argmax(axis=1).tolist(), likely, strict=True):
                names[i], scores[i] = model.languages[best], float(row[best])
    return names, scores


def held_out(key: Column) -> Column:
    """True for the rows whose id's checksum leaves 2 of 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE) -> LanguageModel | None:
    """Fit on a share of each language's rows, by their hash, so that about ``per_language`` come to the driver."""
    rows = docs.select(ref(text).cast("string").alias("text"), ref(lang).cast("string").alias("lang"), ref(key).alias("key"))
    rows = rows.filter(~held_out(F.col("key")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # One row per language: the model keeps as many columns, so their number is bounded by what it can hold.
    counts = docs.sparkSession.createDataFrame(rows.groupBy("lang").count().collect(), "lang string, count bigint")
    place = F.pmod(F.xxhash64("key", "text"), F.lit(1_000_000_007)) / 1_000_000_007
    chosen = rows.join(F.broadcast(counts), "lang").filter(place * F.col("count") < per_language).select("lang", "text", place.alias("place"))
    found = sorted((r.place, r.lang, r.text) for r in chosen.collect())
    return fit([f[2] for f in found], [f[1] for f in found])


def identify_languages(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """One row per input row: ``doc_id``, ``held_out``, ``lang_pred``, ``score`` (the softmax of the margins)."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, text, lang, key))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), 2000):
                rows = batch.iloc[low : low + 2000]
                names, scores = predict(sent.value, rows["text"].tolist())
                yield pd.DataFrame(
                    {"doc_id": rows["doc_id"].array, "held_out": rows["held_out"].array, "lang_pred": names, "score": scores}
                )

    wanted = docs.select(
        ref(key).cast("long").alias("doc_id"), held_out(ref(key)).alias("held_out"), ref(text).cast("string").alias("text")
    )
    return wanted.mapInPandas(work, "doc_id bigint, held_out boolean, lang_pred string, score double")
