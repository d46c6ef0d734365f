"""Hashes of words and of word shingles, by numpy over many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)
#: Bytes of text worked on at a time, unless one text is longer.
CHUNK = 1 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``h``."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < size:
        made = []
        for base in (_BASE, _BACK):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            made.append(np.cumprod(table, dtype=np.uint64))
        _powers = made[0], made[1]
    return _powers


def chunks(texts: list[bytes], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes."""
    low, size = 0, 0
    for at, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield low, at
            low, size = at, 0
        size += len(text) + 1
    if low < len(texts):
        yield low, len(texts)


def word_hashes(texts: list[bytes], separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, and where each text's words begin (one more entry than texts)."""
    data = np.frombuffer(b" ".join([b"", *texts, b""]), dtype=np.uint8)
    lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    gap = separators[data]
    starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    stops = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    powers, back = _power_tables(len(data) + 1)
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    hashes = mixed((sums[stops] - sums[starts]) * back[starts] + (stops - starts).astype(np.uint64))
    bounds = np.searchsorted(starts, np.concatenate([[0], 1 + np.cumsum(lengths)]))
    return hashes, bounds


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words, by the position of its first."""
    if len(hashes) < width:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(len(hashes) - width + 1, dtype=np.uint64)
    for i in range(width):
        total = total * _BASE + hashes[i : i + len(total)]
    return mixed(total)


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text; fewer words than ``width`` make one, no words none."""
    for low, high in chunks(texts):
        hashes, bounds = word_hashes(texts[low:high])
        windows = window_hashes(hashes, width)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(windows[a : b - width + 1])
            elif b > a:
                yield window_hashes(hashes[a:b], b - a) + np.uint64(b - a)
            else:
                yield hashes[:0]
