"""Token ids of whole texts by a given tokenizer file, with a cache that keeps results exact.

The tokenizer lower-cases a text and cuts it into pieces whose ids do not depend on
what stands around them.  Latin-1 text is cut here in the same way and only pieces
not seen before reach the tokenizer; any other text goes to it word by word, which is
right because it drops white space.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
from tokenizers import Tokenizer

#: How the tokenizer file cuts lower-cased text into pieces, for Latin-1 characters.
LETTER = "a-zªµºß-öø-ÿ"
NUMBER = "0-9²³¹¼½¾"
SPACE = r"\t-\r \x85\xa0"
PIECE = re.compile(rf"[{LETTER}]+|'(?:s|t|re|ve|m|ll|d)|[{NUMBER}]|[^{LETTER}{NUMBER}{SPACE}]+")
WORD_END = "</w>"
#: Pieces kept, and texts whose new pieces are learnt together.
CACHED = 1_500_000
TOGETHER = 16


class PieceCache:
    """``batch(texts)`` gives each text's ids as packed little-endian unsigned 32-bit numbers."""

    def __init__(self, definition: str, cached: int = CACHED):
        self.tokenizer = Tokenizer.from_str(definition)
        self.cached = cached
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, number in vocabulary.items():
            self.ends[number] = token.endswith(WORD_END)
        self.known: dict[str, bytes] = {}

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces in one call; each of them ends with its only word-final token."""
        ids = self._encode(" ".join(pieces))
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) == len(pieces):
            packed, stops = ids.tobytes(), (4 * stops).tolist()
            self.known.update(zip(pieces, [packed[a:b] for a, b in zip([0, *stops], stops)], strict=True))
        else:
            self.known.update((piece, self._encode(piece).tobytes()) for piece in pieces)

    def _cut(self, text: str) -> list[str]:
        # Latin-1 text is its own normal form; the marks of special tokens need the tokenizer itself.
        if "<|" not in text and _is_latin_1(text):
            return PIECE.findall(text.lower())
        return text.encode("utf-8", "replace").decode().translate(_SPACES).split(" ")

    def batch(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text; the new pieces of some texts together reach the tokenizer in one call."""
        for low in range(0, len(texts), TOGETHER):
            cut = [self._cut(text) for text in texts[low : low + TOGETHER]]
            new = set(chain.from_iterable(cut)).difference(self.known)
            if len(self.known) + len(new) > self.cached:
                self.known.clear()
                new = set(chain.from_iterable(cut))
            if new:
                self._learn(list(new))
            for pieces in cut:
                yield b"".join(map(self.known.__getitem__, pieces))


def _is_latin_1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_SPACES = str.maketrans(dict.fromkeys("\t\n\r\f\v", " "))


@functools.lru_cache(maxsize=1)
def shared_cache(definition: str) -> PieceCache:
    """The cache of this Python worker, kept from task to task."""
    return PieceCache(definition)
