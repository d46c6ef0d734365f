"""Token counts: how many pieces greedy longest matching makes of each text, without making them.

The vocabulary is a trie.  A node's failure link leads to where matching goes on when no child fits the next
byte, and its popped count tells how many pieces are complete by then; both come from its parent's in one
pass.  So a word is one walk over its bytes.  All words that a batch of texts has not counted yet are walked
together by numpy; counts are kept from batch to batch.

Defined cases: a null or empty text has no words and no tokens; a byte that the vocabulary lacks is a token of its own;
equal rows are counted each; texts of any length are read whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import ref
from tabloom.llm.tokens import PIECE, WORD_END

#: Words of any text; on Latin-1 text the same as PIECE.
ANY_PIECE = regex.compile(r"[\p{L}]+|'(?:s|t|re|ve|m|ll|d)|[\p{N}]|[^\s\p{L}\p{N}]+")
CACHED = 1_000_000


@dataclass
class Automaton:
    keys: np.ndarray  # node x 256 + byte of every edge, sorted
    child: np.ndarray
    fail: np.ndarray  # by node; the root fails to -1
    popped: np.ndarray  # pieces complete when a node fails
    rest: np.ndarray  # pieces of a node's own string, at the end of a word

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Pieces of each word."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        data = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        order = np.argsort(-lengths, kind="stable")
        total, state = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        for at in range(int(lengths.max(initial=0))):
            going = order[: np.searchsorted(-lengths[order], -at, side="left")]
            while len(going):
                key = state[going] * 256 + data[starts[going] + at]
                place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                fits = self.keys[place] == key
                state[going[fits]] = self.child[place[fits]]
                going = going[~fits]
                total[going] += self.popped[state[going]]
                state[going] = self.fail[state[going]]
        return total + self.rest[state]


def build(vocabulary: Iterable[bytes]) -> Automaton:
    """Trie, failure links and popped counts of a vocabulary, completed by all single bytes."""
    edges: list[dict[int, int]] = [{}]
    final = [False]
    for token in [*vocabulary, *(bytes([b]) for b in range(256))]:
        node = 0
        for byte in token:
            if byte not in edges[node]:
                edges[node][byte] = len(edges)
                edges.append({})
                final.append(False)
            node = edges[node][byte]
        final[node] = node != 0
    fail, popped, rest = [-1] * len(edges), [0] * len(edges), [0] * len(edges)
    level = [0]
    while level:
        below = []
        for parent in level:
            for byte, node in edges[parent].items():
                below.append(node)
                if final[node]:
                    fail[node], popped[node], rest[node] = 0, 1, 1
                    continue
                # What the parent's string leaves after its complete pieces is followed until the byte fits.
                count, at = popped[parent], fail[parent]
                while byte not in edges[at]:
                    count, at = count + popped[at], fail[at]
                fail[node], popped[node] = edges[at][byte], count
                rest[node] = count + rest[fail[node]]
        level = below
    pairs = sorted((node * 256 + byte, child) for node, own in enumerate(edges) for byte, child in own.items())
    keys, child = np.array(pairs, dtype=np.int64).T
    return Automaton(keys.copy(), child.copy(), *(np.array(x, dtype=np.int64) for x in (fail, popped, rest)))


def byte_alphabet() -> dict[str, int]:
    """The byte of each character in a byte-level vocabulary: itself if printable, else from 256 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def vocabulary_of(definition: str) -> list[bytes]:
    """The tokens of a byte-level tokenizer file as bytes, without marks of a word's end."""
    byte = byte_alphabet()
    tokens = {t.removesuffix(WORD_END) for t in json.loads(definition)["model"]["vocab"]}
    return sorted(bytes(byte[c] for c in t) for t in tokens if t and all(c in byte for c in t))


def words_of(text: str) -> list[str]:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return ANY_PIECE.findall(text.lower())
    return PIECE.findall(text.lower())




def count_texts(automaton: Automaton, texts: list[str], known: dict[str, int]) -> tuple[list[int], list[int]]:
    """Words and pieces of each text; ``known`` keeps counts of words."""
    cut = [words_of(t) for t in texts]
    new = set().union(*cut).difference(known)
    if len(known) + len(new) > CACHED:
        known.clear()
        new = set().union(*cut)
    if new:
        words = list(new)
        known.update(zip(words, automaton.counts([w.encode("utf-8", "surrogatepass") for w in words]).tolist(), strict=True))
    return [len(words) for words in cut], [sum(map(known.__getitem__, words)) for words in cut]


def count_tokens(docs: DataFrame, vocabulary: Iterable[bytes], text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: ``doc_id``, ``n_words``, ``n_tokens``."""
    sent = docs.sparkSession.sparkContext.broadcast(build(vocabulary))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for batch in batches:
            for low in range(0, len(batch), 500):
                rows = batch.iloc[low : low + 500]
                n_words, n_tokens = count_texts(sent.value, rows["text"].tolist(), known)
                yield pd.DataFrame({"doc_id": rows["doc_id"].array, "n_words": n_words, "n_tokens": n_tokens})

    wanted = docs.select(ref(key).cast("long").alias("doc_id"), F.coalesce(ref(text).cast("string"), F.lit("")).alias("text"))
    return wanted.mapInPandas(work, "doc_id bigint, n_words bigint, n_tokens bigint")
