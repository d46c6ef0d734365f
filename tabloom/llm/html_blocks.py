"""Leaf blocks of an HTML page in page order, and their features."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from html import unescape

import numpy as np

#: Fixed values of HTML: elements without end, elements inside a line of text, elements that a new block ends,
#: elements that may stand in head (all others end it), and elements whose content is no text of the page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
INLINE |= set("math semantics mrow mi mn mo ms mtext mspace mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup".split())
INLINE |= set("msubsup munder mover munderover mmultiscripts mprescripts none annotation annotation-xml".split())
ENDS_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
ENDS_PARAGRAPH = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SCOPE = set("article aside body div footer form header html main nav ol section table td th ul".split())
IN_HEAD = set("head html base basefont bgsound link meta noframes noscript script style template title".split())
#: The annotations of a formula are its source and not shown.
HIDDEN = set("head noscript template svg annotation annotation-xml select button datalist object audio video canvas".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|title|textarea|iframe|xmp|noembed|noframes)\b[^>]*+>.*?(?:</\1\s*+>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)/?>|<[!?/][^>]*+>",
    re.S | re.I,
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PART = re.compile(r"[a-z]+|[0-9]+")

PATH_BUCKETS = 1024
WORD_BUCKETS = 512
NUMBERS = 8


@dataclass
class Block:
    text: str
    path: tuple[int, ...]
    linked: int = 0  # characters inside links


@dataclass
class _Open:
    tag: str
    path: tuple[int, ...]


def bucket(word: str, size: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % size


_names: dict[str, tuple[int, ...]] = {}


def _named(tag: str, attributes: str) -> tuple[int, ...]:
    key = tag + attributes if len(attributes) < 200 and "=" in attributes else tag
    if key == tag:
        attributes = attributes if len(attributes) >= 200 else ""
    found = _names.get(key)
    if found is None or len(attributes) >= 200:
        parts = ["<" + tag]
        for match in NAMED.finditer(attributes):
            parts += ["." + p for p in PART.findall((match[1] or match[2] or match[3] or "").lower())]
        found = tuple(dict.fromkeys(bucket(p, PATH_BUCKETS) for p in parts))
        if len(attributes) < 200:
            if len(_names) > 50_000:
                _names.clear()
            _names[key] = found
    return found


def blocks_of(page: str) -> list[Block]:
    """The texts between block boundaries; references are decoded and white space is one space."""
    found: list[Block] = []
    stack: list[_Open] = []
    hidden = links = 0
    pieces: list[str] = []
    linked, started = 0, False
    path: tuple[int, ...] = ()

    def close() -> None:
        nonlocal linked, started
        if started:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                found.append(Block(text, path, min(linked, len(text))))
        pieces.clear()
        linked, started = 0, False

    def pop(upto: int) -> None:
        nonlocal hidden, links
        for one in stack[upto:]:
            hidden -= one.tag in HIDDEN
            links -= one.tag == "a"
        del stack[upto:]

    def innermost(tags: set[str], stop: set[str]) -> int | None:
        for at in range(len(stack) - 1, -1, -1):
            if stack[at].tag in tags:
                return at
            if stack[at].tag in stop:
                return None
        return None

    def end_head(tag: str) -> None:
        """Ends an open head before what may not stand in it; noscript and template in head may hold anything but a body."""
        if tag == "body" and (place := innermost({"head"}, {"template"})) is not None:
            pop(place)
        elif stack and stack[-1].tag == "head" and tag not in IN_HEAD:
            pop(len(stack) - 1)

    def add(text: str) -> None:
        nonlocal path, linked, started
        if hidden and text and not text.isspace():
            end_head("")
        if text and not hidden:
            pieces.append(text)
            if not text.isspace():
                if not started:
                    started, path = True, stack[-1].path if stack else ()
                if links:
                    linked += len(text.strip())

    at = 0
    for match in TOKEN.finditer(page):
        add(page[at : match.start()])
        at = match.end()
        tag = match[3]
        if tag is None:
            if match[1]:
                end_head(match[1].lower())
            continue
        tag = tag.lower()
        if tag not in INLINE:
            close()
        if match[2]:
            place = innermost({tag}, {"html"} if tag not in INLINE else SCOPE)
            if place is not None:
                pop(place)
            continue
        end_head(tag)
        if tag in ENDS_PARAGRAPH and (place := innermost({"p"}, SCOPE)) is not None:
            pop(place)
        if tag in ENDS_ITSELF and (place := innermost(ENDS_ITSELF[tag], SCOPE - {"td", "th"})) is not None:
            pop(place)
        if tag not in VOID and not (match[4] or "").endswith("/"):
            names = _named(tag, match[4] or "")
            above = stack[-1].path if stack else ()
            stack.append(_Open(tag, above + tuple(n for n in names if n not in above)))
            hidden += tag in HIDDEN
            links += tag == "a"
    add(page[at:])
    close()
    return found


def features(pages: list[list[Block]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Path buckets and word buckets of all blocks, each with the block they are of, and one row of numbers per block.

    Places are counted within the block's own page.
    """
    blocks = [b for page in pages for b in page]
    places = [(at, len(page)) for page in pages for at in range(len(page))]
    path, path_of, words, words_of = [], [], [], []
    numbers = np.zeros((len(blocks), NUMBERS), dtype=np.float32)
    for i, (block, (at, size)) in enumerate(zip(blocks, places, strict=True)):
        own = dict.fromkeys(block.path)
        path += own
        path_of += [i] * len(own)
        split = block.text.split()
        hashed = [bucket(w, WORD_BUCKETS) for w in dict.fromkeys(split)]
        words += hashed
        words_of += [i] * len(hashed)
        n, chars = len(split), len(block.text)
        numbers[i] = (
            np.log1p(n) / 5, block.linked / chars, chars / n / 10, block.text[-1] in ".!?", at / size, 1 / (1 + at),
            1 / (size - at), len(block.path) / 20,
        )
    as_index = lambda values: np.array(values, dtype=np.int64)
    return as_index(path), as_index(path_of), as_index(words), as_index(words_of), numbers
