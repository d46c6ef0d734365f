"""Main text of web pages by a recurrent labeller of their blocks.

A page is its leaf blocks in order.  A bidirectional LSTM sees each block's tag path, hashed words and a few
numbers and, through both directions, the whole page; it labels every block as main text or not.  Blocks of main text are
joined by one space.

It is trained on two bounded sources, both made from about ``SAMPLE`` different pages, by their hash: those of the pages
with main text by their markup, where ``article`` and ``main`` elements without their asides give the labels, and ``LAID_OUT`` layouts of the same
sentences with menus, headers, notices, adverts, sidebars, forms and reader comments in many kinds of
elements, whose labels are known.

Defined cases: a null or empty page, or one without text, gives an empty text; equal rows are labelled each; the labeller
reads pages of any length whole, both ways; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from html import escape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import ref
from tabloom.llm.block_labeller import BlockLabeller, batches_of
from tabloom.llm.common import hashed_sample
from tabloom.llm.html_blocks import PATH_BUCKETS, Block, blocks_of, bucket

SAMPLE = 200
#: Pages above this length are left out of the training sample only.
SAMPLE_CHARS = 200_000
LAID_OUT = 700

MAIN = {bucket(n, PATH_BUCKETS) for n in ("<article", "<main")}
ASIDE = {
    bucket(n, PATH_BUCKETS)
    for n in ("<nav", "<footer", "<aside", "<form", ".ad", ".ads", ".comments", ".comment", ".sidebar", ".cookie", ".notice", ".menu")
}

#: Elements of made-up layouts, as (tag, names), by what they hold.
CONTAINERS = {
    "article": (("article", ""), ("article", "post"), ("main", ""), ("main", "content"), ("div", "content"), ("div", "article-body"),
                ("div", "post"), ("div", "entry-content"), ("div", "story"), ("section", "main-text"), ("div", "text"), ("td", "body"), ("div", "")),
    "menu": (("nav", ""), ("nav", "menu"), ("ul", "menu"), ("div", "nav"), ("div", "navbar"), ("div", "breadcrumb"), ("div", "topnav"), ("ul", "links"), ("div", "")),
    "header": (("header", ""), ("header", "site-header"), ("div", "header"), ("div", "masthead"), ("div", "top"), ("div", "banner"), ("div", "logo")),
    "footer": (("footer", ""), ("footer", "site-footer"), ("div", "footer"), ("div", "copyright"), ("div", "bottom"), ("p", "legal"), ("div", "")),
    "sidebar": (("aside", ""), ("aside", "sidebar"), ("div", "sidebar"), ("div", "widget"), ("div", "related"), ("div", "right-column"), ("section", "recommended"), ("td", "side")),
    "notice": (("div", "cookie"), ("div", "cookie-banner"), ("div", "notice"), ("p", "notice"), ("div", "alert"), ("div", "consent"), ("div", "gdpr"), ("section", "warning"), ("div", "popup"), ("div", "newsletter")),
    "advert": (("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "sponsored"), ("ins", "adsbygoogle"), ("div", "promo"), ("p", "ad"), ("aside", "advertisement"), ("section", "ad")),
    "form": (("form", ""), ("form", "search"), ("form", "login"), ("form", "subscribe"), ("div", "signup"), ("form", "contact")),
    "comments": (("section", "comments"), ("div", "comments"), ("ol", "commentlist"), ("div", "responses"), ("ul", "comment-list"), ("div", "discussion"), ("section", "replies")),
}
MENU_WORDS = "Home About Contact News Login Register Search Help Blog Products Services Archive Sitemap Privacy Terms Support Careers Menu FAQ Shop Topics".split()
NOTICE_WORDS = (
    "We use cookies to improve your experience.", "Accept all cookies", "By continuing you agree to our privacy policy.", "Subscribe to our newsletter!",
    "This site requires a browser with scripts.", "Please sign in to continue.", "Please disable your ad blocker.",
)
FOOTER_WORDS = ("© 2024 All rights reserved.", "Copyright", "Terms of use", "Privacy policy", "Powered by", "Contact us", "Follow us")
ADVERT_WORDS = ("Advertisement", "Sponsored", "Buy now!", "Special offer", "Shop now", "50% off today only!")
COMMENT_WORDS = ("Reply", "Comments", "says:", "wrote:", "2 hours ago", "Leave a reply", "Report", "Like")
SIDE_WORDS = ("Related articles", "Most read", "Recent posts", "Popular", "See also", "Categories", "Trending now", "Share", "Tags")
FORM_WORDS = ("Name", "Email", "Password", "Your message", "Search", "Send", "Remember me", "Sign up")


def labels_by_markup(blocks: list[Block]) -> list[int]:
    return [int(bool(MAIN.intersection(b.path)) and not ASIDE.intersection(b.path)) for b in blocks]


class _Layout:
    """One made-up page and the labels of its blocks."""

    def __init__(self, rng: np.random.Generator, sentences: list[str]):
        self.rng, self.sentences = rng, sentences
        self.html: list[str] = []
        self.labels: list[int] = []
        self.style = self.pick(("plain",) * 6 + ("words", "sentence", "capitals", "marks"))

    def styled(self, text: str) -> str:
        """Junk comes in articles too: words or sentences many times over, capitals, marks."""
        words = text.split()
        if self.style == "words":
            return " ".join(w for w in words[:12] for _ in range(int(self.rng.integers(2, 30))))
        if self.style == "sentence":
            return self.sentences[0] if self.chance(0.5) else " ".join([text] * int(self.rng.integers(2, 5)))
        if self.style == "capitals":
            return "!! ".join(words).upper()
        if self.style == "marks":
            return " ".join(w + self.pick(("$$$", "%%%", "&&&", "###", " |")) for w in words)
        return text

    def pick(self, options):
        return options[int(self.rng.integers(len(options)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def prose(self, least: int, most: int) -> str:
        return " ".join(self.pick(self.sentences) for _ in range(int(self.rng.integers(least, most + 1))))

    def short(self, least: int = 1, most: int = 3) -> str:
        words = self.pick(self.sentences).split()
        return " ".join(words[: int(self.rng.integers(least, most + 1))])

    def put(self, tag: str, text: str, label: int, linked: bool = False) -> None:
        inside = escape(text)
        if linked:
            inside = f'<a href="/{len(self.html)}">{inside}</a>'
        elif label and self.chance(0.15):
            words = inside.split(" ")
            words[0] = self.pick(("<b>{}</b>", "<a href='/x'>{}</a>", "<em>{}</em>")).format(words[0])
            inside = " ".join(words)
        self.html.append(f"<{tag}>{inside}</{tag}>")
        self.labels.append(label)

    def opened(self, kind: str) -> str:
        tag, names = self.pick(CONTAINERS[kind])
        if self.chance(0.12):  # names that tell nothing
            names = f"x{int(self.rng.integers(1000))}"
        self.html.append(f'<{tag} {self.pick(("class", "id"))}="{names}">' if names else f"<{tag}>")
        return tag

    def article(self) -> None:
        tag = self.opened("article")
        if self.chance(0.8):
            self.put("h1", self.styled(self.prose(1, 1)), 1)
        if self.chance(0.2):
            self.put("p", self.prose(1, 1), 1)
        loose = self.chance(0.1)
        for _ in range(int(self.rng.integers(1, 14))):
            draw = self.rng.random()
            if draw < 0.08:
                self.put(self.pick(("h2", "h3")), self.short(2, 6), 1)
            elif draw < 0.14:
                self.html.append("<ul>")
                for _ in range(int(self.rng.integers(2, 5))):
                    self.put("li", self.prose(1, 1), 1)
                self.html.append("</ul>")
            elif draw < 0.18:
                self.put("blockquote", self.prose(1, 2), 1)
            elif draw < 0.23:
                self.boilerplate(self.pick(("advert", "sidebar", "notice", "form")))
            elif loose or draw < 0.27:
                self.html.append(f"<br>{escape(self.prose(1, 3))}<br>")
                self.labels.append(1)
            elif draw < 0.33:
                self.put("p", self.short(1, 4) + ".", 1)
            else:
                for _ in range(int(self.rng.integers(3, 25)) if self.style == "sentence" else 1):
                    self.put("p", self.styled(self.prose(1, 7)), 1)
        if self.chance(0.1):
            self.boilerplate("comments")
        self.html.append(f"</{tag}>")

    def boilerplate(self, kind: str) -> None:
        tag = self.opened(kind)
        if kind == "menu":
            item = self.pick(("li", "span", "div"))
            item = "li" if tag == "ul" else item
            for _ in range(int(self.rng.integers(2, 9))):
                text = self.pick(MENU_WORDS) if self.chance(0.4) else self.short(1, 2)
                self.put(item if item != "span" else "div", text, 0, self.chance(0.9))
        elif kind == "comments":
            item = "li" if tag in ("ol", "ul") else "div class='comment'" if self.chance(0.6) else "div"
            if self.chance(0.7):
                self.put("h3", self.pick(("Comments", "3 comments", "Discussion", "Responses")), 0)
            for _ in range(int(self.rng.integers(1, 6))):
                self.html.append(f"<{item}>")
                if self.chance(0.6):
                    self.put("p", f"{self.short(1, 2)} {self.pick(COMMENT_WORDS)}", 0)
                self.put("p", self.prose(1, 3), 0)
                if self.chance(0.3):
                    self.put("div", "Reply", 0, True)
                self.html.append(f"</{item.split()[0]}>")
        else:
            words = {"notice": NOTICE_WORDS, "footer": FOOTER_WORDS, "advert": ADVERT_WORDS, "sidebar": SIDE_WORDS, "form": FORM_WORDS, "header": MENU_WORDS}[kind]
            if self.chance(0.25) and kind not in ("form", "sidebar"):  # text without an element of its own
                self.html.append(escape(self.pick(words) if self.chance(0.3) else self.prose(1, 2)))
                self.labels.append(0)
            else:
                if kind == "sidebar" and self.chance(0.6):
                    self.put(self.pick(("h3", "h2", "h4")), self.pick(words), 0)
                for _ in range(int(self.rng.integers(1, 5 if kind == "sidebar" else 3))):
                    text = self.pick(words) if self.chance(0.4) else self.prose(1, 2) if self.chance(0.6) else self.short(1, 6)
                    self.put("label" if kind == "form" else self.pick(("p", "div", "li" if kind == "sidebar" else "p")), text, 0, kind == "sidebar" and self.chance(0.5))
        self.html.append(f"</{tag}>")

    def page(self) -> tuple[str, list[int]]:
        wrapped = self.chance(0.5)
        if wrapped:
            self.html.append(f'<div class="{self.pick(("wrapper", "container", "page", "row"))}">')
        before = [k for k, p in (("header", 0.5), ("menu", 0.8), ("notice", 0.3), ("advert", 0.5), ("form", 0.15), ("sidebar", 0.2)) if self.chance(p)]
        self.rng.shuffle(before)
        after = [k for k, p in (("comments", 0.4), ("sidebar", 0.4), ("form", 0.2), ("advert", 0.3), ("notice", 0.2), ("menu", 0.15)) if self.chance(p)]
        for kind in before:
            self.boilerplate(kind)
        self.article()
        for kind in after:
            self.boilerplate(kind)
        if self.chance(0.85):
            self.boilerplate("footer")
        if wrapped:
            self.html.append("</div>")
        return "<html><body>" + "".join(self.html) + "</body></html>", self.labels


def train(pages: DataFrame, html: str = "html", sample: int = SAMPLE, laid_out: int = LAID_OUT, seed: int = 7) -> BlockLabeller:
    body = F.coalesce(ref(html).cast("string"), F.lit("")).alias("html")
    chosen = hashed_sample(pages.select(body).filter(F.length("html").between(1, SAMPLE_CHARS)), "html", sample)
    sampled = [b for page in sorted(r.html for r in chosen.collect()) if (b := blocks_of(page))]
    # A page without such elements says nothing about where its main text is; only its sentences are used.
    own = [b for b in sampled if any(labels_by_markup(b))]
    labels = [labels_by_markup(b) for b in own]
    sentences = sorted({s.strip() + "." for blocks in sampled for b in blocks for s in b.text.split(".") if 2 < len(s.split()) < 60})
    rng = np.random.default_rng(seed)
    for _ in range(laid_out if sentences else 0):
        text, wanted = _Layout(rng, sentences).page()
        blocks = blocks_of(text)
        if len(blocks) == len(wanted):
            own.append(blocks)
            labels.append(wanted)
    model = BlockLabeller(seed)
    if own:
        model.fit(own, labels, seed=seed)
    return model


def main_texts(model: BlockLabeller, pages: list[str]) -> list[str]:
    cut = [blocks_of(p) for p in pages]
    order = sorted((i for i, blocks in enumerate(cut) if blocks), key=lambda i: len(cut[i]))
    texts = [""] * len(cut)
    for part in batches_of([len(cut[i]) for i in order]):
        some = [order[k] for k in part]
        for i, chances in zip(some, model.chances([cut[i] for i in some]), strict=True):
            texts[i] = " ".join(b.text for b, c in zip(cut[i], chances, strict=True) if c >= 0.5)
    return texts


def extract_text(pages: DataFrame, html: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per input row: ``page_id``, ``url``, ``text``, ``n_chars``."""
    sent = pages.sparkSession.sparkContext.broadcast(train(pages, html))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), 500):
                rows = batch.iloc[low : low + 500]
                texts = main_texts(sent.value, rows["html"].tolist())
                yield pd.DataFrame(
                    {"page_id": rows["page_id"].array, "url": rows["url"].array, "text": texts, "n_chars": [len(t) for t in texts]}
                )

    wanted = pages.select(
        ref(key).cast("long").alias("page_id"), ref(url).cast("string").alias("url"), F.coalesce(ref(html).cast("string"), F.lit("")).alias("html")
    )
    return wanted.mapInPandas(work, "page_id bigint, url string, text string, n_chars bigint")
