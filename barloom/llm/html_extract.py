"""Main text of web pages: boosted trees score the DOM's nodes, a tree-wise decoding picks consistent ones."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosted_trees import Forest, fit
from .html_dom import TAGS, Page, features, parse

#: Pages of the generated training sample, its seed; pages and characters that are scored at a time (a longer page by itself).
TRAINING_PAGES, SEED, AT_ONCE, CHARS_AT_ONCE = 400, 7, 200, 2_000_000


def decode(page: Page, keep: np.ndarray) -> list[str]:
    """Text blocks of the most likely consistent choice of nodes, in page order.

    ``keep`` is each node's probability of belonging to the main text or
    holding some.  A node that is left out takes its whole subtree with it, and
    an element that is chosen must have a chosen child; among such choices the
    likeliest is found exactly, from the leaves up.
    """
    n = len(page.parent)
    p = np.clip(keep, 1e-6, 1 - 1e-6)
    into, out = np.log(p).tolist(), np.log(1 - p).tolist()
    taken = [0.0] * n  # best gain over leaving everything below out, with at least one chosen child
    forced = [-1e18] * n  # least loss by which a child would have to be forced in
    best = [0.0] * n
    nothing = out[:]  # score of leaving out the whole subtree
    for i in range(n - 1, -1, -1):
        leaf = page.text[i] is not None
        below = 0.0 if leaf else (taken[i] if taken[i] > 0 else forced[i])
        # gain of choosing i over leaving its subtree out
        best[i] = into[i] - out[i] + below
        parent = page.parent[i]
        if parent >= 0:
            if best[i] > 0:
                taken[parent] += best[i]
            forced[parent] = max(forced[parent], best[i])
            nothing[parent] += nothing[i]
    chosen = [False] * n
    chosen[0] = best[0] > 0
    blocks = []
    for i in range(1, n):
        parent = page.parent[i]
        if chosen[parent]:
            chosen[i] = best[i] > 0 or (taken[parent] <= 0 and best[i] == forced[parent])
            if chosen[i] and page.text[i] is not None:
                blocks.append(page.text[i])
    return blocks


class _Writer:
    """Random pages with known main text, for training: wrappers, names and boilerplate vary, texts are random syllables."""

    SYLLABLES = "an be ci do er fa gu ho in jo ka lu men no or pa qua ri so ta un ver wi xo ye zu tion ment".split()

    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.out: list[str] = []
        self.main: list[str] = []

    def pick(self, *options):
        return options[self.rng.randrange(len(options))]

    def maybe(self, chance: float) -> bool:
        return self.rng.random() < chance

    def words(self, low: int, high: int) -> str:
        n = int(math.exp(self.rng.uniform(math.log(low), math.log(high))))
        out = ["".join(self.rng.choices(self.SYLLABLES, k=self.rng.randrange(1, 4))) for _ in range(max(n, 1))]
        for i in range(len(out)):
            if self.maybe(0.12) or i == len(out) - 1:
                out[i] += self.pick(".", ".", ",") if i < len(out) - 1 else self.pick(".", "", ".")
        return " ".join(out).capitalize()

    def attr(self, *names: str) -> str:
        if self.maybe(0.15):
            return ""
        name = self.pick(*names) + self.pick("", "", "-1", " wide", "-box", "-area")
        return f' {self.pick("class", "class", "id")}="{name}"'

    def text(self, low: int, high: int, main: bool) -> str:
        t = self.words(low, high)
        if main:
            self.main.append(t)
        return t.replace(" ", " <b>", 1) + self.pick("</b>", "<br>") if self.maybe(0.1) and " " in t else t

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{i}">{self.words(1, 4)}</a></li>' for i in range(n))

    def boilerplate(self, kind: str) -> None:
        r, w = self.rng, self.out
        if kind == "nav":
            tag = self.pick("nav", "nav", "div")
            body = f"<ul{self.attr('menu', 'links')}>{self.links(r.randrange(2, 9))}</ul>"
            if self.maybe(0.3):
                body = " ".join(f'<a href="/{i}">{self.words(1, 3)}</a>' for i in range(r.randrange(2, 8)))
            w.append(f"<{tag}{self.attr('nav', 'menu', 'navbar', 'breadcrumb', 'pagination') if tag == 'nav' else ' class="' + self.pick('nav', 'menu', 'navigation') + '"'}>{body}</{tag}>")
        elif kind == "header":
            tag = self.pick("header", "header", "div")
            name = self.attr("header", "masthead", "topbar") if tag == "header" else ' class="' + self.pick("header", "masthead", "site-header") + '"'
            w.append(f"<{tag}{name}>{self.pick('<h1>', '<div>', '<p>')}{self.words(1, 12)}{self.pick('', '<span>' + self.words(2, 12) + '</span>')}</{tag}>")
        elif kind == "footer":
            tag = self.pick("footer", "footer", "div")
            name = self.attr("footer", "bottom", "legal") if tag == "footer" else ' class="' + self.pick("footer", "copyright", "site-footer") + '"'
            w.append(f"<{tag}{name}>{self.pick('', '<p>')}&copy; {self.words(1, 40)}{self.pick('', '<p>' + self.words(2, 60))}</{tag}>")
        elif kind == "side":
            tag = self.pick("aside", "aside", "div", "section")
            name = self.attr("sidebar", "related", "widget") if tag == "aside" else ' class="' + self.pick("sidebar", "related", "widget", "recommended", "popular") + '"'
            w.append(f"<{tag}{name}><h3>{self.words(1, 4)}</h3>" + self.pick(f"<ul>{self.links(r.randrange(2, 7))}</ul>", f"<p>{self.words(5, 60)}</p>") + f"</{tag}>")
        elif kind == "advert":
            tag = self.pick("div", "div", "section", "aside", "p")
            name = self.pick("ad", "ads", "advert", "sponsored", "promo", "banner", "ad-slot")
            body = self.words(2, 40) if tag == "p" or self.maybe(0.6) else f"<p>{self.words(3, 50)}</p>"
            w.append(f'{self.pick("", "<!-- ad -->")}<{tag} class="{name}">{body}</{tag}>')
        elif kind == "notice":
            w.append(f'<div class="{self.pick("cookie-notice", "consent", "notice", "alert", "popup", "modal")}"><p>{self.words(4, 40)}</p>{self.pick("", "<button>" + self.words(1, 2) + "</button>")}</div>')
        elif kind == "form":
            w.append(f'<form{self.attr("newsletter", "search", "login", "subscribe")}><label>{self.words(1, 6)}</label><input name="x"><p>{self.words(2, 25)}</p><button>{self.words(1, 2)}</button></form>')
        elif kind == "share":
            w.append(f'<div class="{self.pick("share", "social", "tags", "sharing")}">{" ".join(f"<a href=#>{self.words(1, 2)}</a>" for _ in range(r.randrange(2, 5)))}</div>')
        elif kind == "comments":
            tag = self.pick("section", "div", "ol", "div")
            inner = "".join(
                f'<{"li" if tag == "ol" else "div"} class="{self.pick("comment", "reply", "comment-body")}"><p>{self.words(3, 80)}</p></{"li" if tag == "ol" else "div"}>'
                for _ in range(r.randrange(1, 6))
            )
            w.append(f'<{tag} {self.pick("id", "class")}="{self.pick("comments", "replies", "discussion", "respond", "reader-comments")}">{self.pick("", "<h3>" + self.words(1, 3) + "</h3>")}{inner}</{tag}>')

    def article(self) -> None:
        w, r = self.out, self.rng
        tag = self.pick("article", "article", "article", "main", "div")
        name = self.attr("post", "entry", "story", "content") if tag != "div" else ' class="' + self.pick("content", "post-body", "entry-content", "article", "story") + '"'
        w.append(f"<{tag}{name}>")
        if self.maybe(0.85):
            h = self.pick("h1", "h1", "h2")
            w.append(f"<{h}>{self.text(1, 14, True)}</{h}>")
        if self.maybe(0.2):
            self.boilerplate(self.pick("share", "advert"))
        for _ in range(int(math.exp(r.uniform(0, math.log(25)))) - self.maybe(0.15)):
            kind = r.random()
            if kind < 0.75:
                w.append(f"<p>{self.text(1, 150, True)}{self.pick('</p>', '</p>', '')}")
            elif kind < 0.82:
                w.append(f"<h{r.randrange(2, 5)}>{self.text(1, 8, True)}</h2>".replace("</h2>", self.pick("</h2>", "</h3>", "")) if self.maybe(0.1) else f"<h2>{self.text(1, 8, True)}</h2>")
            elif kind < 0.9:
                w.append("<ul>" + "".join(f"<li>{self.text(1, 25, True)}</li>" for _ in range(r.randrange(1, 6))) + "</ul>")
            elif kind < 0.94:
                w.append(f"<blockquote><p>{self.text(4, 60, True)}</p></blockquote>")
            elif kind < 0.97:
                w.append("<table>" + "".join(f"<tr><td>{self.text(1, 5, True)}</td><td>{self.text(1, 5, True)}</td></tr>" for _ in range(r.randrange(1, 5))) + "</table>")
            else:
                self.boilerplate(self.pick("advert", "share", "form", "side", "notice"))
        w.append(f"</{tag}>")

    def page(self) -> tuple[str, list[str]]:
        w = self.out
        w.append(f"<!DOCTYPE html><html><head><title>{self.words(2, 10)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>")
        deep = self.rng.randrange(0, 4)
        for _ in range(deep):
            w.append(f"<div{self.attr('wrapper', 'container', 'page', 'row', 'layout')}>")
        before = [k for k in ("notice", "header", "nav", "advert", "form", "side") if self.maybe(0.45)]
        after = [k for k in ("share", "comments", "side", "advert", "form", "nav", "notice", "footer") if self.maybe(0.5)]
        for k in before:
            self.boilerplate(k)
        self.article()
        for k in after:
            self.boilerplate(k)
        w.append("</div>" * deep + "</body></html>")
        return "".join(w), self.main


def training_pages(n: int = TRAINING_PAGES, seed: int = SEED) -> list[tuple[str, list[str]]]:
    """Generated (html, main text blocks)."""
    return [_Writer(seed * 100_003 + i).page() for i in range(n)]


def label(page: Page, main: list[str]) -> np.ndarray:
    """1 for nodes that are, or hold, a block of the main text (in its order)."""
    y = np.zeros(len(page.parent))
    at = 0
    for i, t in enumerate(page.text):
        if t is not None and at < len(main) and t == main[at]:
            at += 1
            while i >= 0 and not y[i]:
                y[i] = 1
                i = page.parent[i]
    return y


def train(pages: int = TRAINING_PAGES, seed: int = SEED) -> Forest:
    """Trees fitted to the generated pages; the same every time."""
    made = training_pages(pages, seed)
    read = [parse(source) for source, _ in made]
    x, _, _ = features(read)
    return fit(x, np.concatenate([label(p, m) for p, (_, m) in zip(read, made)]))


def extract(sources: list[str], forest: Forest) -> list[str]:
    """Main texts of some pages."""
    read = [parse(s or "") for s in sources]
    if not read:
        return []
    x, _, first = features(read)
    keep = forest.predict(x)
    return ["\n".join(decode(p, keep[a:b])) for p, a, b in zip(read, first[:-1], first[1:])]


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", forest: Forest | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row.

    Null or empty pages have empty text, as have pages without main text.
    White space inside a block is one space; blocks are joined by newlines.
    Repeated rows are each extracted; other columns are ignored; an empty table
    gives no rows.  Very long pages are read whole, in time linear in their
    length.  The model is fitted on ``TRAINING_PAGES`` generated pages, so it does not depend on the
    input.
    """
    sent = df.sparkSession.sparkContext.broadcast(forest or train())
    types = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                sources, held, end = [], 0, at
                while end < batch.num_rows and end - at < AT_ONCE and held < CHARS_AT_ONCE:
                    source = batch.column(2)[end].as_py() or ""
                    if sources and held + len(source) > CHARS_AT_ONCE:
                        break
                    sources.append(source)
                    held, end = held + len(source), end + 1
                part, at = batch.slice(at, end - at), end
                texts = extract(sources, sent.value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    rows = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"page_id {types[id_col]}, url string, text string, n_chars long")
