"""A tolerant reader of HTML: block elements and blocks of text, in page order, with features."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import numpy as np

OPENING = re.compile(r"""<(?:(!--)|[!?]|(/?)([a-zA-Z][^\s/><"']*))""")
STOP = re.compile("""[>"']""")
ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose contents are no page text.
DROPPED = frozenset("script style template noscript iframe object svg math title textarea select head datalist canvas audio video".split())
#: Contents that are not markup, up to the element's own end tag.
RAW = frozenset("script style title textarea noscript iframe template".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the key closes these open elements first, up to the nearest of the bounds.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
TAGS = ("article", "main", "section", "div", "p", "h1", "h", "list", "li", "table", "quote", "nav", "header", "footer", "aside", "form", "body", "text")
_KIND = {"h2": "h", "h3": "h", "h4": "h", "h5": "h", "h6": "h", "ul": "list", "ol": "list", "dl": "list", "menu": "list", "dt": "li", "dd": "li",
         "blockquote": "quote", "pre": "quote", "tr": "table", "td": "table", "th": "table", "tbody": "table", "thead": "table", "html": "body",
         "button": "form", "fieldset": "form", "legend": "form", "option": "form", "dialog": "aside", "search": "form", "summary": "section",
         "details": "section", "figure": "section", "figcaption": "p", "address": "p", "hgroup": "section"}
TAG_OF = {t: TAGS.index(_KIND.get(t, t)) if _KIND.get(t, t) in TAGS else TAGS.index("div") for t in BLOCK}
#: Groups of attribute words; each group is one feature.
WORDS = {
    "content": "content article post entry story body text main page prose markdown articlebody", "nav": "nav menu navbar navigation breadcrumb breadcrumbs pagination pager toc tabs skip",
    "header": "header head masthead top brand logo topbar hero", "footer": "footer foot bottom copyright legal colophon", "side": "sidebar side aside rail widget related recommended popular trending more teaser",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promoted banner adsense outbrain", "comment": "comment comments reply replies respond discussion disqus thread reader",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay warning paywall", "form": "form login signup subscribe newsletter search register", "share": "share social sharing follow tags meta byline author date",
}
GROUP_OF = {w: i for i, words in enumerate(WORDS.values()) for w in words.split()}
N_GROUPS = len(WORDS)


class Page(NamedTuple):
    """Nodes in page order, parents before children; text nodes hold a block."""

    parent: list[int]
    tag: list[int]
    groups: list[int]
    text: list[str | None]
    links: list[int]


_SPLIT = re.compile(r"[^a-z]+")
#: Leading zeros of numeric references, and references to more than any code point.
_ZEROS = re.compile(r"&#(?:([xX])0+(?=[0-9a-fA-F])|0+(?=[0-9]))")
_BEYOND = re.compile(r"&#(?:[xX][0-9a-fA-F]{7,}|[0-9]{8,});?")


def _groups(attributes: str) -> int:
    found = 0
    if "=" in attributes:
        for m in ATTRIBUTE.finditer(attributes):
            for w in _SPLIT.split((m[2] or m[3] or m[4] or "").lower()):
                g = GROUP_OF.get(w)
                if g is not None:
                    found |= 1 << g
    return found


class Tokens:
    """Tags and comments of a page from left to right, in time linear in its length.

    A tag ends at the first ``>`` outside quotes; where quotes or tags are left
    open, the ``<`` is text.  What a search found, or found missing, is kept
    for the searches that start behind it, and a quote from which no tag's end
    was reached is not followed again.
    """

    def __init__(self, source: str):
        self.source = source
        self.next_of: dict[str, tuple[int, int]] = {}  # by character: searched from, found at (the size: none)
        self.stop = (0, -1)
        self.lost: set[int] = set()

    def index(self, what: str, at: int) -> int:
        """First place of ``what`` from ``at`` on, or the size."""
        since, found = self.next_of.get(what, (0, -1))
        if not since <= at <= found:
            found = self.source.find(what, at)
            found = len(self.source) if found < 0 else found
            self.next_of[what] = (at, found)
        return found

    def end_of_tag(self, at: int) -> int:
        """Place of the ``>`` that ends the tag whose attributes start at ``at``, or -1."""
        source, size = self.source, len(self.source)
        first, seen = True, []
        while True:
            since, stop = self.stop
            if not (first and since <= at <= stop):
                m = STOP.search(source, at)
                stop = m.start() if m else size
                if first:
                    self.stop = (at, stop)
            first = False
            if stop == size or stop in self.lost:
                break
            if source[stop] == ">":
                return stop
            seen.append(stop)
            close = self.index(source[stop], stop + 1)
            if close == size:
                break
            at = close + 1
        self.lost.update(seen)
        return -1

    def after(self, at: int) -> tuple[int, int, str, str, str]:
        """(start, end, slash, name, attributes) of the next token; comments have no name, no token starts at the size."""
        source, size = self.source, len(self.source)
        start = source.find("<", at)
        while start >= 0:
            m = OPENING.match(source, start)
            if m:
                if m[1]:
                    end = self.index("-->", m.end())
                    return start, min(end + 3, size), "", "", ""
                if not m[3]:
                    end = self.index(">", m.end())
                    if end < size:
                        return start, end + 1, "", "", ""
                else:
                    end = self.end_of_tag(m.end())
                    if end >= 0:
                        return start, end + 1, m[2], m[3].lower(), source[m.end() : end]
            start = source.find("<", start + 1)
        return size, size, "", "", ""


def unescaped(text: str) -> str:
    """Character references decoded; numbers beyond all code points are U+FFFD."""
    if "&#" in text:
        text = _BEYOND.sub("\ufffd", _ZEROS.sub(r"&#\1", text))
    return html.unescape(text)


def parse(source: str) -> Page:
    """Nodes of a page; markup that is wrong or left open is taken as browsers roughly do.

    Time is linear in the length, however deep the nesting and however broken the tags.
    """
    page = Page([-1], [TAG_OF["body"]], [0], [None], [0])
    stack: list[tuple[str, int]] = [("#root", 0)]  # open elements: name, node (inline ones: the node they are in)
    opened: dict[str, list[int]] = {}  # places on the stack by name
    tokens = Tokens(source)
    run: list[str] = []
    linked = depth_a = dropped = 0
    at, size = 0, len(source)

    def close_block() -> None:
        nonlocal linked
        if run:
            text = " ".join(unescaped("".join(run)).split())
            if text:
                page.parent.append(stack[-1][1]), page.tag.append(TAGS.index("text")), page.groups.append(0)
                page.text.append(text), page.links.append(min(linked, len(text)))
            run.clear()
        linked = 0

    def pop_to(index: int) -> None:
        nonlocal depth_a, dropped
        if any(name in BLOCK for name, _ in stack[index:]):
            close_block()
        for name, _ in stack[index:]:
            opened[name].pop()
            depth_a -= name == "a"
            dropped -= name in DROPPED
        del stack[index:]

    def push(name: str, node: int) -> None:
        opened.setdefault(name, []).append(len(stack))
        stack.append((name, node))

    def innermost(names) -> int:
        return max([places[-1] for n in names if (places := opened.get(n))], default=-1)

    def find(names, bounds=()) -> int:
        """Place of the innermost open element of these names, unless one of the bounds is nearer; else -1."""
        i = innermost(names)
        return i if i > innermost(bounds) else -1

    while at < size:
        start, end, slash, name, attributes = tokens.after(at)
        piece = source[at:start]
        if piece and not dropped:
            run.append(piece)
            if depth_a:
                linked += len(piece)
        at = end
        if not name:
            continue
        if slash:
            i = find((name,))
            if i > 0:
                pop_to(i)
            elif name == "br":
                run.append(" ")
            continue
        if name in VOID:
            if name in ("br", "hr", "wbr") and not dropped:
                if name == "hr":
                    close_block()
                elif name == "br":
                    run.append(" ")
            continue
        if name in RAW:
            end = re.compile(f"</{name}(?=[\\s/>])", re.I).search(source, at)
            close = source.find(">", end.end()) if end else -1
            at = close + 1 if close >= 0 else size
            continue
        if name == "body" and dropped:
            i = find(("head",))
            if i > 0:
                pop_to(i)
        if name in BLOCK:
            if (i := find({"p"}, {"button", "td", "th", "table"})) > 0:
                pop_to(i)
            while name in CLOSES and (i := find(*CLOSES[name])) > 0:
                pop_to(i)
            close_block()
            if not dropped:
                page.parent.append(stack[-1][1]), page.tag.append(TAG_OF[name]), page.groups.append(_groups(attributes))
                page.text.append(None), page.links.append(0)
            push(name, len(page.parent) - 1 if not dropped else stack[-1][1])
        else:
            if not attributes.endswith("/"):
                push(name, stack[-1][1])
                depth_a += name == "a"
                dropped += name in DROPPED
    close_block()
    return page


NUMBERS = (
    "depth", "siblings", "place", "text_share", "log_chars", "log_words", "link_density", "log_density", "punctuation", "nodes",
    "sibling_chars", "same_tag_siblings", "parent_link_density", "paragraphs",
)
N_FEATURES = len(NUMBERS) + len(TAGS) * 2 + N_GROUPS * 3


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all nodes, parent of each node in the joint numbering, first node of each page)."""
    first = np.cumsum([0, *[len(p.parent) for p in pages]])
    n = int(first[-1])
    shift = np.repeat(first[:-1], np.diff(first))
    parent = np.concatenate([np.array(p.parent, np.int64) for p in pages]) + shift
    roots = first[:-1][np.diff(first) > 0]
    parent[roots] = roots
    tag = np.concatenate([np.array(p.tag, np.int64) for p in pages])
    groups = np.concatenate([np.array(p.groups, np.int64) for p in pages])
    flat = [t for p in pages for t in p.text]
    own = np.zeros((n, 5))
    for i, t in enumerate(flat):
        if t is not None:
            own[i, :3] = len(t), t.count(" ") + 1, t.count(".") + t.count(",") + t.count("!") + t.count("?") + t.count(";")
    own[:, 3] = np.concatenate([np.array(p.links) for p in pages])
    own[:, 4] = tag == TAGS.index("p")
    # nodes stand in the order of their start tags, so a subtree is a stretch of rows
    size = [1] * n
    for i, above_i in zip(range(n - 1, -1, -1), reversed(parent.tolist())):
        if above_i != i:
            size[above_i] += size[i]
    here = np.arange(n)
    end = here + size

    def under(columns: np.ndarray) -> np.ndarray:
        """Sums over the nodes below each node."""
        sums = np.vstack((np.zeros((1, columns.shape[1]), columns.dtype), np.cumsum(columns, axis=0, dtype=columns.dtype)))
        return sums[end] - sums[here + 1]

    def over(columns: np.ndarray) -> np.ndarray:
        """Sums over the nodes above each node."""
        steps = np.zeros((n + 1, columns.shape[1]), np.int32)
        steps[here + 1] += columns
        np.subtract.at(steps, end, columns)
        return np.cumsum(steps, axis=0, dtype=np.int32)[:n]

    depth = over(np.ones((n, 1), np.int32))[:, 0]
    total = np.column_stack((own, np.ones(n)))
    total += under(total)
    has_group = ((groups[:, None] >> np.arange(N_GROUPS)) & 1).astype(np.int32)
    has_tag = np.eye(len(TAGS), dtype=np.int32)[tag]
    above_tag = over(has_tag) > 0
    children = np.bincount(parent, minlength=n) - (parent == np.arange(n))
    order = np.argsort(parent, kind="stable")
    place = np.empty(n)
    sizes = np.bincount(parent, minlength=n)
    place[order] = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    siblings = np.maximum(children[parent], 1)
    chars = total[:, 0]
    page_chars = np.maximum(np.repeat(total[first[:-1][np.diff(first) > 0], 0], np.diff(first)[np.diff(first) > 0]), 1)
    same = np.unique(parent * 64 + tag, return_inverse=True, return_counts=True)
    density = total[:, 3] / np.maximum(chars, 1)
    numbers = np.column_stack((
        depth, siblings, place / siblings, chars / page_chars, np.log1p(chars), np.log1p(total[:, 1]), density, np.log1p(chars / total[:, 5]),
        total[:, 2] / np.maximum(total[:, 1], 1), np.log1p(total[:, 5]), np.log1p((chars[parent] - chars) / siblings),
        same[2][same[1]] / siblings, density[parent], np.log1p(total[:, 4]),
    ))
    flags = [has_group.astype(float), ((over(has_group) > 0) & (has_group == 0)).astype(float), (under(has_group) > 0).astype(float)]
    return np.hstack((numbers, has_tag.astype(float), above_tag.astype(float), *flags)), parent, first
