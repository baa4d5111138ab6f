"""Main-text extraction by gradient-boosted trees over DOM-node features.

A page is read in one pass into a tree of block elements; runs of text that
stand beside blocks are nodes of their own.  Every node has features of its
tag, attribute tokens, depth, siblings, the density of text, links and tags in
its subtree, and its relation to the node that holds most paragraph text.
Boosted trees give the odds that a node belongs to the main text or contains it,
if its parent does.  Decoding is hierarchical, from the root on: nothing below a
rejected node is kept.

The trees are fitted to pages of a generator (``training_pages``), whose labels
are known by construction; no input row is used for training.
"""

from __future__ import annotations

import html as html_lib
import math
import random
import re
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entailis.llm.common import prepare

#: Elements of HTML that have no content, that do not break a line, and whose content is no text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img picture svg".split())
RAW = frozenset("script style noscript template iframe object textarea title".split())
#: Raw elements that the rest of the page belongs to if they are never closed.
OPEN_ENDED = frozenset("script style textarea title".split())
#: A start tag of the key ends an open element of the value.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CLOSED = frozenset(["p", *CLOSES])
#: Elements that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements beyond which an implied end does not reach.
SCOPE = frozenset("ul ol dl table article section div main body html aside nav form blockquote td th".split())
STRUCTURE = ("#root", "html", "body")

#: A start tag whose attributes are well formed, and the parts of one whose are not.
_TAG = re.compile(r"<([a-zA-Z][^\s/>]*+)((?:\s++[^\s\"'<>/=]++(?:\s*+=\s*+(?:\"[^\"<]*+\"|'[^'<]*+'|[^\s\"'=<>`]++))?+)*+)\s*+/?>")
_TAG_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_SKIP, _NAME, _EQUALS, _BARE = (re.compile(x) for x in (r"[\s/]*+", r"[^\s/>][^\s/>=]*+", r"\s*+=\s*+", r"[^\s>]++"))
_ATTR = re.compile(r"(?:^|\s)(class|id|role|data-l)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")

#: Groups of words in class, id and role attributes that hint at what an element is.
HINTS = [
    frozenset("article post entry story content main body text news prose blog".split()),
    frozenset("nav navigation menu navbar breadcrumb breadcrumbs toc pagination pager tabs dropdown skip".split()),
    frozenset("ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner affiliate commercial dfp".split()),
    frozenset("comment comments reply replies respond disqus discussion responses reader".split()),
    frozenset("footer foot copyright bottom legal colophon".split()),
    frozenset("header masthead head top topbar branding logo site".split()),
    frozenset("sidebar side aside widget widgets rail related recommended recommend popular trending more".split()),
    frozenset("cookie cookies consent notice notices alert gdpr privacy popup modal overlay disclaimer warning message".split()),
    frozenset("share sharing social follow subscribe newsletter signup login register search form print".split()),
]
TAGS = ["p", "h1", "h2 h3 h4 h5 h6", "li dt dd", "ul ol dl menu", "nav", "header", "footer", "aside", "form fieldset button select option input", "article main", "section div center", "table tr tbody thead tfoot", "td th", "blockquote pre figure figcaption", "head", "body html", "#run"]
_TAG_AT = {t: i for i, group in enumerate(TAGS) for t in group.split()}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
N_FEATURES = len(TAGS) + len(HINTS) + 27


class Node:
    __slots__ = ("blocks", "children", "hints", "kept", "links", "mark", "name", "near", "parent", "tags", "text")

    def __init__(self, name: str, parent: Node | None, hints: tuple[int, ...] = ()):
        self.name, self.parent, self.hints = name, parent, hints
        self.children: list[Node] = []
        self.blocks: list[str | Node] = []  # text and child elements in page order
        self.text = self.links = self.tags = 0
        self.kept = False
        self.mark: bool | None = None
        #: The nearest open elements, by name, that an implied end can reach.
        self.near: dict[str, Node] = {} if parent is None or name in SCOPE else parent.near
        if name in CLOSED:
            self.near = {**self.near, name: self}


def _words(value: str) -> set[str]:
    return {w.lower() for w in _PART.findall(value)}


def _hints(words: set[str]) -> tuple[int, ...]:
    return tuple(i for i, group in enumerate(HINTS) if words & group) if words else ()


class _Reader:
    """One pass over a page; every step moves on or remembers that it need not look again, so time is linear."""

    def __init__(self, page: str):
        self.page, self.at = page, 0
        #: From where on a quote or an end tag does not occur.
        self.none_from: dict[str, int] = {}

    def attributes(self, i: int) -> tuple[int, dict[str, str]]:
        """(where the start tag ends that goes on at i, its attributes); -1 where the page ends first.

        A quote that is never closed ends with the tag, at the next ``>``.
        """
        page, n, found = self.page, len(self.page), {}
        while True:
            i = _SKIP.match(page, i).end()
            if i >= n:
                return -1, found
            if page[i] == ">":
                return i + 1, found
            m = _NAME.match(page, i)
            name, i = m[0].lower(), m.end()
            m = _EQUALS.match(page, i)
            if m is None:
                continue
            i = m.end()
            quote = page[i : i + 1]
            if quote in ('"', "'"):
                end = page.find(quote, i + 1) if i < self.none_from.get(quote, n) else -1
                if end < 0:
                    self.none_from[quote] = min(i, self.none_from.get(quote, n))
                    end = page.find(">", i)
                    return (end + 1 if end >= 0 else -1), found
                found[name], i = page[i + 1 : end], end + 1
            elif quote and quote != ">":
                m = _BARE.match(page, i)
                found[name], i = m[0], m.end()

    def skip_raw(self, name: str, i: int) -> int:
        """Where the raw element ends whose content starts at i; i if it is not closed and need not be, -1 if the rest is its content."""
        if i < self.none_from.get(name, len(self.page) + 1):
            m = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(self.page, i)
            if m:
                end = self.page.find(">", m.end())
                return end + 1 if end >= 0 else -1
            self.none_from[name] = i
        return -1 if name in OPEN_ENDED else i


def parse(page: str, marks: bool = False) -> Node:
    """The tree of block elements of a page; comments, raw elements and markup are left out.

    marks: nodes get the label that a ``data-l`` attribute, or for runs a first
    character of MARKS, gives them.
    """
    root = Node("#root", None)
    reader, here, in_link, at, end = _Reader(page), root, 0, 0, len(page)
    opened: dict[str, int] = {}

    def add(text: str) -> None:
        here.blocks.append(text)
        n = len(text)
        here.text += n
        if in_link:
            here.links += n

    def close(node: Node) -> Node:
        """Close node and what is open in it; each element is closed once."""
        x = here
        while True:
            opened[x.name] -= 1
            if x is node:
                return node.parent
            x = x.parent

    while at < end:
        start = page.find("<", at)
        if start != at:
            text = page[at : start if start >= 0 else end]
            add(html_lib.unescape(text) if "&" in text else text)
            if start < 0:
                break
        m = _TAG.match(page, start)
        if m is None:
            m = _TAG_NAME.match(page, start)
            if m is None:
                sort = page[start + 1 : start + 2]
                if sort not in ("!", "?", "/") or not sort:
                    add("<")
                    at = start + 1
                    continue
                close_by = "-->" if page.startswith("<!--", start) else ">"
                stop = page.find(close_by, start + 2)
                if stop < 0:
                    break
                at = stop + len(close_by)
                continue
            if page[start + 1] == "/":
                stop = page.find(">", m.end())
                if stop < 0:
                    break
                at, name = stop + 1, m[1].lower()
                if name in INLINE:
                    if name == "a" and in_link:
                        in_link -= 1
                elif opened.get(name):
                    node = here
                    while node.name != name:
                        node = node.parent
                    here, in_link = close(node), 0
                continue
            name = m[1].lower()
            at, given = reader.attributes(m.end())
            if at < 0:
                break
        else:
            name, at = m[1].lower(), m.end()
            given = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in _ATTR.finditer(m[2])} if "=" in m[2] else {}
        if name in RAW:
            at = reader.skip_raw(name, at)
            if at < 0:
                break
            continue
        if name in INLINE:
            here.tags += 1
            if name == "br":
                here.blocks.append(" ")
            in_link += name == "a"
            continue
        if name in ENDS_P and "p" in here.near:
            here = close(here.near["p"])
        for other in CLOSES.get(name, ()):
            if other in here.near:
                here = close(here.near[other])
        in_link = 0
        if name in VOID and name != "hr":
            here.tags += name == "input"
            continue
        node = Node(name, here, _hints({w for k in ("class", "id", "role") if k in given for w in _words(given[k])}) if given else ())
        if marks and "data-l" in given:
            node.mark = given["data-l"] == "1"
        here.children.append(node)
        here.blocks.append(node)
        if name not in VOID:
            opened[name] = opened.get(name, 0) + 1
            here = node
    _make_runs(root, marks)
    return root


#: First characters of a run in a generated page: dropped, kept.
MARKS = "\ue000\ue001"


def _make_runs(root: Node, marks: bool) -> None:
    """Text beside blocks, and text of the page itself, becomes nodes of its own."""
    stack = [root]
    while stack:
        node = stack.pop()
        stack += node.children
        if not node.children and node.name not in STRUCTURE:
            continue
        blocks: list[Node] = []
        held: list[str] = []
        for b in (*node.blocks, None):
            if b.__class__ is str:
                held.append(b)
                continue
            if held and any(not h.isspace() for h in held):
                run = Node("#run", node)
                run.blocks, run.text = held, sum(map(len, held))
                text = "".join(held).lstrip()
                if marks and text[0] in MARKS:
                    run.mark, run.blocks = text[0] == MARKS[1], [text[1:]]
                blocks.append(run)
            held = []
            if b is not None:
                blocks.append(b)
        runs = [b for b in blocks if b.name == "#run"]
        for run in runs:  # links and inline tags are dealt to runs by their share of text
            share = run.text / max(1, node.text)
            run.links, run.tags = int(node.links * share), int(node.tags * share)
        if runs:
            node.text = node.links = 0
        node.blocks, node.children = blocks, list(blocks)


def nodes_of(root: Node) -> list[Node]:
    """All nodes in page order, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed(node.children))
    return out[1:]


def features(root: Node) -> tuple[list[Node], np.ndarray]:
    """(nodes, a row of features for each)."""
    nodes = nodes_of(root)
    at = {id(n): i for i, n in enumerate(nodes)}
    n = len(nodes)
    up = [at.get(id(node.parent), -1) for node in nodes]
    text, links, tags, marks, heads, forms, leaves, prose = ([0] * n for _ in range(8))
    own_prose = [0] * (n + 1)  # paragraph text of direct children; the last is the page's own
    last = list(range(n))
    for i in range(n - 1, -1, -1):
        node, j = nodes[i], up[i]
        text[i] += node.text
        links[i] += node.links
        tags[i] += 1 + node.tags
        marks[i] += sum(b.count(",") + b.count(".") for b in node.blocks if b.__class__ is str)
        heads[i] += node.name == "h1"
        forms[i] += node.name in ("form", "button", "select", "fieldset")
        if not node.children:
            leaves[i] = 1
            if node.name in ("p", "#run", "pre", "blockquote", "div", "td", "li") and marks[i]:
                prose[i] = max(0, text[i] - 2 * links[i] - 20)
                own_prose[j] += prose[i]
        if j >= 0:
            text[j] += text[i]
            links[j] += links[i]
            tags[j] += tags[i]
            marks[j] += marks[i]
            heads[j] += heads[i]
            forms[j] += forms[i]
            leaves[j] += leaves[i]
            prose[j] += prose[i]
            last[j] = max(last[j], last[i])
    total, all_prose = max(1, sum(node.text for node in nodes)), max(1, sum(own_prose))
    top = max(range(n + 1), key=lambda i: own_prose[i]) if n else 0
    above, x = set(), up[top] if top < n else -1
    while x >= 0:
        above.add(x)
        x = up[x]
    top_last = last[top] if top < n else n
    page_article = any(node.name in ("article", "main") for node in nodes)
    seen_h1 = 0
    log = math.log1p
    place, like, most = {}, {}, {}
    for p in (root, *nodes):
        names: dict[str, int] = {}
        for k, c in enumerate(p.children):
            place[id(c)] = k
            names[c.name] = names.get(c.name, 0) + 1
        like[id(p)] = names
        most[id(p)] = max((text[at[id(c)]] for c in p.children), default=1)
    rows, depth, inside, below = [], [0] * n, [0] * n, [0] * n
    for i, node in enumerate(nodes):
        j = up[i]
        depth[i] = depth[j] + 1 if j >= 0 else 0
        inside[i] = (inside[j] if j >= 0 else 0) | (node.name in ("article", "main"))
        below[i] = (j == top or (top == n and j < 0) or (j >= 0 and below[j])) + 0
        row = [0.0] * N_FEATURES
        k = _TAG_AT.get(node.name)
        if k is not None:
            row[k] = 1.0
        for h in node.hints:
            row[len(TAGS) + h] = 1.0
        parent = node.parent
        k, siblings = place[id(node)], len(parent.children)
        before = parent.children[k - 1].name if k else ""
        after = parent.children[k + 1].name if k + 1 < siblings else ""
        row[len(TAGS) + len(HINTS) :] = (
            depth[i], log(text[i]), links[i] / (text[i] + 1), log(tags[i]), log(text[i] / tags[i]), 100 * marks[i] / (text[i] + 20), text[i] / total,
            k / siblings, log(siblings), like[id(parent)][node.name] / siblings, log(node.text), inside[i], heads[i] > 0, min(forms[i], 3), log(len(node.children)), text[i] / (text[j] + 1) if j >= 0 else 1.0,
            text[i] / (most[id(parent)] + 1), i in above, i == top, below[i], (i > top_last) - (last[i] < top if top < n else 0), prose[i] / all_prose,
            text[i] / max(1, leaves[i]), before in HEADINGS, after in HEADINGS, page_article, min(seen_h1, 2),
        )
        seen_h1 += node.name == "h1"
        rows.append(row)
    return nodes, np.array(rows, np.float32).reshape(n, N_FEATURES)


class BoostedTrees:
    """Gradient-boosted trees of fixed depth on binned features, for log-odds; each tree sees a share of the rows and features."""

    def __init__(self, rounds: int = 90, depth: int = 5, rate: float = 0.2, bins: int = 32, ridge: float = 2.0, share: float = 0.5, seed: int = 1):
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.share, self.seed = rounds, depth, rate, bins, ridge, share, seed
        self.feature = np.zeros((rounds, (1 << depth) - 1), np.int64)
        self.cut = np.full((rounds, (1 << depth) - 1), np.inf, np.float32)
        self.leaf = np.zeros((rounds, 1 << depth))
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
        rate = y.mean()
        self.start = float(np.log(rate / (1 - rate)))
        score, rng = np.full(len(y), self.start), np.random.default_rng(self.seed)
        useful = [f for f, e in enumerate(edges) if len(e)]
        for r in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            rows = np.flatnonzero(rng.random(len(y)) < self.share)
            picked = rng.permutation(useful)[: max(1, int(len(useful) * self.share))]
            for level in range(self.depth):
                first, width = (1 << level) - 1, 1 << level
                best = np.full(width, 1e-6)
                for f in picked:
                    size = len(edges[f]) + 1
                    key = node[rows] * size + binned[rows, f]
                    g = np.cumsum(np.bincount(key, grad[rows], width * size).reshape(width, size), 1)
                    h = np.cumsum(np.bincount(key, hess[rows], width * size).reshape(width, size), 1)
                    total_g, total_h = g[:, -1:], h[:, -1:]
                    gain = g**2 / (h + self.ridge) + (total_g - g) ** 2 / (total_h - h + self.ridge) - total_g**2 / (total_h + self.ridge)
                    gain = gain[:, :-1]
                    at = gain.argmax(1)
                    value = gain[np.arange(width), at]
                    for k in np.flatnonzero(value > best):
                        best[k] = value[k]
                        self.feature[r, first + k], self.cut[r, first + k] = f, edges[f][at[k]]
                right = x[np.arange(len(y)), self.feature[r, first + node]] > self.cut[r, first + node]
                node = 2 * node + right
            g, h = np.bincount(node, grad, 1 << self.depth), np.bincount(node, hess, 1 << self.depth)
            self.leaf[r] = self.rate * g / (h + self.ridge)
            score += self.leaf[r, node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        score, rows = np.full(len(x), self.start), np.arange(len(x))
        for r in range(self.rounds):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = (1 << level) - 1 + node
                node = 2 * node + (x[rows, self.feature[r, at]] > self.cut[r, at])
            score += self.leaf[r, node]
        return score


def decode(root: Node, nodes: list[Node], odds: np.ndarray) -> None:
    """Mark kept nodes, parents first: of what a kept node holds, all that is likelier kept than not.

    The odds are those of a node whose parent is kept, so a node's choice stands
    for its whole subtree and no choice below contradicts it.
    """
    root.kept = True
    for node, o in zip(nodes, odds.tolist(), strict=True):
        node.kept = node.parent.kept and o > 0


def text_of(root: Node) -> str:
    """The kept nodes' text, white space made single, blocks joined by line feeds."""
    out: list[str] = []

    def flush(run: list[str]) -> None:
        line = " ".join("".join(run).split())
        if line:
            out.append(line)

    # An explicit stack, as pages may be nested deeper than Python's own.
    stack = [root]
    while stack:
        node = stack.pop()
        if node.children:  # then all of its text is in runs
            stack.extend(c for c in reversed(node.children) if c.kept)
        elif node is not root:
            flush(node.blocks)
    return "\n".join(out)


def extract(pages: list[str | None], model: BoostedTrees) -> list[str]:
    """The main text of each page; empty for null and empty pages."""
    roots = [parse(p) if p else None for p in pages]
    parts = [features(r) if r is not None else ([], None) for r in roots]
    rows = [x for _, x in parts if x is not None and len(x)]
    odds = model.predict(np.concatenate(rows)) if rows else np.zeros(0)
    out, k = [], 0
    for root, (nodes, _) in zip(roots, parts, strict=True):
        if root is None:
            out.append("")
            continue
        decode(root, nodes, odds[k : k + len(nodes)])
        k += len(nodes)
        out.append(text_of(root))
    return out


# --- training pages ---------------------------------------------------------

_SYLLABLES = "ka lo mi ten sor el vad ni pru stel or an di ba tho ren is quo".split()
_NO_HINT = frozenset("p h1 h2 h3 html body head tr td table".split())


class _Writer:
    """A page as a string, with the label of each element and run in it."""

    def __init__(self, rng: random.Random):
        self.rng, self.parts = rng, []
        #: How pages say what their parts are: by elements, by class names, or not at all; tables and flat pages hardly do either.
        self.style = rng.choices(["semantic", "hinted", "plain", "table", "flat"], [25, 20, 30, 10, 15])[0]
        self.sloppy = rng.random() < 0.15

    def word(self) -> str:
        return "".join(self.rng.choice(_SYLLABLES) for _ in range(self.rng.randint(1, 4)))

    def short(self, low: int = 1, high: int = 4) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(low, high)))

    def prose(self, low: int, high: int) -> str:
        words, out = self.rng.randint(low, high), []
        while words > 0:
            n = min(words, self.rng.randint(4, 18))
            s = [self.word() for _ in range(n)]
            if n > 6 and self.rng.random() < 0.6:
                s[n // 2] += ","
            out.append(" ".join(s).capitalize() + ".")
            words -= n
        return " ".join(out)

    def rich(self, low: int, high: int) -> str:
        """Prose with inline elements, some of them with telling class names that mean nothing here."""
        text, rng = self.prose(low, high), self.rng
        if rng.random() < 0.35:
            hint = rng.choice(sorted(rng.choice(HINTS)))
            inline = rng.choice([f"<b>{self.short()}</b>", f'<a href="/">{self.short()}</a>', f'<span class="{hint}">{self.short()}</span>', f"<em>{self.short()}</em>", "<br>", " &amp; ", f"<b>{self.prose(2, 12)}<br>"])
            at = text.find(" ", len(text) // 2)
            text = text[:at] + " " + inline + text[at:] if at > 0 else inline + " " + text
        return text

    def open(self, name: str, good: bool, hint: str | None = None) -> None:
        rng, attr = self.rng, ""
        if hint and name not in _NO_HINT:
            attr = f' {rng.choice(["class", "class", "id"])}="{rng.choice(["", "x-", "my_", self.word() + " "])}{hint}"'
        elif rng.random() < 0.2:
            attr = f' class="{self.word()}"'
        elif good and name in ("p", "h2", "li", "blockquote", "figure") and rng.random() < 0.04:
            attr = f' class="{rng.choice(sorted(rng.choice(HINTS)))}"'
        self.parts.append(f'<{name} data-l="{int(good)}"{attr}>')

    def close(self, name: str) -> None:
        if not (self.sloppy and name in ("p", "li", "td", "tr")):
            self.parts.append(f"</{name}>")

    def leaf(self, name: str, text: str, good: bool, hint: str | None = None) -> None:
        self.open(name, good, hint)
        self.parts.append(text)
        self.close(name)

    def run(self, text: str, good: bool) -> None:
        self.parts.append(MARKS[good] + text)

    def link_list(self, n: int) -> None:
        self.open("ul", False)
        for _ in range(n):
            self.leaf("li", f'<a href="/{self.word()}">{self.short()}</a>', False)
        self.close("ul")

    def bare_links(self, n: int) -> str:
        return self.rng.choice([" | ", " ", " &middot; "]).join(f'<a href="/">{self.short()}</a>' for _ in range(n))

    def tag_for(self, kind: str) -> tuple[str, str | None]:
        """(element, hint) of a part of the page that is no main text."""
        rng = self.rng
        element = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "notice": "section", "advert": "aside", "form": "form", "comments": "section", "share": "ul"}[kind]
        words = {
            "menu": ["nav", "menu", "navbar", "main-menu", "breadcrumb", "pagination"], "header": ["header", "masthead", "topbar", "site-header"], "footer": ["footer", "site-footer", "copyright", "bottom"],
            "side": ["sidebar", "widget", "related", "popular", "rail"], "notice": ["cookie", "consent", "notice", "alert", "gdpr", "disclaimer"], "advert": ["ad", "ads", "advert", "sponsored", "promo", "banner"],
            "form": ["search", "newsletter", "subscribe", "login", "signup", "form"], "comments": ["comments", "comment-list", "replies", "discussion", "respond"], "share": ["share", "social", "follow"],
        }[kind]
        # Without a word these cannot be told from text of the page, whatever its style.
        must = kind in ("advert", "comments", "notice")
        hint = rng.choice(words) if must or self.style == "hinted" or (self.style == "semantic" and rng.random() < 0.5) else None
        own = rng.random() < (0.8 if self.style == "semantic" else 0.3) or kind == "form"
        return (element if own else rng.choice(["div", "div", "div", "section"])), hint

    def clutter(self, kind: str) -> None:
        rng = self.rng
        tag, hint = self.tag_for(kind)
        self.open(tag, False, hint)
        if kind in ("menu", "share"):
            n = rng.randint(2, 9)
            if tag == "ul":
                for _ in range(n):
                    self.leaf("li", f'<a href="/">{self.short()}</a>', False)
            elif rng.random() < 0.6:
                self.link_list(n)
            else:
                self.parts.append(self.bare_links(n))
        elif kind == "header":
            if rng.random() < 0.5:
                self.leaf(rng.choice(["div", "p", "h1", "h2"]), f'<a href="/">{self.short()}</a>' if rng.random() < 0.6 else self.short(), False)
            else:
                self.leaf("div", f'<a href="/">{self.short()}</a>', False)
            if rng.random() < 0.6:
                self.link_list(rng.randint(2, 7))
        elif kind == "footer":
            said = f"&copy; {self.short()} &middot; {self.prose(2, 25) if hint or tag == 'footer' else self.short(1, 6)}"
            if rng.random() < 0.5:
                self.parts.append(said if rng.random() < 0.5 else self.bare_links(rng.randint(2, 4)) + " " + said)
            else:
                self.leaf("p", said, False)
                if rng.random() < 0.6:
                    self.link_list(rng.randint(2, 6))
        elif kind == "form":
            self.leaf("div", f'<label>{self.short()}</label><input name="q"><input type="submit">', False)
            if rng.random() < 0.5:
                self.leaf("p", self.prose(3, 20), False)
            if rng.random() < 0.5:
                self.leaf("button", self.short(), False)
        elif kind == "comments":
            if rng.random() < 0.6:
                self.leaf(rng.choice(["h2", "h3"]), self.short(), False)
            for _ in range(rng.randint(1, 6)):
                self.open("div", False, rng.choice(["comment", "reply", None]))
                if rng.random() < 0.5:
                    self.leaf("div", self.short(), False)
                for _ in range(rng.randint(1, 2)):
                    self.leaf("p", self.prose(4, 60), False)
                self.close("div")
        elif kind == "side" and not hint and tag != "aside":
            self.leaf(rng.choice(["h3", "h4"]), self.short(), False)
            self.link_list(rng.randint(3, 8))
        else:
            shape, titled = rng.random(), rng.random() < 0.4
            if titled:
                self.leaf(rng.choice(["h2", "h3", "h4", "p"]), self.short(), False)
            if shape < 0.45:
                text = self.prose(2, 35) if rng.random() < 0.8 else f'<a href="/">{self.short(2, 8)}</a>'
                self.run(text, False) if titled and not self.sloppy else self.parts.append(text) if not titled else self.leaf("div", text, False)
            elif shape < 0.8:
                for _ in range(rng.randint(1, 3)):
                    self.leaf("p", self.prose(3, 45), False)
            else:
                self.link_list(rng.randint(2, 6))
        self.close(tag)

    def content(self, mixed: bool) -> None:
        """What an article is made of; mixed: text may stand beside blocks."""
        rng = self.rng
        if rng.random() < 0.85:
            boxed = rng.random() < 0.12
            if boxed:
                self.open("header", True)
            self.leaf("h1" if rng.random() < 0.8 else "h2", self.short(1, 10), True)
            if boxed:
                self.close("header")
        if rng.random() < 0.15:
            self.leaf(rng.choice(["p", "div"]), self.short(2, 5), True)
        bare = mixed and rng.random() < 0.5
        for _ in range(rng.choice([1, 1, 1, 2, 3, 4, 6, 9, 14])):
            kind = rng.random()
            if bare and kind < 0.5:
                if self.parts[-1][-1] == ">":
                    self.run(self.rich(5, rng.choice([20, 60, 120])), True)
                else:
                    self.leaf("p", self.rich(5, 60), True)
            elif kind < 0.74:
                self.leaf("p" if rng.random() < 0.92 else "div", self.rich(1, rng.choice([3, 12, 60, 160])), True)
            elif kind < 0.8:
                self.leaf(rng.choice(["h2", "h3"]), self.short(1, 6), True)
            elif kind < 0.87:
                kind = rng.choice(["ul", "ol"])
                self.open(kind, True)
                for _ in range(rng.randint(2, 6)):
                    self.leaf("li", self.prose(2, 25), True)
                self.close(kind)
            elif kind < 0.9:
                self.open("blockquote", True)
                self.leaf("p", self.prose(5, 50), True)
                self.close("blockquote")
            elif kind < 0.92:
                if rng.random() < 0.5:
                    self.leaf("pre", self.prose(3, 30), True)
                else:
                    self.open("figure", True)
                    self.parts.append('<img src="x">')
                    self.leaf("figcaption", self.short(2, 8), True)
                    self.close("figure")
            elif kind < 0.94 and not self.sloppy:
                self.open("table", True)
                for _ in range(rng.randint(1, 4)):
                    self.open("tr", True)
                    for _ in range(rng.randint(2, 4)):
                        self.leaf("td", self.short(), True)
                    self.close("tr")
                self.close("table")
            else:
                self.clutter(rng.choice(["advert", "advert", "share", "form", "notice"]))

    def article(self) -> None:
        rng = self.rng
        tag, hint = {
            "semantic": (rng.choice(["article", "article", "main"]), None), "hinted": ("div", rng.choice(["content", "post", "entry-content", "article-body", "main", "story"])),
            "plain": (rng.choice(["div", "div", "section"]), None), "table": ("div", None), "flat": ("", None),
        }[self.style]
        wraps = [rng.choice(["div", "section"]) for _ in range(rng.choice([0, 0, 0, 1, 2]))] if tag else []
        for w in ([tag] if tag else []) + wraps:
            self.open(w, True, hint)
            hint = None
        self.content(mixed=not self.sloppy)
        for w in reversed(wraps):
            self.close(w)
        if tag:
            if rng.random() < 0.12:
                self.clutter("comments")
            self.close(tag)

    def page(self) -> None:
        rng = self.rng
        head, body = rng.random() < 0.9, rng.random() < 0.95
        if head:
            self.parts.append("<!DOCTYPE html>")
            self.open("html", True)
            self.open("head", False)
            self.parts.append(f'<meta charset="utf-8"><title>{self.short()}</title><style>p{{margin:0}}</style>')
            self.close("head")
        if body:
            self.open("body", True)
        bare = rng.random() < 0.12  # the article and nothing else
        wraps = [] if bare or self.style == "flat" else ["div"] * rng.choice([0, 0, 0, 1, 1, 2])
        for _ in wraps:
            self.open("div", True, rng.choice([None, "page", "wrapper", "container"]))
        chance = lambda p, kind: self.clutter(kind) if not bare and rng.random() < p else None
        if self.style == "table":
            self.open("table", True)
            self.open("tr", True)
            cells = ["menu"] * (rng.random() < 0.8) + ["article"] + ["side"] * (rng.random() < 0.4)
            for cell in cells:
                self.open("td", cell == "article")
                if cell == "article":
                    self.article() if rng.random() < 0.4 else self.content(mixed=True)
                elif cell == "menu" and rng.random() < 0.6:
                    self.parts.append(self.bare_links(rng.randint(1, 7)))
                else:
                    self.clutter(cell)
                self.parts.append("</td>")
            self.parts.append("</tr></table>")
            chance(0.5, "footer")
        else:
            chance(0.25, "notice")
            chance(0.35, "header")
            chance(0.6, "menu")
            chance(0.4, "advert")
            chance(0.15, "side")
            self.article()
            chance(0.25, "comments")
            chance(0.3, "side")
            chance(0.2, "form")
            chance(0.2, "share")
            chance(0.25, "advert")
            chance(0.7, "footer")
            chance(0.15, "notice")
        for _ in wraps:
            self.close("div")
        if body and not self.sloppy:
            self.parts.append("</body>" + ("</html>" if head else ""))


def training_pages(n: int, seed: int = 5) -> list[str]:
    """Generated pages with the labels in them that parse reads as marks."""
    out = []
    for k in range(n):
        w = _Writer(random.Random(seed * 1_000_003 + k))
        w.page() if k % 40 else w.run(w.prose(3, 200), True)  # some are plain text
        out.append("".join(w.parts))
    return out


def labelled(page: str) -> tuple[Node, list[Node], np.ndarray, np.ndarray, np.ndarray]:
    """(root, nodes, features, which nodes have labels and kept parents, labels) of a generated page."""
    root = parse(page, marks=True)
    root.mark = True
    nodes, x = features(root)
    return root, nodes, x, np.array([n.mark is not None and bool(n.parent.mark) for n in nodes], bool), np.array([bool(n.mark) for n in nodes], bool)


@cache
def train(pages: int = 2500, seed: int = 5) -> BoostedTrees:
    """Trees fitted to generated pages, once in a process; the same for the same arguments."""
    xs, ys = [], []
    for page in training_pages(pages, seed):
        _, _, x, known, y = labelled(page)
        xs.append(x[known])
        ys.append(y[known])
    return BoostedTrees().fit(np.concatenate(xs), np.concatenate(ys).astype(float))


def main_text(pages: DataFrame, model: BoostedTrees | None = None, html: str = "html") -> Column:
    """A string column: the main text of the whole html of each row of pages.

    Null and empty html gives an empty string, and so does a page without main
    text.  Text beside blocks or directly in the body is judged as a block of
    its own.  A tag that the page ends in is no text; a quote that is never
    closed ends with its tag.  Repeated rows are treated alike.  Time is linear
    in the page.  The model is a few thousand numbers.
    """
    prepare(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model or train())

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return pd.Series(extract([p if isinstance(p, str) else None for p in column], shared.value), dtype=object)

    return run(F.col(html).cast("string"))
