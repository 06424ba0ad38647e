"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree."""

from __future__ import annotations

import html as html_lib
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, slices, small_batches

#: Made pages that the trees are fitted on, and the seed of their making.
TRAIN_PAGES, SEED = 900, 7
TREES, DEPTH, RATE, BINS = 80, 4, 0.2, 32
#: Share of the nodes that each tree is grown on.
SHARE = 0.4

# A quoted value that goes on beyond what looks like the tag's end and another tag was never closed: its quote is a character.
_QUOTED = "|".join(rf"{q}(?:[^{q}<]*+|[^{q}<>]*+<[^{q}]*+){q}" for q in "\"'")
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|{_QUOTED}|[\"'])*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What is not shown, or is part of a form. All other elements' text counts, be it of formulas, drawings or fallbacks.
RAW = frozenset("script style template iframe textarea select title head".split())
#: Those of RAW whose content is text up to the end tag, or up to the end of the page if there is none.
HIDES = frozenset("script style title textarea".split())
BLOCK = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre "
    "figure figcaption nav header footer aside form fieldset address details summary center hgroup search dialog menu noscript".split()
)
#: What an opening tag closes.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
} | {k: {"p"} for k in "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()}
#: Elements that closing does not reach across.
WALL = frozenset("article section main div ul ol dl table td th nav header footer aside form body html blockquote figure li".split())

#: Words of attributes by what they tell.
TOKENS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc sitemap pagination pager tabs toolbar",
    "head": "header masthead banner topbar brand logo hero",
    "foot": "footer foot copyright colophon legal bottom",
    "side": "sidebar side aside rail related widget widgets recommended trending popular more",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner partner outbrain taboola",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe paywall disclaimer",
    "comment": "comment comments reply replies discussion disqus respond thread",
    "form": "form search login signup signin register input button contact",
    "share": "share sharing social follow facebook twitter tweet author byline meta tags tag date",
    "main": "article main content post entry story body text page prose blog news",
}
_GROUP = {w: g for g, words in TOKENS.items() for w in words.split()}
TAGS = ("article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "li", "table", "blockquote", "pre", "figure", "nav", "header", "footer", "aside", "form", "body", "td", "details")


class Node:
    __slots__ = ("tag", "attrs", "up", "items", "at", "depth")

    def __init__(self, tag: str, attrs: str, up: Node | None):
        self.tag, self.attrs, self.up, self.items = tag, attrs, up, []
        self.depth = up.depth + 1 if up else 0


class _Open:
    """The open elements, and where in the stack those of each tag and the walls are, so that no tag needs a search."""

    def __init__(self, root: Node):
        self.stack, self.places, self.walls = [root], {}, [0]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in WALL:
            self.walls.append(len(self.stack))
        self.stack.append(node)

    def last(self, tag: str) -> int:
        return own[-1] if (own := self.places.get(tag)) else 0

    def close(self, at: int) -> None:
        """Close what is open from a place in the stack on."""
        while len(self.stack) > at:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            if tag in WALL:
                self.walls.pop()


def parse(page: str) -> Node:
    """The block elements of a page as a tree; inline elements are part of their block, their tags forgotten, and
    hidden matter is left out. Any text is a page: end tags may be missing or be too many, and quotes may be unclosed. Only script,
    style, title and textarea without an end tag hide the rest, as in browsers; of others without one just the tag is left
    out. Time grows with the page's length, however it is nested."""
    root = Node("html", "", None)
    here, at, link = root, 0, False
    open_ = _Open(root)
    size = len(page)
    pairs: dict[int, int] | None = None
    while at < size:
        m = _TOKEN.search(page, at)
        begin = m.start() if m else size
        if begin > at:
            here.items.append((page[at:begin], link))
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                link = False
            elif tag in BLOCK and (k := open_.last(tag)) and (k >= open_.walls[-1] or tag not in ("p", "li", "td", "th", "tr")):
                open_.close(k)
                here = open_.stack[-1]
            continue
        if tag in HIDES:
            end = _ENDS[tag].search(page, at)
            at = end.end() if end else size
            continue
        if tag in RAW:
            pairs = _pairs(page, begin) if pairs is None else pairs
            at = pairs.get(begin, at)
            continue
        if tag == "br" or tag == "hr":
            here.items.append((" ", False))
        if tag == "a":
            link = True
        if tag in BLOCK and tag not in ("html",):
            if tag == "body":
                root.attrs += m[3] or ""
                continue
            k = max(map(open_.last, CLOSES[tag]), default=0) if tag in CLOSES else 0
            if k and k >= open_.walls[-1]:
                open_.close(k)
            here = Node(tag, m[3] or "", open_.stack[-1])
            here.up.items.append(here)
            open_.push(here)
            link = False
    return root


_ENDS = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in RAW}


def _pairs(page: str, at: int) -> dict[int, int]:
    """Where elements of RAW that may be nested end, by where they begin; those without an end tag are not there."""
    out: dict[int, int] = {}
    opened: dict[str, list[int]] = {t: [] for t in RAW}
    endless = set()
    while m := _TOKEN.search(page, at):
        at, tag = m.end(), (m[2] or "").lower()
        if tag not in RAW:
            continue
        if tag in HIDES:
            if m[1] or tag in endless:
                continue
            if end := _ENDS[tag].search(page, at):
                at = end.end()
            else:
                endless.add(tag)
        elif m[1]:
            if opened[tag]:
                out[opened[tag].pop()] = at
        else:
            opened[tag].append(m.start())
    return out


def nodes_of(root: Node) -> list[Node]:
    """In page order, parents first."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        n.at = len(out)
        out.append(n)
        todo.extend(reversed([x for x in n.items if isinstance(x, Node)]))
    return out


def own_text(n: Node) -> str:
    """The text of a node's own runs, with character references decoded."""
    return html_lib.unescape("".join(x[0] if not isinstance(x, Node) else "\n" for x in n.items))


N_FEATURES = 19 + 2 * len(TOKENS) + 2 * len(TAGS)


def features(nodes: list[Node]) -> np.ndarray:
    """A row per node: subtree and own densities, place, siblings, tags and attribute words of node and ancestors."""
    n = len(nodes)
    x = np.zeros((n, N_FEATURES), dtype=np.float32)
    chars, words, links, stops, tags = (np.zeros(n) for _ in range(5))
    up = np.array([m.up.at if m.up else -1 for m in nodes])
    own_chars = np.zeros(n)
    groups = list(TOKENS)
    tokens = np.zeros((n, len(groups)), dtype=bool)
    kinds = np.zeros((n, len(TAGS)), dtype=bool)
    kids, place = np.zeros(n), np.zeros(n)
    for i, m in enumerate(nodes):
        for t in m.items:
            if isinstance(t, Node):
                kids[i] += 1
                place[t.at] = kids[i]
            else:
                size = len(t[0]) - t[0].count(" ") if t[0].strip() else 0
                chars[i] += size
                if size:
                    words[i] += t[0].count(" ") + 1
                    stops[i] += t[0].count(". ") + t[0].count(",")
                if t[1]:
                    links[i] += size
        if m.tag in TAGS:
            kinds[i, TAGS.index(m.tag)] = True
        if m.attrs:
            for k, v in _ATTR.findall(m.attrs):
                if k.lower() in ("class", "id", "role", "aria-label", "itemprop", "data-component", "data-testid"):
                    for w in _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", v).lower()):
                        if w in _GROUP:
                            tokens[i, groups.index(_GROUP[w])] = True
        tags[i] = 1
    own_chars[:] = chars
    for a in (chars, words, links, stops, tags):  # sums over subtrees
        for i in range(n - 1, 0, -1):
            a[up[i]] += a[i]
    total = max(1.0, chars[0])
    above_t, above_k = tokens.copy(), kinds.copy()
    for i in range(1, n):
        above_t[i] |= above_t[up[i]]
        above_k[i] |= above_k[up[i]]
    p = np.maximum(up, 0)
    depth = np.array([m.depth for m in nodes])
    leaves = np.bincount(p[1:], weights=chars[1:], minlength=n) if n > 1 else np.zeros(n)
    place_page = np.arange(n) / max(1, n - 1)
    cols = [
        np.log1p(chars), np.log1p(words), np.log1p(own_chars), links / np.maximum(chars, 1), chars / np.maximum(tags, 1), stops / np.maximum(words, 1),
        chars / total, depth, kids, place, kids[p], place_page, chars / np.maximum(chars[p], 1), np.log1p(chars[p]), links[p] / np.maximum(chars[p], 1),
        np.log1p(leaves / np.maximum(kids, 1)), chars[p] / total, np.append(np.log1p(chars[1:]), 0), np.append(0, np.log1p(chars[:-1])),
    ]
    x[:, : len(cols)] = np.stack(cols, axis=1)
    x[:, len(cols) :] = np.concatenate([tokens, above_t, kinds, above_k], axis=1)
    return x


class Boosted:
    """Gradient-boosted regression trees for the logistic loss, on binned features."""

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        b = self._bin(x)
        self.start = float(np.log((y * weight).sum() / ((1 - y) * weight).sum()))
        f, self.trees = np.full(len(y), self.start), []
        rng = np.random.default_rng(SEED)
        for _ in range(TREES):
            q = 1 / (1 + np.exp(-f))
            some = np.flatnonzero(rng.random(len(y)) < SHARE)
            tree = self._tree(b[some], (weight * (y - q))[some], (weight * q * (1 - q))[some])
            self.trees.append(tree)
            f += self._leaf(tree, b)
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def _tree(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m, d = (1 << DEPTH + 1) - 1, b.shape[1]
        feature, cut, value = np.full(m, -1), np.zeros(m, np.int64), np.zeros(m)
        node = np.zeros(len(g), np.int64)
        for level in range(DEPTH + 1):
            for k in range((1 << level) - 1, (1 << level + 1) - 1):
                own = np.flatnonzero(node == k)
                if not len(own):
                    continue
                gs, hs = g[own].sum(), h[own].sum()
                value[k] = RATE * gs / (hs + 1.0)
                if level == DEPTH or len(own) < 20:
                    continue
                flat = (b[own] + np.arange(d, dtype=np.int32) * BINS).ravel()
                gl = np.bincount(flat, np.repeat(g[own], d), d * BINS).reshape(d, BINS).cumsum(axis=1)
                hl = np.bincount(flat, np.repeat(h[own], d), d * BINS).reshape(d, BINS).cumsum(axis=1)
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(hl < 0.5) | (hs - hl < 0.5)] = 0
                j, c = divmod(int(gain.argmax()), BINS)
                if gain[j, c] > 1e-3:
                    feature[k], cut[k] = j, c
                    node[own] = 2 * k + 1 + (b[own, j] > c)
        return feature, cut, value

    @staticmethod
    def _leaf(tree: tuple[np.ndarray, np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node, rows = np.zeros(len(b), np.int64), np.arange(len(b))
        for _ in range(DEPTH):
            j = feature[node]
            node = np.where(j >= 0, 2 * node + 1 + (b[rows, np.maximum(j, 0)] > cut[node]), node)
        return value[node]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        return self.start + sum(self._leaf(t, b) for t in self.trees)


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Which nodes are content: the likeliest choice in which nothing below a left-out node is kept."""
    n = len(nodes)
    keep_all = -np.logaddexp(0, -odds)  # log P(content)
    leave = -np.logaddexp(0, odds)
    below_left = leave.copy()
    kept = keep_all.copy()
    up = [m.up.at if m.up else -1 for m in nodes]
    take = np.zeros(n, dtype=bool)
    for i in range(n - 1, -1, -1):
        take[i] = kept[i] >= below_left[i] or i == 0
        if i:
            kept[up[i]] += max(kept[i], below_left[i])
            below_left[up[i]] += below_left[i]
    for i in range(1, n):
        take[i] &= take[up[i]]
    return take


def text_of(nodes: list[Node], take: np.ndarray) -> str:
    """Own runs of the nodes taken, in page order; white space inside a block is one space, and so is a block's end."""
    out: list[str] = []

    def run(parts: list[str]) -> None:
        s = _SPACE.sub(" ", html_lib.unescape("".join(parts))).strip()
        if s:
            out.append(s)

    todo: list = [(nodes[0], 0, [])]
    while todo:
        node, k, parts = todo.pop()
        items = node.items
        while k < len(items):
            x = items[k]
            k += 1
            if isinstance(x, Node):
                run(parts)
                parts = []
                if take[x.at]:
                    todo += [(node, k, parts), (x, 0, [])]
                    break
            else:
                parts.append(x[0])
        else:
            run(parts)
    return " ".join(out)


# -- pages to learn from: templates with known main text ------------------------------------------------------------

_SYL = "ba re ti lo mun ka ser di ve no pra tel go shi lu en or as eth ing".split()


def made_page(rng: random.Random) -> str:
    """A page of a random design whose nodes say (data-y) whether they belong to the main text."""

    def word() -> str:
        return "".join(rng.choice(_SYL) for _ in range(rng.randint(1, 4)))

    def words(a: int, b: int) -> str:
        s = [word() for _ in range(rng.randint(a, b))]
        return " ".join(w + rng.choice(["", "", "", "", ",", "."]) for w in s).capitalize() + rng.choice([".", ".", ""])

    out: list[str] = []

    def name(group: str) -> str:
        if rng.random() < 0.4:
            return ""
        w = rng.choice(TOKENS[group].split())
        w = rng.choice([w, f"{w}-{word()}", f"{word()}-{w}", f"site-{w}"])
        return f' {rng.choice(["class", "class", "id"])}="{w}"'

    def put(tag: str, main: bool, attrs: str, body: str | list) -> str:
        mark = "1" if main else "0"
        inner = body if isinstance(body, str) else "".join(body)
        return f"<{tag} data-y={mark}{attrs}>{inner}</{tag}>"

    def links(k: int) -> str:
        return "".join(put("li", False, "", f'<a href="/{word()}">{words(1, 4)}</a>') for _ in range(k))

    def menu() -> str:
        return put(rng.choice(["nav", "nav", "div", "ul"]), False, name("menu"), put("ul", False, "", links(rng.randint(2, 12))))

    def para(main: bool, a: int = 4, b: int = 90) -> str:
        s = words(a, b)
        if rng.random() < 0.3:
            s = f"<b>{s}</b>" + rng.choice(["", "<br>"]) + words(3, 20)
        if rng.random() < 0.2:
            s += f' <a href="/{word()}">{words(1, 3)}</a> ' + words(1, 8)
        return put("p", main, "", s)

    def boiler(group: str, tags: list[str]) -> str:
        kind = rng.random()
        body = words(2, 25) if kind < 0.4 else para(False, 3, 25) * rng.randint(1, 2) if kind < 0.7 else put("ul", False, "", links(rng.randint(2, 6)))
        tag = rng.choice(tags)
        attrs = name(group)
        if tag in ("div", "section", "p", "ul") and not attrs:
            attrs = f' class="{rng.choice(TOKENS[group].split())}"'
        return put(tag, False, attrs, body)

    def content() -> str:
        parts = []
        if rng.random() < 0.8:
            parts.append(put(rng.choice(["h1", "h1", "h2"]), True, "", words(2, 12)))
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8, 15])):
            r = rng.random()
            if r < 0.75:
                parts.append(para(True))
            elif r < 0.82:
                parts.append(put("h2", True, "", words(1, 6)))
            elif r < 0.88:
                parts.append(put(rng.choice(["ul", "ol"]), True, "", "".join(put("li", True, "", words(2, 15)) for _ in range(rng.randint(1, 6)))))
            elif r < 0.91:
                parts.append(put("blockquote", True, "", para(True, 5, 30)))
            elif r < 0.94:
                parts.append(put("table", True, "", "".join(put("tr", True, "", "".join(put("td", True, "", words(1, 4)) for _ in range(3))) for _ in range(rng.randint(1, 4)))))
            elif r < 0.97:
                parts.append(boiler("advert", ["div", "aside"]))
            else:
                parts.append(boiler(rng.choice(["share", "side", "notice"]), ["div", "aside"]))
        if len(parts) < 2:
            parts.append(para(True, 8, 60))
        body = "".join(parts)
        if rng.random() < 0.08:  # straight in the page
            return body
        r = rng.random()
        if r < 0.55:
            return put("article", True, name("main") if rng.random() < 0.3 else "", body)
        if r < 0.7:
            return put("main", True, "", put("article", True, "", body) if rng.random() < 0.5 else body)
        return put(rng.choice(["div", "section", "div"]), True, f' {rng.choice(["class", "id"])}="{rng.choice(TOKENS["main"].split())}"', body)

    if rng.random() < 0.05:  # nothing else
        return f"<html><body>{content()}</body></html>"
    if rng.random() < 0.5:
        out.append(put("header", False, name("head"), words(1, 8) + (menu() if rng.random() < 0.5 else "")))
    if rng.random() < 0.85:
        out.append(menu())
    for group, tags, chance in (("notice", ["div", "section"], 0.25), ("advert", ["div", "div", "aside"], 0.5), ("side", ["aside", "div"], 0.2), ("form", ["form", "div"], 0.15)):
        if rng.random() < chance:
            out.append(boiler(group, tags))
    out.append(content())
    for group, tags, chance in (("side", ["aside", "div", "section"], 0.4), ("advert", ["div", "aside"], 0.25), ("form", ["form"], 0.2)):
        if rng.random() < chance:
            out.append(boiler(group, tags))
    if rng.random() < 0.35:
        notes = "".join(put(rng.choice(["div", "li", "article"]), False, ' class="comment"', para(False, 4, 40)) for _ in range(rng.randint(1, 6)))
        out.append(put(rng.choice(["section", "div"]), False, f' {rng.choice(["class", "id"])}="{rng.choice(["comments", "discussion", "replies", "comment-list"])}"', notes))
    if rng.random() < 0.9:
        out.append(put(rng.choice(["footer", "footer", "div"]), False, rng.choice(['', ' class="footer"']) if rng.random() < 0.5 else ' id="footer"', "&copy; " + words(2, 16) + (put("ul", False, "", links(3)) if rng.random() < 0.3 else "")))
    body = "".join(out)
    if rng.random() < 0.3:
        body = put("div", True, f' class="{rng.choice(["page", "wrapper", "container", word()])}"', body)
    if rng.random() < 0.3:
        body = body.replace("</p>", "").replace("</li>", "")
    page = f"<!DOCTYPE html><html><head><title>{words(2, 9)}</title><style>p{{margin:0}}</style></head><body>{body}</body></html>"
    if rng.random() < 0.1:
        page = page[: int(len(page) * rng.uniform(0.6, 1))]
    return page


@cache
def model(pages: int = TRAIN_PAGES, seed: int = SEED) -> Boosted:
    """Trees fitted on made pages, since no page comes with its main text marked. The same wherever it is called."""
    rng, xs, ys, ws = random.Random(seed), [], [], []
    for _ in range(pages):
        nodes = nodes_of(parse(made_page(rng)))
        x = features(nodes)
        y = np.array([i == 0 or "data-y=1" in m.attrs for i, m in enumerate(nodes)], dtype=np.float64)
        xs.append(x[1:])
        ys.append(y[1:])
        ws.append(1 / np.sqrt(1 + np.array([len(nodes)] * (len(nodes) - 1))))
    return Boosted().fit(np.concatenate(xs), np.concatenate(ys), np.concatenate(ws))


def extract(pages: list[str], trees: Boosted) -> list[str]:
    """Main texts of pages."""
    trees_of = [nodes_of(parse(p)) for p in pages]
    if not trees_of:
        return []
    odds = trees.log_odds(np.concatenate([features(t) for t in trees_of]))
    out, at = [], 0
    for t in trees_of:
        out.append(text_of(t, decode(t, odds[at : at + len(t)])))
        at += len(t)
    return out


def extract_pages(pages: DataFrame, column: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each row of pages; the html is read whole, however long or deeply nested. A null or
    empty page has an empty text, and text without any markup is main text. Where keeping and leaving out are equally
    likely, a node is kept. Repeated rows come out alike; other columns of pages are left behind."""
    small_batches(pages.sparkSession)
    trees = model()
    broadcast = pages.sparkSession.sparkContext.broadcast(trees)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html", 2 << 20):
            texts = extract(part.column("html").to_pylist(), broadcast.value)
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.coalesce(F.col(column), F.lit("")).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages; a null or empty one has none, long ones are read whole, repeated rows come out alike."""
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
