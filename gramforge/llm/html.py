"""Main text of web pages: gradient-boosted trees over the features of DOM nodes, decoded along the tree.

A tolerant reader makes a node of every block element and keeps the text runs between them. Trees score each node from its
tag, its attribute tokens and those above it, depth, text and link density of its subtree, and its siblings. Decoding
takes the best labelling in which a page goes outside -> main -> excluded from the root down and never back: what stands in
an excluded node is excluded, what is main has one way in.

Pages have no labels. The fit takes a bounded sample of pages, labelled by their own semantic elements where they have
them, and lays their blocks out anew in made page layouts (other containers, class names, notices, adverts, comments,
side columns), whose labels are known, so that the trees don't rest on one template.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramforge.llm.bytescan import slices
from gramforge.llm.runtime import ship_code

#: The fit's bounds: pages (drawn by a hash of id and url), code points of each that are read, layouts made of each.
FIT_PAGES, FIT_CHARS, LAYOUTS = 120, 40_000, 6
TREES, DEPTH, BINS, RATE = 60, 4, 32, 0.25
#: Cost of going from outside into main and from main into excluded, in logits; the largest logit of a node.
ENTER, LEAVE, MOST_LOGIT = 2.0, 1.0, 6.0

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>?""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|data-y|hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
TAGS = "article main nav header footer aside form section div p h1 h2 h3 h4 h5 h6 ul ol dl li dt dd table thead tbody tfoot tr td th caption figure figcaption blockquote pre body html address details summary fieldset legend hr center dialog menu hgroup".split()
TAG = {t: k for k, t in enumerate(TAGS)}
DEAD = frozenset("svg template noscript select datalist button object canvas audio video map".split())
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
CONTROLS = frozenset("input button select textarea label option".split())
VOID = frozenset(["hr"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: start tag -> (what it closes, where the search for that ends)
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), **{t: ({"thead", "tbody", "tfoot"}, {"table"}) for t in ("thead", "tbody", "tfoot")}}
#: Groups of attribute tokens; a token counts if it is a word of a group or begins with one that ends in *.
GROUPS = {
    "content": "article* post* entry* content* body main story* text prose page",
    "menu": "nav* menu* breadcrumb* tab tabs pager pagination toc links skip",
    "head": "header* masthead banner* top logo brand hero",
    "foot": "foot* bottom copyright legal colophon",
    "side": "side* aside widget* related recommend* popular trending more rail",
    "advert": "ad ads adv advert* sponsor* promo* adsense dfp outbrain taboola",
    "notice": "notice* cookie* consent gdpr alert* popup modal newsletter subscri* overlay toast paywall banner*",
    "comment": "comment* reply replies disqus discussion respond* feedback",
    "tools": "share* social login search* form* hidden print tags meta button* follow",
}
ORDER = list(GROUPS)
HIDDEN = 1 << len(GROUPS)


@lru_cache(65_536)
def attribute_bits(attributes: str) -> tuple[int, int]:
    """The groups that an element's tokens are of, as bits, and its label in a made layout (-1: none)."""
    bits, label = 0, -1
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "data-y":
            label = int(value) if value in ("0", "1") else -1
        elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            bits |= HIDDEN
        elif name != "style":
            for token in PIECE.findall(value):
                bits |= _token_bits(token.lower())
    return bits, label


@lru_cache(65_536)
def _token_bits(token: str) -> int:
    return sum(1 << k for k, words in enumerate(GROUPS.values()) if any(token.startswith(w[:-1]) if w.endswith("*") else token == w for w in words.split()))


class Nodes:
    """The block elements of some pages in document order, and their text runs. Node lists grow by page."""

    def __init__(self) -> None:
        self.tag: list[int] = []
        self.parent: list[int] = []
        self.end: list[int] = []
        self.depth: list[int] = []
        self.bits: list[int] = []
        self.label: list[int] = []
        self.chars: list[int] = []
        self.linked: list[int] = []
        self.marks: list[int] = []
        self.words: list[int] = []
        self.controls: list[int] = []
        #: (node, block, text) by page
        self.pages: list[list[tuple[int, int, str]]] = []
        self.roots: list[int] = []

    def _open(self, tag: str, parent: int, depth: int, attributes: str) -> int:
        bits, label = attribute_bits(attributes) if attributes and not attributes.isspace() else (0, -1)
        for values, x in ((self.tag, TAG.get(tag, len(TAGS))), (self.parent, parent), (self.end, 0), (self.depth, depth), (self.bits, bits), (self.label, label), (self.chars, 0), (self.linked, 0), (self.marks, 0), (self.words, 0), (self.controls, 0)):
            values.append(x)
        return len(self.tag) - 1

    def read(self, page: str) -> None:
        """Adds one page. What isn't closed ends with its parent or the page, end tags of nothing open are passed over."""
        root = self._open("body", -1, 0, "")
        stack: list[tuple[str, int]] = [("body", root)]
        opened: dict[str, int] = {}
        runs: list[tuple[int, int, str]] = []
        block, at, link, link_depth, dead, dead_depth = 0, 0, False, 0, "", 0

        def pop() -> None:
            nonlocal link
            tag, node = stack.pop()
            opened[tag] -= 1
            self.end[node] = len(self.tag)
            if link and link_depth > len(stack):
                link = False

        def close(targets: set[str], stops: set[str]) -> None:
            k = len(stack) - 1
            while k > 0 and stack[k][0] not in targets and stack[k][0] not in stops:
                k -= 1
            if k > 0 and stack[k][0] in targets:
                while len(stack) > k:
                    pop()

        def text(raw: str) -> None:
            if not raw or dead:
                return
            node = stack[-1][1]
            if raw.isspace():
                runs.append((node, block, " "))
                return
            if "&" in raw:
                raw = references.unescape(raw)
            runs.append((node, block, raw))
            n = len(raw)
            self.chars[node] += n
            if link:
                self.linked[node] += n
            self.words[node] += raw.count(" ") + 1
            self.marks[node] += raw.count(".") + raw.count(",") + raw.count(";") + raw.count("!") + raw.count("?")

        size = len(page)
        while at < size:
            m = TOKEN.search(page, at)
            if m is None:
                break
            text(page[at : m.start()])
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                if dead:
                    if tag == dead:
                        dead_depth -= 1
                        dead = dead if dead_depth else ""
                elif tag == "a":
                    link = False
                elif opened.get(tag, 0):
                    while stack[-1][0] != tag:
                        pop()
                    pop()
                    block += tag not in ("td", "th")
                continue
            if tag in RAW:
                stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
                at = stop.end() if stop else size
                self.controls[stack[-1][1]] += tag == "textarea"
                continue
            if dead:
                dead_depth += tag == dead
                continue
            if tag in CONTROLS:
                self.controls[stack[-1][1]] += 1
            if tag in DEAD:
                if not m[3].rstrip().endswith("/"):
                    dead, dead_depth = tag, 1
                continue
            if tag not in TAG:
                if tag == "br":
                    text(" ")
                elif tag == "a":
                    link, link_depth = True, len(stack)
                continue
            if tag in ("html", "body"):
                self.bits[root] |= attribute_bits(m[3])[0]
                continue
            cell = tag in ("td", "th")
            if opened.get("p", 0):
                close({"p"}, {"td", "th", "table", "caption"} if tag == "p" else {"td", "th", "caption"})
            if tag in CLOSES:
                close(*CLOSES[tag])
            elif tag in HEADINGS and stack[-1][0] in HEADINGS:
                pop()
            if cell:
                text(" ")
            else:
                block += 1
            node = self._open(tag, stack[-1][1], len(stack), m[3])
            if tag in VOID:
                self.end[node] = node + 1
                continue
            stack.append((tag, node))
            opened[tag] = opened.get(tag, 0) + 1
        text(page[at:])
        opened["body"] = 1
        while stack:
            pop()
        self.pages.append(runs)
        self.roots.append(root)

    def arrays(self) -> dict[str, np.ndarray]:
        return {k: np.array(getattr(self, k), np.int64) for k in ("tag", "parent", "end", "depth", "bits", "label", "chars", "linked", "marks", "words", "controls")}


def _levels(depth: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)


def features(a: dict[str, np.ndarray]) -> np.ndarray:
    """A row of features for each node; pages don't mix."""
    n = len(a["tag"])
    tag, parent, end, own = a["tag"], a["parent"], a["end"], np.arange(n)
    up = np.where(parent < 0, own, parent)
    sums = lambda v: (c := np.concatenate([[0], np.cumsum(v)]))[end] - c[own]  # noqa: E731  over the subtree
    is_ = lambda *names: np.isin(tag, [TAG[x] for x in names])
    kinds = [is_("article"), is_("main"), is_("nav", "menu"), is_("header"), is_("footer"), is_("aside"), is_("form", "fieldset"), is_("section"), is_("div"), is_("p"), is_(*HEADINGS), is_("ul", "ol", "dl"), is_("li", "dt", "dd"), is_("table", "tr", "td", "th", "tbody", "thead"), is_("figure", "figcaption"), is_("blockquote", "pre"), is_("body")]
    groups = len(GROUPS) + 1
    mine = a["bits"] | sum(k.astype(np.int64) << (groups + j) for j, k in enumerate(kinds[:7]))
    over = mine.copy()
    levels = _levels(a["depth"])
    for level in levels[1:]:
        over[level] |= over[parent[level]]
    above = np.where(parent < 0, 0, over[up])
    bit = lambda v, k: (v >> k) & 1
    chars, nodes = sums(a["chars"]), end - own
    linked, words, marks, controls = sums(a["linked"]), sums(a["words"]), sums(a["marks"]), sums(a["controls"])
    share = lambda x, y: x / np.maximum(y, 1)
    root = own.copy()
    for level in levels[1:]:
        root[level] = root[parent[level]]
    before = np.concatenate([[0], np.cumsum(a["chars"])])[own]
    order = np.lexsort((own, parent))
    same = np.zeros(n, bool)
    same[1:] = (parent[order][1:] == parent[order][:-1]) & (parent[order][1:] >= 0)
    prev, nxt = np.full(n, -1), np.full(n, -1)
    prev[order[1:][same[1:]]] = order[:-1][same[1:]]
    nxt[order[:-1][same[1:]]] = order[1:][same[1:]]
    starts = np.maximum.accumulate(np.where(same, 0, own))
    place = np.empty(n, np.int64)
    place[order] = own - starts
    has_parent = parent >= 0
    siblings = np.bincount(parent[has_parent], minlength=n)[up]
    alike = np.zeros(n)
    key = up * (len(TAGS) + 1) + tag
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    alike = counts[inverse]
    density, links = share(chars, nodes), share(linked, chars)
    beside = lambda at, v: np.where(at < 0, -1, v[np.maximum(at, 0)])
    log = np.log1p
    columns = [
        *kinds,
        *[bit(a["bits"], k) for k in range(groups)],
        *[bit(above, k) for k in range(groups + 7)],
        a["depth"], log(nodes), log(a["chars"]), log(chars), links, log(density), share(words, nodes), share(marks, words), share(chars, words),
        controls, share(controls, nodes), sums(kinds[9]), share(sums(kinds[9]), nodes), sums(kinds[12]), sums(kinds[10]), share(chars, chars[root]), share(chars, chars[up]),
        share(before - before[root], chars[root]), place, siblings, share(place, siblings), share(alike, siblings),
        beside(prev, log(chars)), beside(nxt, log(chars)), beside(prev, links), beside(nxt, links), links[up], log(density)[up],
    ]
    return np.stack([np.asarray(c, np.float32) for c in columns], axis=1)


class Trees:
    """Boosted trees of a fixed depth under the log loss, fitted on binned features."""

    def __init__(self) -> None:
        inner = (1 << DEPTH) - 1
        self.feature = np.zeros((0, inner), np.int64)
        self.cut = np.zeros((0, inner), np.float32)
        self.leaf = np.zeros((0, inner + 1), np.float32)
        self.prior = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        """Columns are cut at quantiles. One class alone leaves its prior."""
        if not len(y):
            return self
        rate = float(y.mean())
        self.prior = float(np.log((rate * len(y) + 0.5) / ((1 - rate) * len(y) + 0.5)))
        if y.min() == y.max():
            return self
        cuts = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS, method="lower")) for c in x.T]
        codes = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])  # code > k: value > cut k
        score = np.full(len(y), self.prior)
        trees = []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p) + 1e-6
            at = np.zeros(len(y), np.int64)
            feature, cut = np.zeros((1 << DEPTH) - 1, np.int64), np.full((1 << DEPTH) - 1, np.inf, np.float32)
            for d in range(DEPTH):
                width = 1 << d
                gain = np.zeros((len(cuts), width))
                best = np.zeros((len(cuts), width), np.int64)
                for f in range(len(cuts)):
                    if not len(cuts[f]):
                        continue
                    slot = at * BINS + codes[f]
                    left_g = np.cumsum(np.bincount(slot, g, width * BINS).reshape(width, BINS), axis=1)
                    left_h = np.cumsum(np.bincount(slot, h, width * BINS).reshape(width, BINS), axis=1)
                    all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                    worth = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g**2 / (all_h + 1)
                    worth = worth[:, : len(cuts[f])]
                    best[f] = worth.argmax(axis=1)
                    gain[f] = worth.max(axis=1)
                chosen = gain.argmax(axis=0)
                k = best[chosen, np.arange(width)]
                first = width - 1
                feature[first : first + width] = chosen
                cut[first : first + width] = [cuts[f][j] if gain[f, w] > 1e-9 else np.inf for w, (f, j) in enumerate(zip(chosen, k, strict=True))]
                at = 2 * at + (x[np.arange(len(y)), chosen[at]] > cut[first + at])
            leaf = -RATE * np.bincount(at, g, 1 << DEPTH) / (np.bincount(at, h, 1 << DEPTH) + 1)
            score += leaf[at]
            trees.append((feature, cut, leaf))
        self.feature, self.cut, self.leaf = (np.stack([t[k] for t in trees]) for k in range(3))
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.prior), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for d in range(DEPTH):
                first = (1 << d) - 1
                at = 2 * at + (x[rows, feature[first + at]] > cut[first + at])
            out += leaf[at]
        return out


def decode(logit: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Which nodes are main in the best labelling outside -> main -> excluded along every way down: a main node earns its
    logit, going in costs ENTER, going out LEAVE."""
    s = logit.clip(-MOST_LOGIT, MOST_LOGIT)
    main, outside = s.copy(), np.zeros(len(s))
    levels = _levels(depth)
    for level in reversed(levels[1:]):
        np.add.at(main, parent[level], np.maximum(main[level], -LEAVE))
        np.add.at(outside, parent[level], np.maximum(outside[level], main[level] - ENTER))
    state = np.zeros(len(s), np.int8)  # 0 outside, 1 main, 2 excluded
    for k, level in enumerate(levels):
        if not len(level):
            continue
        over = state[parent[level]] if k else np.zeros(len(level), np.int8)
        into = (over == 0) & (main[level] - ENTER > outside[level])
        stay = (over == 1) & (main[level] >= -LEAVE)
        state[level] = np.where(into | stay, 1, np.where(over == 0, 0, 2))
    return state == 1


def semantic_labels(a: dict[str, np.ndarray]) -> np.ndarray:
    """Labels that a page's own elements give: within article or main, and within nothing else that is set apart. Pages
    without such elements have -1 everywhere."""
    tag, parent = a["tag"], a["parent"]
    apart = np.isin(tag, [TAG[t] for t in ("nav", "footer", "aside", "form", "menu")]) | ((a["bits"] & sum(1 << ORDER.index(g) for g in ("advert", "comment", "notice"))) > 0)
    main = np.isin(tag, [TAG["article"], TAG["main"]])
    within, out, root = main.copy(), apart.copy(), np.arange(len(tag))
    for level in _levels(a["depth"])[1:]:
        within[level] |= within[parent[level]]
        out[level] |= out[parent[level]]
        root[level] = root[parent[level]]
    known = np.bincount(root, main, len(tag))[root] > 0
    return np.where(known, (within & ~out).astype(np.int64), -1)


def _layout(g: np.random.Generator, title: str, paragraphs: list[str], spare: list[str]) -> str:
    """One page around some paragraphs, its elements marked main (1) or not (0). Containers, names, depths and what stands
    around them are drawn."""
    pick = lambda xs: xs[int(g.integers(len(xs)))]
    some = lambda p: g.random() < p
    short = lambda: " ".join(pick(spare).split()[: int(g.integers(1, 5))]) or "x"
    long = lambda: " ".join(pick(spare).split()[: int(g.integers(6, 60))]) or "x"

    def el(tag: str, inner: str, y: int, names: str = "", by: str = "class") -> str:
        named = f' {by}="{names}"' if names and some(0.9) else ""
        return f'<{tag}{named} data-y="{y}">{inner}</{tag}>'

    links = lambda n: el("ul", "".join(el("li", f'<a href="/">{short()}</a>', 0) for _ in range(n)), 0)
    bare = lambda n: " ".join(f'<a href="/">{short()}</a>' for _ in range(n))
    menu = lambda: el(pick(["nav", "div", "div", "section"]), links(int(g.integers(3, 12))) if some(0.8) else bare(5), 0, pick(["nav", "menu", "main-menu", "navbar", "breadcrumbs", "topmenu"]))
    advert = lambda: el(pick(["div", "div", "aside", "section"]), pick([long, short])() if some(0.6) else el("p", long(), 0), 0, pick(["ad", "ads", "advert", "ad-slot", "sponsored", "promo"]), pick(["class", "class", "id"]))
    notice = lambda: el(pick(["div", "section", "aside"]), el("p", long(), 0) + (el("p", bare(2), 0) if some(0.5) else ""), 0, pick(["cookie-notice", "notice", "consent", "alert", "newsletter", "popup"]), pick(["class", "id"]))
    form = lambda: el("form", f'<label>{short()}</label><input name="q"><button>{short()}</button>' + (el("p", long(), 0) if some(0.4) else ""), 0, pick(["search", "login", "subscribe", ""]))
    side = lambda: el(pick(["aside", "aside", "div", "section"]), el(pick(["h2", "h3", "h4"]), short(), 0) + "".join(el("p", long() if some(0.5) else f'<a href="/">{long()}</a>', 0) for _ in range(int(g.integers(1, 5)))) + (links(4) if some(0.5) else ""), 0, pick(["sidebar", "side", "widget", "related", "recommended", "popular"]), pick(["class", "id"]))
    comment = lambda: el(pick(["div", "li", "article"]), el(pick(["p", "div"]), short(), 0) + "".join(el("p", long(), 0) for _ in range(int(g.integers(1, 4)))), 0, pick(["comment", "comment-body", "reply"]))
    comments = lambda: el(pick(["section", "div", "div"]), (el("h3", short(), 0) if some(0.7) else "") + "".join(comment() for _ in range(int(g.integers(1, 6)))) + (form() if some(0.4) else ""), 0, pick(["comments", "comment-list", "discussion", "responses"]), pick(["class", "id"]))
    tools = lambda: el("div", bare(4), 0, pick(["share", "social", "tags", "meta-links"]))
    head = lambda: el(pick(["header", "header", "div"]), (el(pick(["h1", "p", "div"]), short(), 0) if some(0.6) else "") + (menu() if some(0.7) else el("p", long(), 0)) + (form() if some(0.3) else ""), 0, pick(["header", "masthead", "site-header", "top"]), pick(["class", "id"]))
    foot = lambda: el(pick(["footer", "footer", "div"]), pick([lambda: "&copy; " + long(), lambda: el("p", long(), 0) + links(4), lambda: bare(4)])(), 0, pick(["footer", "site-footer", "colophon", "bottom"]), pick(["class", "id"]))

    inner: list[str] = [el(pick(["h1", "h1", "h2"]), title, 1, pick(["", "title", "entry-title"]))] if some(0.9) else []
    if inner and some(0.15):
        inner = [el("header", inner[0] + (el("p", long(), 1) if some(0.5) else ""), 1, pick(["entry-header", "", "post-header"]))]
    for p in paragraphs:
        kind = g.random()
        if kind < 0.8:
            inner.append(el("p", f"<b>{p}" if some(0.1) else p, 1))
        elif kind < 0.85:
            inner.append(el(pick(["h2", "h3"]), " ".join(p.split()[:6]) or "x", 1))
        elif kind < 0.9:
            inner.append(el("ul", "".join(el("li", x, 1) for x in re.split(r"(?<=\.) ", p)), 1))
        elif kind < 0.94:
            inner.append(el("blockquote", el("p", p, 1) if some(0.5) else p, 1))
        elif kind < 0.97:
            inner.append(el("div", p, 1))
        else:
            inner.append(el("table", el("tr", "".join(el("td", x, 1) for x in p.split()[:8]), 1), 1))
        if some(0.06):
            inner.append(pick([advert, tools, notice, side, form])())
    if some(0.2):
        inner.append(pick([comments, tools, side])())
    body = "".join(inner)
    kind = g.random()
    if kind < 0.35:
        body = el("article", body, 1, pick(["", "", "post", "hentry"]))
    elif kind < 0.5:
        body = el("main", body, 1, pick(["", "content"]))
    elif kind < 0.93:
        body = el(pick(["div", "div", "section"]), body, 1, pick(["content", "post", "entry-content", "article-body", "story", "text", "main", "post-content", "body", ""]), pick(["class", "class", "id"]))
    if some(0.2):
        body = el("div", body, 1, pick(["inner", "wrap", "container", "col-8"]))
    if some(0.4):
        body = el(pick(["div", "main", "section"]), "".join(x for x in ([side()] if some(0.2) else []) + [body] + ([side()] if some(0.5) else [])), 0, pick(["container", "wrapper", "row", "site", "page"]))
    before = [f() for f, p in ((notice, 0.25), (head, 0.6), (menu, 0.6), (advert, 0.5), (form, 0.15)) if some(p)]
    after = [f() for f, p in ((side, 0.3), (comments, 0.35), (advert, 0.3), (notice, 0.15), (foot, 0.85)) if some(p)]
    return f"<html><head><title>{title}</title></head><body>{''.join(before)}{body}{''.join(after)}</body></html>"


def fit(pages: list[str], seed: int = 11) -> Trees:
    """Trees fitted on some pages and the layouts made of their blocks; with no pages, on layouts of numbers as words."""
    g = np.random.Generator(np.random.PCG64(seed))
    original = Nodes()
    for page in pages:
        original.read(page)
    rows, labels = [], []
    stock: list[list[str]] = []
    if pages:
        a = original.arrays()
        y = semantic_labels(a)
        x = features(a)
        rows.append(x[y >= 0])
        labels.append(y[y >= 0])
        for root, runs in zip(original.roots, original.pages, strict=True):
            blocks = _blocks(runs, (y == 1) if y[root] >= 0 else np.ones(len(y), bool))
            stock.append([references.escape(b) for b in blocks])
    stock = [b for b in stock if b] or [[" ".join(str(k * j) for j in range(1, 30)) + "."] * 3 for k in range(3, 20)]
    spare = [b for blocks in stock for b in blocks]
    made = Nodes()
    for blocks in stock:
        for _ in range(LAYOUTS):
            own = [blocks[int(k)] for k in np.sort(g.choice(len(blocks), min(len(blocks), int(g.integers(1, 16))), replace=False))]
            made.read(_layout(g, " ".join(blocks[0].split()[:9]), own, spare))
    a = made.arrays()
    rows.append(features(a))
    labels.append(np.maximum(a["label"], 0))
    return Trees().fit(np.concatenate(rows), np.concatenate(labels).astype(np.float64))


def _blocks(runs: list[tuple[int, int, str]], main: np.ndarray) -> list[str]:
    """The texts of the blocks of main nodes, white space turned into single spaces; empty ones are left out."""
    out, at, held = [], None, []
    for node, block, text in runs:
        if block != at:
            out.append("".join(held))
            at, held = block, []
        if main[node]:
            held.append(text)
    out.append("".join(held))
    return [x for x in (" ".join(t.split()) for t in out) if x]


def main_texts(trees: Trees, pages: list[str | None]) -> list[str]:
    nodes = Nodes()
    for page in pages:
        nodes.read(page or "")
    if not pages:
        return []
    a = nodes.arrays()
    main = decode(trees.logits(features(a)), a["parent"], a["depth"])
    return ["\n\n".join(_blocks(runs, main)) for runs in nodes.pages]


def train(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rows: int = FIT_PAGES) -> Trees:
    """Trees fitted on at most `rows` pages, those of the least hashes of id and url (repeated rows count once), and of each on
    its first FIT_CHARS characters; null pages are left out."""
    known = pages.filter(F.col(html_col).isNotNull()).select(F.xxhash64(F.col(id_col), F.col(url_col)).alias("h"), F.col(html_col).alias("t"))
    # the hashes first, so that only the drawn pages' texts move
    drawn = [r["h"] for r in known.select("h").distinct().orderBy("h").limit(rows).collect()]
    if not drawn:
        return fit([])
    got = known.filter(F.col("h") <= drawn[-1]).select("h", F.substring("t", 1, FIT_CHARS).alias("t")).groupBy("h").agg(F.min("t").alias("t")).orderBy("h").collect()
    return fit([r["t"] for r in got])


def extract(pages: DataFrame, trees: Trees, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The id, url, text and n_chars of every row, from the whole html.

    Null and empty pages, and pages without main text, have empty text; pages of any length are read whole; repeated
    rows are alike; other columns are left out; an empty table gives no rows. Nothing is shuffled.
    """
    ship_code(pages.sparkSession)
    held = pages.sparkSession.sparkContext.broadcast(trees)
    id_type, url_type = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "html", 1 << 20):
            texts = main_texts(held.value, piece.column("html").to_pylist())
            yield pa.RecordBatch.from_arrays([piece.column("i"), piece.column("u"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return pages.select(F.col(id_col).alias("i"), F.col(url_col).alias("u"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, f"`{id_col}` {id_type}, `{url_col}` {url_type}, text string, n_chars long")
