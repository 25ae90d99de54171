"""Main text of web pages: a tree-structured graphical model over the nodes of the DOM.

A page becomes a tree: one node per block element, one leaf per run of text inside a block. Every node has a state -
``REST`` (menus, headers, footers, sidebars, notices, adverts, forms, comments), ``MAIN`` (the article), or ``MIXED`` (an
element that holds both). A log-linear model gives each node a potential from its own features, and each pair of parent
and child a potential that depends on the kind of the child. Sum-product messages go up from the leaves and down from the
root, one numpy step per depth for all pages of a batch, and give the marginal of every state at every node exactly, as
the graph is a tree. The text is that of the runs whose marginal of ``MAIN`` is at least one half.

Potentials are trained on labelled pages (``data-main`` marks the element that holds the article, ``data-rest`` what does
not belong to it) by gradient steps on the conditional likelihood of all states, whose gradient is the marginals again.
Pages are parsed and decided where they are read; nothing is shuffled.
"""

from __future__ import annotations

import html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REST, MAIN, MIXED = range(3)
STATES = 3

# Kinds of nodes, by element. Elements that are not listed belong to the text of the block around them.
KINDS = {
    "html": "page", "body": "page", "article": "article", "main": "main", "section": "section", "div": "div", "center": "div", "p": "p",
    "h1": "title", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "hgroup": "heading",
    "ul": "list", "ol": "list", "menu": "list", "dir": "list", "dl": "list", "li": "item", "dt": "item", "dd": "item",
    "table": "table", "caption": "row", "thead": "row", "tbody": "row", "tfoot": "row", "tr": "row", "td": "cell", "th": "cell",
    "blockquote": "quote", "pre": "quote", "figure": "figure", "figcaption": "figure", "header": "header", "footer": "footer", "nav": "nav",
    "aside": "aside", "form": "form", "fieldset": "form", "legend": "control", "button": "control", "select": "control", "optgroup": "control",
    "option": "control", "address": "address", "details": "details", "summary": "details", "dialog": "dialog", "search": "form",
}
KIND_NAMES = sorted({*KINDS.values(), "run"})
KIND_OF = {name: i for i, name in enumerate(KIND_NAMES)}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe noembed noframes xmp template svg math object audio video canvas".split())
# An open element of the first kind ends where one of the others begins.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "option": ({"option"}, {"select"}), "optgroup": ({"optgroup", "option"}, {"select"}),
    "body": ({"head"}, set()),
}

# Words in class, id and role attributes, by what they usually name.
WORD_GROUPS = {
    "main": "article content entry story post body main text page primary blog news",
    "menu": "nav navigation navbar menu menubar breadcrumb breadcrumbs tabs toc pagination pager skip topbar links toolbar",
    "header": "header head masthead logo brand branding banner hero top tagline",
    "footer": "footer foot bottom copyright legal colophon contentinfo credits imprint",
    "side": "sidebar side aside widget rail related recommended recommendations trending popular more secondary complementary teaser",
    "advert": "ad ads adv advert adverts advertisement adsense adsbygoogle sponsor sponsored promo promotion promoted dfp banner sponsoring",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup paywall disclaimer message dialog toast privacy",
    "comment": "comment comments reply replies respond disqus discussion thread feedback reviews commentlist responses",
    "form": "form login search signin register input field contact",
    "share": "share sharing social follow facebook twitter buttons",
    "meta": "meta byline author date time tags tag category info",
    "hidden": "hidden invisible",
    "wrap": "wrapper wrap container layout row column columns grid inner outer site app root",
}
WORD_OF = {}
for _i, (_name, _words) in enumerate(WORD_GROUPS.items()):
    for _word in _words.split():
        WORD_OF.setdefault(_word, []).append(_i)

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_OPEN = re.compile(r"<(?=[a-zA-Z/!?])")
_TAG_END = re.compile(r"[\s/]*>")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Page:
    """Nodes of one page in document order; a parent stands before its children."""

    __slots__ = ("parent", "kind", "words", "text", "chars", "linked", "marks")

    def __init__(self):
        self.parent, self.kind, self.words, self.text, self.chars, self.linked, self.marks = [], [], [], [], [], [], []

    def add(self, parent: int, kind: int, words: tuple = (), text: str | None = None, linked: int = 0, mark: int | None = None) -> int:
        self.parent.append(parent)
        self.kind.append(kind)
        self.words.append(words)
        self.text.append(text)
        self.chars.append(len(text) if text else 0)
        self.linked.append(linked)
        self.marks.append(mark)
        return len(self.parent) - 1


def parse(source: str) -> Page:
    """The tree of a page, by rules that also take pages with unclosed, misnested or cut-off tags.

    Contents of scripts, styles and embedded objects, comments and the head hold no text. Character references are decoded
    within each stretch of text, white space inside a run becomes one space.
    """
    page = Page()
    page.add(-1, KIND_OF["page"])
    stack, open_ = [("#page", 0)], {}
    pieces: list[str] = []
    link_from, linked, in_head = 0, 0, 0  # depth at which a link was opened; characters of the run inside links

    def flush():
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                page.add(stack[-1][1], KIND_OF["run"], (), text, min(linked, len(text)))
            pieces.clear()
        linked = 0

    def close(depth):
        nonlocal link_from
        flush()
        while len(stack) > depth:
            open_[stack.pop()[0]] -= 1
        if link_from > len(stack):
            link_from = 0

    at, size = 0, len(source)
    while at < size:
        found = _OPEN.search(source, at)
        stop = found.start() if found else size
        if stop > at and not in_head:
            piece = source[at:stop]
            piece = html.unescape(piece) if "&" in piece else piece
            pieces.append(piece)
            if link_from:
                linked += len(piece.strip())
        if not found:
            break
        at = stop + 1
        mark = source[at]
        if mark == "!" or mark == "?":
            ending = "-->" if source.startswith("!--", at) else "]]>" if source.startswith("![CDATA[", at) else ">"
            end = source.find(ending, at + (1 if ending == "-->" else 0))
            at = size if end < 0 else end + len(ending)
            continue
        closing = mark == "/"
        name = _NAME.match(source, at + closing)
        if not name:  # "</" before no name: dropped up to the next ">"
            end = source.find(">", at)
            at = size if end < 0 else end + 1
            continue
        at, tag = name.end(), name.group().lower()
        attributes = {}
        while not (end := _TAG_END.match(source, at)):
            if not (one := _ATTRIBUTE.match(source, at)) or one.end() == at:
                end = None
                break
            at = one.end()
            key = one.group(1).lower()
            if key not in attributes:
                attributes[key] = one.group(2) or one.group(3) or one.group(4) or ""
        at = end.end() if end else size
        if closing:
            if tag == "head":
                in_head = 0
            elif tag == "a":
                link_from = 0
            elif tag == "p" and not open_.get("p"):
                flush()
            elif open_.get(tag):
                depth = len(stack) - 1
                while stack[depth][0] != tag:
                    depth -= 1
                close(depth)
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(source, at)
            if not (source[at - 2:at] == "/>" and tag in ("svg", "math")):
                at = end.start() if end else size
            continue
        if tag == "head":
            in_head = 1
        elif tag == "a":
            link_from = len(stack)
        elif tag == "br":
            pieces.append(" ")
        elif tag == "hr":
            flush()
        if tag not in KINDS or tag in VOID:
            continue
        in_head = 0  # a block begins the body of a page without </head>
        if open_.get("p") and stack[-1][0] == "p":
            close(len(stack) - 1)
        if tag in ENDS:
            ends, until = ENDS[tag]
            if any(open_.get(e) for e in ends):
                depth = len(stack) - 1
                while depth > 0 and stack[depth][0] not in ends and stack[depth][0] not in until:
                    depth -= 1
                if depth > 0 and stack[depth][0] in ends:
                    close(depth)
        flush()
        if tag in ("html", "body"):
            continue  # their node is the root
        words = set()
        for key in ("class", "id", "role"):
            for word in _WORDS.findall(attributes.get(key, "")):
                words.update(WORD_OF.get(word.lower(), ()))
        if "hidden" in attributes or attributes.get("aria-hidden") == "true" or _HIDDEN.search(attributes.get("style", "")):
            words.update(WORD_OF["hidden"])
        label = MAIN if "data-main" in attributes else REST if "data-rest" in attributes else None
        stack.append((tag, page.add(stack[-1][1], KIND_OF[KINDS[tag]], tuple(sorted(words)), mark=label)))
        open_[tag] = open_.get(tag, 0) + 1
    flush()
    return page


class Forest:
    """The trees of several pages as flat arrays, ordered by depth, with the features of all nodes."""

    def __init__(self, pages: list[Page]):
        sizes = np.array([len(p.parent) for p in pages], np.int64)
        first = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(pages)), sizes)
        join = lambda name: np.concatenate([np.asarray(getattr(p, name), np.int64) for p in pages]) if pages else np.zeros(0, np.int64)
        parent = join("parent")
        parent = np.where(parent < 0, -1, parent + first[owner]) if len(parent) else parent
        self.kind, self.owner, self.parent, self.sizes = join("kind"), owner, parent, sizes
        self.levels = self._levels()
        chars, linked = join("chars"), join("linked")
        self.features = self._features(pages, chars, linked)

    def _levels(self) -> list[np.ndarray]:
        depth = np.zeros(len(self.parent), np.int64)
        open_ = np.flatnonzero(self.parent >= 0)
        up = self.parent.copy()
        while len(open_):  # every node climbs one step a round
            depth[open_] += 1
            up[open_] = self.parent[up[open_]]
            open_ = open_[up[open_] >= 0]
        order = np.argsort(depth, kind="stable")
        return np.split(order, np.cumsum(np.bincount(depth))[:-1]) if len(order) else []

    def totals(self, values: np.ndarray) -> np.ndarray:
        """Sums over the subtree of each node."""
        out = values.copy()
        for level in reversed(self.levels[1:]):
            np.add.at(out, self.parent[level], out[level])
        return out

    def _features(self, pages, chars, linked):
        """Pairs of node and feature: kind, words in attributes, sizes and places in classes."""
        nodes = len(self.kind)
        run = self.kind == KIND_OF["run"]
        below, links, parts = self.totals(chars), self.totals(linked), self.totals((self.kind == KIND_OF["p"]).astype(np.int64))
        whole = np.maximum(np.bincount(self.owner, chars, len(self.sizes)), 1)[self.owner] if nodes else np.zeros(0)
        before = np.cumsum(chars) - chars
        starts = np.cumsum(self.sizes) - self.sizes
        if nodes:
            before = before - before[starts][self.owner]
        share = np.where(below > 0, links / np.maximum(below, 1), 0.0)
        columns, self.names = [], []

        def one_of(name, classes, count, where=None):
            base = len(self.names)
            self.names += [f"{name}{i}" for i in range(count)]
            at = np.arange(nodes) if where is None else np.flatnonzero(where)
            columns.append((at, base + np.minimum(classes[at], count - 1)))

        one_of("kind", self.kind, len(KIND_NAMES))
        one_of("run size", np.log2(np.maximum(chars, 1)).astype(np.int64), 10, run)
        one_of("run links", np.digitize(share, [0.01, 0.34, 0.67, 0.99]), 5, run)
        ends = np.zeros(nodes, np.int64)
        signs = np.zeros(nodes, np.int64)
        position = 0
        for p in pages:
            for i, text in enumerate(p.text):
                if text:
                    ends[position + i] = 1 + (text[-1] in ".!?…:;\"'”»)")
                    signs[position + i] = "©" in text or "(c)" in text
            position += len(p.text)
        one_of("run ends", ends, 3, run)
        one_of("run sign", signs, 2, run)
        kind_of_parent = np.where(self.parent >= 0, self.kind[np.maximum(self.parent, 0)], 0) if nodes else self.kind
        one_of("run in", kind_of_parent, len(KIND_NAMES), run)
        one_of("below links", np.digitize(share, [0.01, 0.2, 0.5, 0.8]), 5, ~run & (below > 0))
        one_of("below share", np.digitize(below / np.maximum(whole, 1), [1e-9, 0.05, 0.2, 0.5, 0.8, 0.95]), 7, ~run)
        one_of("paragraphs", np.minimum(parts, 3), 4, ~run)
        one_of("place", np.digitize(before / np.maximum(whole, 1), [0.02, 0.1, 0.5, 0.9]), 5)
        base = len(self.names)
        self.names += [f"words {name}" for name in WORD_GROUPS]
        found, position = [], 0
        for p in pages:
            found += [(position + i, base + w) for i, words in enumerate(p.words) if words for w in words]
            position += len(p.words)
        extra = np.array(found, np.int64).reshape(-1, 2)
        columns.append((extra[:, 0], extra[:, 1]))
        return np.concatenate([c[0] for c in columns]), np.concatenate([c[1] for c in columns])

    def scores(self, weights: np.ndarray) -> np.ndarray:
        at, feature = self.features
        out = np.zeros((len(self.kind), STATES))
        for s in range(STATES):
            out[:, s] = np.bincount(at, weights[feature, s], len(self.kind))
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def sum_product(forest: Forest, weights: np.ndarray, edges: np.ndarray):
    """Marginals of the nodes, and of each node with its parent (parent's state first); all in logarithms."""
    own = forest.scores(weights)
    pair = edges[forest.kind]  # of a node with its parent
    up = np.zeros_like(own)  # the message from a node to its parent
    inside = own.copy()
    for level in reversed(forest.levels[1:]):
        up[level] = _log_sum(pair[level] + inside[level][:, None, :], axis=2)
        np.add.at(inside, forest.parent[level], up[level])
    down = np.zeros_like(own)  # the message from the parent
    joint = np.full((len(own), STATES, STATES), -np.inf)
    for level in forest.levels[1:]:
        parent = forest.parent[level]
        outer = inside[parent] + down[parent] - up[level]
        both = pair[level] + outer[:, :, None]
        down[level] = _log_sum(both, axis=1)
        joint[level] = both + inside[level][:, None, :]
    belief = inside + down
    total = _log_sum(belief, axis=1) if len(belief) else np.zeros(0)
    return belief - total[:, None], joint - total[:, None, None]


class Extractor:
    """Potentials of the nodes (features x states) and of parents with children (kind of the child x state x state)."""

    def __init__(self, weights: np.ndarray, edges: np.ndarray):
        self.weights, self.edges = weights, edges

    def marginals(self, pages: list[Page]) -> list[np.ndarray]:
        """The probability of ``MAIN`` for each node of each page."""
        forest = Forest(pages)
        belief, _ = sum_product(forest, self.weights, self.edges)
        return np.split(np.exp(belief[:, MAIN]), np.cumsum(forest.sizes)[:-1]) if pages else []

    def texts(self, sources: list[str]) -> list[str]:
        pages = [parse(s) for s in sources]
        return ["\n".join(t for t, m in zip(p.text, own.tolist()) if t and m >= 0.5) for p, own in zip(pages, self.marginals(pages))]


def gold_states(page: Page) -> np.ndarray:
    """States by the marks: a mark holds for all below it until the next one; an element with both is mixed."""
    nodes = len(page.parent)
    inherited = [REST] * nodes
    for i in range(nodes):
        mark = page.marks[i]
        inherited[i] = mark if mark is not None else inherited[page.parent[i]] if page.parent[i] >= 0 else REST
    holds = [False] * nodes
    for i in range(nodes - 1, 0, -1):
        if inherited[i] == MAIN or holds[i]:
            holds[page.parent[i]] = True
    return np.array([MAIN if inherited[i] == MAIN else MIXED if holds[i] else REST for i in range(nodes)])


def train(labelled: DataFrame, max_pages: int = 600, steps: int = 100, rate: float = 0.15, penalty: float = 1e-3) -> Extractor:
    """Potentials from labelled pages (``page_id, html``), fitted on the driver to the ``max_pages`` smallest ids.

    The bound is the parameter; equal ids are ordered by their html. A null html counts as an empty page. Pages without
    marks are pages without main text. Without any page all potentials are zero and every run counts as main text to a
    third, so no text is extracted.
    """
    order = [F.col("page_id").cast("long").asc_nulls_last(), F.col("html")]
    sources = [r[0] or "" for r in labelled.orderBy(*order).limit(max_pages).select(F.col("html").cast("string")).collect()]
    pages = [parse(s) for s in sources]
    forest = Forest(pages)
    weights = np.zeros((len(forest.names), STATES))
    edges = np.zeros((len(KIND_NAMES), STATES, STATES))
    if not pages:
        return Extractor(weights, edges)
    gold = np.concatenate([gold_states(p) for p in pages])
    at, feature = forest.features
    child = np.flatnonzero(forest.parent >= 0)
    target = np.zeros((len(gold), STATES))
    target[np.arange(len(gold)), gold] = 1
    target_edges = np.zeros_like(edges)
    np.add.at(target_edges, (forest.kind[child], gold[forest.parent[child]], gold[child]), 1)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, edges)]
    for step in range(1, steps + 1):
        belief, joint = sum_product(forest, weights, edges)
        rest = target - np.exp(belief)
        slope = np.stack([np.bincount(feature, rest[at, s], len(forest.names)) for s in range(STATES)], axis=1)
        found = np.zeros_like(edges)
        np.add.at(found, forest.kind[child], np.exp(joint[child]))
        for values, gradient, (mean, square) in zip((weights, edges), (slope, target_edges - found), moments):
            gradient = gradient / len(pages) - penalty * values
            mean += 0.1 * (gradient - mean)
            square += 0.01 * (gradient ** 2 - square)
            values += rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
    return Extractor(weights, edges)


BATCH = 1 << 20  # characters of html decided at once, or one longer page


def main_text(pages: DataFrame, model: Extractor) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row: the runs of main text in page order, joined by line feeds.

    A null or empty html, and a page without main text, gives an empty text. Rows with equal html get equal texts, one
    each; a null id or url stays null; an empty table gives no rows. Whole pages are read, however long. Other columns
    are not read, whatever their names.
    """
    from pyspark.sql.functions import arrow_udf

    def extract(source: pa.Array) -> pa.Array:
        texts, waiting, size = [], [], 0
        for value in source:
            waiting.append(value.as_py() or "")
            size += len(waiting[-1])
            if size > BATCH:
                texts += model.texts(waiting)
                waiting, size = [], 0
        return pa.array(texts + model.texts(waiting), pa.string())

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    found = own.withColumn("text", arrow_udf(extract, "string")("html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


# Labelled pages: layouts put together by chance from the ways in which pages are commonly built.

_SYLLABLES = "ba ce di fo gu la me ni ro su ta ve wi xo za pre ter con ment tion".split()


class _Writer:
    """Draws the parts of one labelled page."""

    def __init__(self, seed: int):
        self.draw = random.Random(seed)

    def pick(self, *choices):
        return self.draw.choice(choices)

    def words(self, low: int, high: int) -> str:
        return " ".join("".join(self.draw.choices(_SYLLABLES, k=self.draw.randint(1, 4))) for _ in range(self.draw.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        out = []
        for _ in range(self.draw.randint(low, high)):
            text = self.words(3, 18)
            if self.draw.random() < 0.15:
                text += f' <a href="/{self.words(1, 1)}">{self.words(1, 3)}</a> ' + self.words(1, 6)
            if self.draw.random() < 0.15:
                text = f"<{(tag := self.pick('b', 'em', 'strong', 'i', 'span', 'code'))}>{text}</{tag}>"
            out.append(text.capitalize() + self.pick(".", ".", ".", "?", "!"))
        return " ".join(out)

    def element(self, names, tags=("div",), inner="", marks="") -> str:
        """One element; its name is told by its tag, its class, its id, or not at all when ``names`` is empty."""
        tag = self.pick(*tags)
        style = self.draw.random()
        name = self.pick(*names) if names else ""
        told = "" if not name or (tag not in ("div", "section", "ul", "ol", "p") and style < 0.6) else f' id="{name}"' if style < 0.25 else f' class="{name}"'
        return f"<{tag}{told}{marks}>{inner}</{tag}>"

    def links(self, count: int, tags=("ul", "ol")) -> str:
        items = [f'<a href="/{self.words(1, 1)}">{self.words(1, 4)}</a>' for _ in range(count)]
        if self.draw.random() < 0.3:
            return self.pick(" | ", " ", "<br>").join(items)
        tag = self.pick(*tags)
        return f"<{tag}>" + "".join(f"<li>{i}</li>" for i in items) + f"</{tag}>"

    def menu(self) -> str:
        return self.element(("menu", "navbar", "nav", "main-nav", "site-navigation", "breadcrumb", "topbar"), ("nav", "nav", "div", "section"), self.links(self.draw.randint(2, 8)))

    def header(self) -> str:
        title = self.pick("<h1>{}</h1>", "<h1>{}</h1>", "<h1><a href='/'>{}</a></h1>", "<div>{}</div>", "<p>{}</p>", "<a href='/'>{}</a>", "{}").format(self.words(1, 4))
        inner = title + self.pick("", "", f"<p>{self.words(2, 8)}</p>", f'<p class="tagline">{self.sentences(1, 1)}</p>') + self.pick("", self.menu())
        return self.element(("header", "site-header", "masthead", "top", "page-head", "logo"), ("header", "header", "div"), inner)

    def advert(self) -> str:
        inner = self.pick(self.sentences(1, 3), f'<a href="/x">{self.words(2, 8)}</a>', f"<p>{self.sentences(1, 3)}</p>", f"<h3>{self.words(2, 5)}</h3><p>{self.sentences(1, 2)}</p>")
        return self.element(("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "banner-ad"), ("div", "section", "aside", "div" if "</p>" in inner else "p"), inner)

    def notice(self) -> str:
        inner = self.pick(f"<p>{self.sentences(1, 3)}</p>", self.sentences(1, 3), f"<h2>{self.words(1, 4)}</h2><p>{self.sentences(1, 3)}</p>") + self.pick("", f"<button>{self.words(1, 2)}</button>")
        return self.element(("cookie-notice", "cookie", "consent", "notice", "alert", "newsletter", "popup", "gdpr-banner", "subscribe"), ("div", "div", "section", "dialog", "aside"), inner)

    def side(self) -> str:
        inner = f"<h{(n := self.pick(2, 3, 4))}>{self.words(1, 3)}</h{n}>" + self.pick(self.links(self.draw.randint(2, 7)), f"<p>{self.sentences(1, 3)}</p>", f"<ul><li>{self.words(2, 6)}</li><li>{self.words(2, 6)}</li></ul>")
        return self.element(("sidebar", "widget", "related", "side", "recommended", "trending", "popular-posts"), ("aside", "aside", "div", "section"), inner)

    def form(self) -> str:
        inner = "".join(f"<label>{self.words(1, 3)}</label><input name=x>" for _ in range(self.draw.randint(1, 3)))
        inner += self.pick("", f"<p>{self.sentences(1, 1)}</p>", "<textarea>x</textarea>", f"<select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select>") + f"<button>{self.words(1, 2)}</button>"
        return f"<form{self.pick('', ' class=search', ' id=login', ' class=contact')}>{inner}</form>"

    def comments(self) -> str:
        def one():
            text = self.sentences(1, 6)
            inner = self.pick("", f"<b>{self.words(1, 2)}</b>", f'<div class="author">{self.words(1, 2)}</div>') + self.pick(f"<p>{text}</p>", text, f"<p>{text}</p><p>{self.sentences(1, 3)}</p>")
            return inner

        count = self.draw.randint(1, 5)
        if self.draw.random() < 0.3:
            body = "<ol class=\"commentlist\">" + "".join(f"<li>{one()}</li>" for _ in range(count)) + "</ol>"
        else:
            tag = self.pick("div", "div", "article", "li")
            body = "".join(f'<{tag} class="{self.pick("comment", "reply", "comment-body")}">{one()}</{tag}>' for _ in range(count))
        head = self.pick("", f"<h2>{self.words(1, 2)}</h2>", f"<h3>{self.words(1, 3)}</h3>")
        tag, name = self.pick("section", "div"), self.pick("comments", "discussion", "comment-section", "responses", "disqus_thread")
        return f'<{tag} {self.pick("class", "id")}="{name}"{"" if self.draw.random() < 0.85 else " data-rest"}>{head}{body}{self.pick("", "", self.form())}</{tag}>'

    def share(self) -> str:
        return self.element(("share", "social", "share-buttons", "follow"), ("div", "div", "ul"), "".join(f'<a href="#">{self.words(1, 1)}</a> ' for _ in range(self.draw.randint(2, 5))))

    def footer(self) -> str:
        text = self.pick(f"&copy; {self.words(1, 4)}", f"&copy; 2020 {self.words(1, 3)} &middot; {self.sentences(1, 2)}", self.sentences(1, 2), f"<p>&copy; {self.words(1, 3)}</p>" + self.links(3))
        return self.element(("footer", "site-footer", "bottom", "legal", "copyright"), ("footer", "footer", "footer", "div"), text)

    def block(self) -> str:
        kind = self.draw.random()
        if kind < 0.58:
            return f"<p>{self.sentences(1, 8)}" + self.pick("</p>", "</p>", "</p>", "", "<br>")
        if kind < 0.62:
            return f"<p>{self.pick(self.words(2, 12), self.words(60, 900), self.sentences(10, 60))}</p>"
        if kind < 0.68:
            return f"<p><b>{self.sentences(1, 5)}<br>"
        if kind < 0.74:
            return f"<p>{self.words(1, 3)}.</p>"
        if kind < 0.81:
            return f"<h{(n := self.pick(2, 2, 3, 4))}>{self.words(1, 7)}</h{n}>"
        if kind < 0.87:
            tag = self.pick("ul", "ol")
            return f"<{tag}>" + "".join(f"<li>{self.sentences(1, 2) if self.draw.random() < 0.7 else self.words(1, 5)}</li>" for _ in range(self.draw.randint(2, 5))) + f"</{tag}>"
        if kind < 0.91:
            return f"<blockquote>{self.pick('<p>{}</p>', '{}').format(self.sentences(1, 3))}</blockquote>"
        if kind < 0.94:
            return f"<figure><img src=x><figcaption>{self.words(2, 9)}</figcaption></figure>"
        if kind < 0.96:
            return f"<pre>{self.words(3, 20)}</pre>"
        if kind < 0.98:
            return "<table>" + "".join(f"<tr><td>{self.words(1, 4)}<td>{self.words(1, 4)}</tr>" for _ in range(self.draw.randint(2, 4))) + "</table>"
        return f"<div>{self.sentences(1, 4)}</div>"

    def article(self) -> str:
        title = f"<h1>{self.words(1, 12)}</h1>"
        title = self.pick(title, title, title, f"<header>{title}</header>", f"<h2>{self.words(2, 9)}</h2>", "")
        blocks = [self.block() for _ in range(self.pick(1, 1, 2, 3, 5, 8, 14, 22))]
        if self.draw.random() < 0.15:  # one paragraph that outweighs the rest of the page, of any wording
            blocks.insert(self.draw.randint(0, len(blocks)), f"<p>{self.words(1, 1)} " * self.draw.randint(1, 9) + self.words(300, 1500) + self.pick(".", "", "</p>"))
        if self.draw.random() < 0.35:
            foreign = self.pick(self.advert, self.advert, self.share, self.form, self.side, self.notice)()
            blocks.insert(self.draw.randint(0, len(blocks)), re.sub(r"^<(\w+)", r"<\1 data-rest", foreign))
        inner = title + "".join(blocks)
        if self.draw.random() < 0.25:
            inner += re.sub(r"^<(\w+)", r"<\1 data-rest", self.comments())
        wrap = self.draw.random()
        if wrap < 0.1:  # straight into the body
            return "".join(re.sub(r"^<(\w+)(?! data-)", r"<\1 data-main", b) for b in [re.sub("</?header>", "", title), *blocks])
        if wrap < 0.5:
            return f"<article data-main{self.pick('', '', ' class=post')}>{inner}</article>"
        if wrap < 0.62:
            return f"<main{self.pick(' data-main', '')}>{inner}</main>".replace("<main>", "<main data-main>")
        if wrap < 0.72:
            return f"<main><article data-main>{inner}</article>{self.pick('', self.side(), self.share())}</main>"
        if wrap < 0.95:
            return self.element(("content", "post", "article-body", "entry-content", "story", "main", "post-text", "page-content", "text"), ("div", "div", "section"), inner, " data-main")
        return f"<div data-main>{inner}</div>"

    def page(self) -> str:
        before = [part() for part in (self.header, self.menu, self.menu, self.notice, self.advert, self.advert, self.form) if self.draw.random() < 0.4]
        after = [part() for part in (self.share, self.comments, self.side, self.side, self.advert, self.form, self.notice) if self.draw.random() < 0.33]
        if self.draw.random() < 0.5:
            self.draw.shuffle(before)
            self.draw.shuffle(after)
        middle = [self.article()] if self.draw.random() < 0.97 else []
        if self.draw.random() < 0.06:  # nothing but the article
            return "".join(middle)
        if self.draw.random() < 0.2:
            middle = [self.element(("wrapper", "container", "page", "layout"), ("div",), "".join([*middle, *after]))]
            after = []
        bottom = [self.footer()] if self.draw.random() < 0.85 else []
        if self.draw.random() < 0.1:
            bottom.append(self.notice())
        body = "".join([*before, *middle, *after, *bottom])
        head = f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{self.words(1, 6)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>'
        return head + body + self.pick("</body></html>", "</body></html>", "")


def labelled_pages(spark, count: int = 600, seed: int = 13) -> DataFrame:
    """``page_id, html`` of pages with marks, written by chance in many common layouts; the same ones for a seed."""
    from pyspark.sql.functions import arrow_udf

    write = arrow_udf(lambda ids: pa.array([_Writer(seed * 1_000_003 + i).page() for i in ids.to_pylist()], pa.string()), "string")
    return spark.range(count).select(F.col("id").alias("page_id"), write("id").alias("html"))
