"""Main text of web pages by a tree-structured graphical model over DOM blocks.

A page is parsed into a tree of block elements; runs of text beside block children are leaves of their own, and inline
markup belongs to its block. Each node has a hidden label, content or not. The model is a product of

* node potentials: P(feature | label) for tag, words of class, id and role, text length, link share, punctuation, and
* parent-child potentials: P(child's label | parent's label, child's kind of tag).

The words that name parts are not listed: each word's potential is counted, and a node takes the mean of those it has.

Sum-product message passing, once upward and once downward, gives every node its exact marginal. A text block is kept
where its marginal is at least one half. Controls and hidden elements are no text of a page, wherever they stand. All potentials are smoothed counts over labelled pages. There are none in the
tables, so ``labelled_pages`` writes some: random layouts whose parts carry their label in an attribute.
"""

from __future__ import annotations

import html
import math
import pickle
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Labelled pages that a model is trained on, and the smoothing count of every potential.
PAGES, SMOOTH = 400, 0.3
#: Weight of the features that describe text: they depend on each other, so each counts for less than a whole one.
TEMPER = 0.4
LABEL = "data-content"

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# Fixed values of HTML: elements without end tag, with raw text, of controls and hidden content, of inline markup, and
# those that an opening block ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
HIDDEN = frozenset("noscript template svg select button label output meter progress datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark math nobr object q rp rt ruby s samp small span strike strong sub sup time tt u var picture audio video map mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mstyle semantics annotation".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: An element, those that it ends where nothing of the third set stands between.
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table", "tbody", "thead", "tfoot")), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
_SCOPE = {rule: frozenset(rule[0] + rule[1]) for rule in ENDS.values()}

#: Words that the labelled layouts name their parts with; plain values that pages use.
PARTS = {
    "menu": "nav menu navbar breadcrumb breadcrumbs toc pagination pager tabs",
    "head": "header masthead banner topbar logo branding",
    "foot": "footer foot colophon copyright legal",
    "side": "sidebar aside widget related recommended trending rail",
    "note": "cookie cookies consent notice alert popup modal gdpr newsletter subscribe",
    "ad": "ad ads advert advertisement sponsor sponsored promo adbox banner-ad",
    "form": "form search login signup input",
    "talk": "comment comments reply replies discussion respond disqus",
    "share": "share social follow tags meta byline",
    "body": "article content post entry main story body text prose",
}
_NAME = re.compile(r"[a-z]+")
KINDS = {"article": "root", "main": "root", "nav": "off", "footer": "off", "aside": "off", "header": "off", "form": "off", "p": "text", "h1": "text", "h2": "text", "h3": "text", "h4": "text", "blockquote": "text", "pre": "text", "#text": "text", "li": "item", "td": "item", "th": "item"}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "text", "chars", "linked", "marks", "near")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node] = []
        self.text: list[str] | None = None
        self.chars = self.linked = self.marks = 0
        #: For each rule of ENDS the nearest node, this one included, that it ends or that bounds it.
        self.near: dict = parent.near if parent is not None else {}
        mine = [rule for rule, tags in _SCOPE.items() if tag in tags]
        if mine:
            self.near = self.near | dict.fromkeys(mine, self)


def _tokens(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, closing slash, tag, attributes) of each tag; comments and the like have no tag. Raw text is passed over."""
    at = 0
    while (found := _TOKEN.search(page, at)) is not None:
        tag, at = (found[2] or "").lower(), found.end()
        if tag in RAW and not found[1]:
            if not found[3].endswith("/"):
                close = _CLOSE[tag].search(page, at)
                at = close.end() if close else len(page)
            tag = "#raw"
        yield found.start(), at, found[1] or "", tag, found[3] or ""


_CLOSE = {tag: re.compile(f"</{tag}(?=[\\s/>])[^>]*(?:>|\\Z)", re.I) for tag in RAW}


def _hidden(tokens: list[tuple[int, int, str, str, str]]) -> dict[int, int]:
    """Opening tokens of hidden elements and the tokens that close them, nested ones counted. One that never closes hides nothing."""
    open_at: dict[str, list[int]] = defaultdict(list)
    pairs = {}
    for i, (_, _, slash, tag, attrs) in enumerate(tokens):
        if tag in HIDDEN:
            if slash:
                if open_at[tag]:
                    pairs[open_at[tag].pop()] = i
            elif not attrs.endswith("/"):
                open_at[tag].append(i)
    return pairs


def parse(page: str) -> Node:
    """Tree of block nodes, in time linear in the page. Leaves tagged ``#text`` hold the text of one block."""
    root = top = Node("#page", "", None)
    inline: list[str] = []  # open inline elements of the current block
    within: Counter = Counter()  # the same, counted
    blocks: Counter = Counter()  # open blocks
    leaf: Node | None = None

    def say(text: str) -> None:
        nonlocal leaf
        if leaf is None:
            if not text.strip():
                return
            leaf = Node("#text", "", top)
            leaf.text = []
            top.children.append(leaf)
        leaf.text.append(text)
        if within["a"]:
            leaf.linked += len(text.strip())

    def leave(node: Node) -> None:
        """Close blocks up to ``node``."""
        nonlocal top, leaf, inline, within
        while top is not node.parent:
            blocks[top.tag] -= 1
            top = top.parent
        leaf, inline, within = None, [], Counter()

    tokens = list(_tokens(page))
    hidden = _hidden(tokens)
    i = at = 0
    while i < len(tokens):
        start, end, slash, tag, attrs = tokens[i]
        if start > at:
            say(page[at:start])
        at = end
        if i in hidden and not slash:
            i = hidden[i] + 1
            at = tokens[i - 1][1]
            say(" ")
            continue
        i += 1
        if not tag or tag in HIDDEN:
            continue
        if tag == "#raw" or tag == "br":
            say(" ")
        elif slash:
            if tag in INLINE:
                if within[tag]:
                    while (last := inline.pop()) != tag:
                        within[last] -= 1
                    within[tag] -= 1
            elif tag not in VOID:
                if blocks[tag]:
                    node = top
                    while node.tag != tag:
                        node = node.parent
                    leave(node)
                elif tag == "p":
                    leaf = None
        elif tag in VOID:
            if tag == "hr":
                leaf = None
            else:
                say(" ")
        elif tag in INLINE:
            if not attrs.endswith("/") and not (tag == "a" and within["a"]):  # a link in a link ends the first
                inline.append(tag)
                within[tag] += 1
        else:
            if tag in CLOSES_P and top.tag == "p":
                leave(top)
            if tag in ENDS:
                rule = ENDS[tag]
                node = top.near.get(rule)
                if node is not None and node.tag in rule[0]:
                    row = node.near.get(ENDS["td"]) if tag == "tr" and node.tag != "tr" else None
                    row = row.parent.near.get(ENDS["td"]) if row is not None and row.tag != "tr" and row.parent is not None else row
                    leave(row if row is not None and row.tag == "tr" else node)
            leaf, inline, within = None, [], Counter()
            node = Node(tag, attrs, top)
            top.children.append(node)
            if not attrs.endswith("/"):
                top = node
                blocks[tag] += 1
    if at < len(page):
        say(page[at:])
    return root


def block_text(node: Node) -> str:
    """A leaf's text: references decoded, white space runs to one blank, trimmed."""
    return " ".join(html.unescape("".join(node.text or [])).split())


def _order(root: Node) -> list[Node]:
    """Nodes before their children, in page order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed(node.children))
    return out


def _sum_up(order: list[Node]) -> None:
    for node in order:
        if node.text is not None:
            text = "".join(node.text)
            node.chars, node.marks = len(text.strip()), sum(text.count(c) for c in ".,;:!?")
    for node in reversed(order):
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
            node.parent.marks += node.marks


def _names(node: Node) -> set[str]:
    """Words of class, id and role."""
    if not node.attrs:
        return set()
    return {"name=" + word for name, a, b, c in _ATTRIBUTE.findall(node.attrs) if name.lower() in ("class", "id", "role") for word in _NAME.findall((a or b or c).lower())}


def node_features(node: Node) -> tuple[str, ...]:
    """Features beside the names."""
    n = node.chars
    return (
        "tag=" + node.tag,
        f"size={min(8, int(math.log2(n + 1)))}",
        f"link={0 if not n else min(4, int(5 * node.linked / n))}",
        f"mark={0 if not n else min(4, int(100 * node.marks / n))}",
    )


class TreeModel:
    """Log potentials as logs of smoothed relative frequencies."""

    def __init__(self) -> None:
        self.seen: dict[str, Counter] = defaultdict(Counter)  # feature -> label counts
        self.labels: Counter = Counter()
        self.edges: dict[tuple[str, int], Counter] = defaultdict(Counter)  # (child's kind, parent's label) -> child's label
        self._node: dict[str, float] = {}
        self._edge: dict[str, tuple] = {}

    def learn(self, page: str) -> None:
        """Count one labelled page: every element carries LABEL or takes its parent's label."""
        order = _order(parse(page))
        _sum_up(order)
        known = {}
        for node in order:
            own = [a or b or c for name, a, b, c in _ATTRIBUTE.findall(node.attrs) if name == LABEL] if node.attrs else []
            y = int(own[0]) if own else known.get(id(node.parent), 0)
            known[id(node)] = y
            self.labels[y] += 1
            for f in (*node_features(node), *_names(node)):
                self.seen[f][y] += 1
            if node.parent is not None:
                self.edges[KINDS.get(node.tag, "other"), known[id(node.parent)]][y] += 1

    def finish(self) -> TreeModel:
        sizes = Counter(f.split("=")[0] for f in self.seen)
        for f, c in self.seen.items():
            many = sizes[f.split("=")[0]] + 1
            weight = 1.0 if f.startswith(("tag=", "name=")) else TEMPER
            self._node[f] = weight * (math.log((c[1] + SMOOTH) / (self.labels[1] + SMOOTH * many)) - math.log((c[0] + SMOOTH) / (self.labels[0] + SMOOTH * many)))
        for kind in {k for k, _ in self.edges} | {"other"}:
            rows = [self.edges.get((kind, p)) or self.edges["other", p] for p in (0, 1)]
            self._edge[kind] = tuple(tuple((r[y] + SMOOTH) / (r[0] + r[1] + 2 * SMOOTH) for y in (0, 1)) for r in rows)
        self.seen, self.edges = defaultdict(Counter), defaultdict(Counter)
        return self

    def log_odds(self, node: Node) -> float:
        """Log odds of the node's own features: their sum, with the mean over the names that the model knows."""
        odds = self._node
        named = [odds[w] for w in _names(node) if w in odds]
        return sum(odds.get(f, 0.0) for f in node_features(node)) + (sum(named) / len(named) if named else 0.0)

    def marginals(self, order: list[Node]) -> dict[int, float]:
        """P(content) of every node by one upward and one downward pass, messages scaled to sum 1."""
        edge = self._edge
        up: dict[int, tuple[float, float]] = {}
        belief: dict[int, list[float]] = {}
        for node in order:
            x = self.log_odds(node)
            x = 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, x))))
            belief[id(node)] = [1.0 - x, x]
        belief[id(order[0])] = [1.0, 0.0]  # the page itself isn't content
        for node in reversed(order):
            if node.parent is not None:
                b, t = belief[id(node)], edge.get(KINDS.get(node.tag, "other"), edge["other"])
                m0, m1 = t[0][0] * b[0] + t[0][1] * b[1], t[1][0] * b[0] + t[1][1] * b[1]
                m0, m1 = m0 / (m0 + m1), m1 / (m0 + m1)
                up[id(node)] = (m0, m1)
                p = belief[id(node.parent)]
                p0, p1 = p[0] * m0, p[1] * m1
                total = p0 + p1 or 1.0
                p[0], p[1] = p0 / total, p1 / total
        out = {id(order[0]): belief[id(order[0])][1]}
        for node in order[1:]:
            p, u, b = belief[id(node.parent)], up[id(node)], belief[id(node)]
            c0, c1 = p[0] / max(u[0], 1e-300), p[1] / max(u[1], 1e-300)
            t = edge.get(KINDS.get(node.tag, "other"), edge["other"])
            b0, b1 = b[0] * (c0 * t[0][0] + c1 * t[1][0]), b[1] * (c0 * t[0][1] + c1 * t[1][1])
            total = b0 + b1 or 1.0
            b[0], b[1] = b0 / total, b1 / total
            out[id(node)] = b[1]
        return out

    def extract(self, page: str) -> str:
        """Content blocks in page order, joined by an empty line."""
        order = _order(parse(page))
        _sum_up(order)
        p = self.marginals(order)
        texts = [block_text(n) for n in order if n.text is not None and p[id(n)] >= 0.5]
        return "\n\n".join(t for t in texts if t)


def labelled_pages(n: int = PAGES, seed: int = 11) -> list[str]:
    """Random layouts. Content and its parts carry LABEL="1", other parts "0"."""
    rng = random.Random(seed)
    sounds = "ta re mi so lu ven dor kel par ish on al et ra be".split()

    def words(low: int, high: int) -> str:
        ws = ["".join(rng.choice(sounds) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
        return " ".join(w + ("," if rng.random() < 0.08 else "." if rng.random() < 0.08 else "") for w in ws).capitalize() + rng.choice([".", ".", ""])

    def link(low: int = 1, high: int = 3) -> str:
        return f'<a href="/{rng.randint(1, 99)}">{words(low, high)}</a>'

    def named(part: str) -> str:
        return f' class="{rng.choice(PARTS[part].split())}"' if rng.random() < 0.8 else f' id="{rng.choice(PARTS[part].split())}"'

    def off(tag: str, attrs: str, inner: str) -> str:
        return f'<{tag}{attrs} {LABEL}="0">{inner}</{tag}>'

    def menu() -> str:
        inner = "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 9))) + "</ul>"
        return off("nav", "", inner) if rng.random() < 0.6 else off("div", named("menu"), inner)

    def advert() -> str:
        return off("div", named("ad"), words(4, 14) if rng.random() < 0.7 else f"<p>{words(4, 14)}</p>")

    def note() -> str:
        return off("div", named("note"), f"<p>{words(6, 25)}</p>" if rng.random() < 0.5 else words(6, 25))

    def side() -> str:
        inner = f"<h3>{words(1, 3)}</h3>" + "".join(rng.choice([f"<p>{words(5, 20)}</p>", f"<li>{link(2, 6)}</li>"]) for _ in range(rng.randint(1, 5)))
        return off("aside", "", inner) if rng.random() < 0.5 else off("div", named("side"), inner)

    def talk() -> str:
        inner = "".join(f"<div{named('talk')}><p>{words(5, 40)}</p></div>" for _ in range(rng.randint(1, 5)))
        return off(rng.choice(["section", "div"]), named("talk"), f"<h3>{words(1, 2)}</h3>" + inner)

    def form() -> str:
        return off("form", "", f"<label>{words(1, 3)}</label><input name=q><button>{words(1, 1)}</button>" + (f"<p>{words(3, 10)}</p>" if rng.random() < 0.4 else ""))

    def share() -> str:
        return off("div", named("share"), rng.choice([words(2, 8), f"<ul><li>{link()}</li><li>{link()}</li></ul>"]))

    def foot() -> str:
        inner = rng.choice([f"&copy; {words(3, 14)}", f"<p>&copy; {words(3, 14)}</p>", f"<ul><li>{link()}</li></ul><p>{words(3, 14)}</p>"])
        return off("footer", "", inner) if rng.random() < 0.7 else off("div", named("foot"), inner)

    def head() -> str:
        inner = f"<h1>{words(1, 4)}</h1>" if rng.random() < 0.5 else f"<div>{link()}</div>"
        return off("header", "", inner + (menu() if rng.random() < 0.4 else "")) if rng.random() < 0.7 else off("div", named("head"), inner)

    def body() -> str:
        parts = [f"<h1>{words(2, 10)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.choice([1, 1, 2, 3, 4, 6, 10])):
            kind = rng.random()
            text = words(1, 12) if rng.random() < 0.25 else words(12, 90)
            if rng.random() < 0.15:
                text += f" {link()} {words(3, 20)}"
            if kind < 0.75:
                parts.append(f"<p>{text}</p>" if rng.random() < 0.8 else f"<p><b>{text}<br>")
            elif kind < 0.82:
                parts.append(f"<h2>{words(2, 8)}</h2>")
            elif kind < 0.88:
                parts.append("<ul>" + "".join(f"<li>{words(3, 20)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.92:
                parts.append(f"<blockquote><p>{text}</p></blockquote>")
            elif kind < 0.95:
                parts.append(f"<table><tr><td>{words(1, 6)}</td><td>{words(1, 6)}</td></tr></table>")
            else:
                parts.append(f"<div>{text}</div>")
        for extra in (advert, share, side, note):
            if rng.random() < 0.12:
                parts.insert(rng.randint(0, len(parts)), extra())
        inner = "".join(parts)
        how = rng.random()
        if how < 0.5:
            return f'<article {LABEL}="1">{inner}</article>'
        if how < 0.7:
            return f'<main {LABEL}="1">{inner}</main>'
        if how < 0.75:
            return f'<main {LABEL}="1"><article>{inner}</article></main>'
        return f'<div{named("body")} {LABEL}="1">{inner}</div>'

    out = []
    for _ in range(n):
        before = [f() for f, p in ((head, 0.5), (menu, 0.7), (note, 0.2), (advert, 0.4), (form, 0.15)) if rng.random() < p]
        after = [f() for f, p in ((share, 0.2), (talk, 0.3), (side, 0.35), (advert, 0.2), (form, 0.15), (foot, 0.85)) if rng.random() < p]
        rng.shuffle(before)
        inner = "".join([*before, body(), *after])
        out.append(f"<html><head><title>{words(2, 8)}</title></head><body>{f'<div>{inner}</div>' if rng.random() < 0.3 else inner}</body></html>")
    return out


def train(pages: list[str] | None = None) -> TreeModel:
    """Count labelled pages; by default those of ``labelled_pages``."""
    model = TreeModel()
    for page in labelled_pages() if pages is None else pages:
        model.learn(page)
    return model.finish()


def extract_pages(pages: DataFrame, model: TreeModel | None = None, page_id: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null and empty pages have an empty text. Broken and cut-off markup is read as far as it goes. Repeated rows are
    extracted alike. An empty table gives no rows. Long pages are read whole. Other columns are not read.
    """
    held = pages.sparkSession.sparkContext.broadcast(pickle.dumps(model or train()))

    def extracted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = pickle.loads(held.value)
        for frame in frames:
            texts = [own.extract(p) for p in frame.pop("html")]
            frame["text"], frame["n_chars"] = texts, [len(t) for t in texts]
            yield frame

    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(markup), F.lit("")).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInPandas(extracted, f"page_id {kind}, url string, text string, n_chars long")
