"""Main text of web pages, by a tree-structured graphical model of the DOM.

A page is parsed to block elements and blocks of text.  Every node is content
or not; the model has a potential for each node's features given its state,
and one for each parent and child, which depends on the child's kind and on
what its whole name (class, id, role) hints at; a hint's word in a longer name
that says something else is only a feature, with a potential of its own.  Both
are estimated by counting on labelled pages.  Sum-product message passing,
once up and once down the tree, gives each block's exact marginal, and the
blocks that are content more likely than not are the page's text.

The labelled pages are made by ``training_pages``: layouts of many kinds, with
every part marked.  Real labelled pages can be given instead.

Defined results: null and empty html give an empty text.  Rows are
independent: null or repeated ids and urls do no harm, extra columns aren't
read.  Broken markup is read as browsers do in the common cases (end tags that
are left out, unknown end tags, unfinished comments and tags).
"""

from __future__ import annotations

import html as htmllib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ship_package, slices

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|iframe)\b(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?][^>]*>"
    r"|<(?:/?[a-zA-Z]|[!?])[^>]*\Z",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_SPACES = re.compile(r"\s+")

#: Block elements and the kind each belongs to; all other elements are part of the text around them.
_KINDS = {
    "article": "article", "main": "main", "section": "section", "div": "div", "center": "div", "body": "body", "html": "html", "head": "head", "title": "head",
    "header": "header", "footer": "footer", "nav": "nav", "menu": "nav", "aside": "aside", "form": "form", "fieldset": "form", "button": "form",
    "select": "form", "textarea": "form", "option": "form", "dialog": "form", "label": "form", "legend": "form", "p": "p", "ul": "list", "ol": "list", "dl": "list",
    "li": "item", "dt": "item", "dd": "item", "h1": "h1", "h2": "h", "h3": "h", "h4": "h", "h5": "h", "h6": "h", "hgroup": "h", "table": "table",
    "thead": "table", "tbody": "table", "tfoot": "table", "tr": "row", "td": "cell", "th": "cell", "caption": "p", "figure": "figure",
    "figcaption": "p", "blockquote": "quote", "pre": "quote", "address": "p", "details": "section", "summary": "p", "hr": "void",
}
#: A start tag of the first ends an open element of the second, up to the third.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head", "title"}, {"html"})}
#: What the words of class, id and role hint at.
_HINTS = (
    ("comment", ("comment", "comments", "commentlist", "responses", "disqus", "respond", "reply", "replies", "discussion")),
    ("ad", ("ad", "ads", "advert", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "adsense")),
    ("notice", ("cookie", "cookies", "consent", "gdpr", "notice", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "paywall", "toast")),
    ("nav", ("nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "tabs", "skip")),
    ("side", ("sidebar", "side", "aside", "widget", "widgets", "related", "recommended", "share", "sharing", "social", "tags", "trending", "popular", "author-box", "complementary")),
    ("foot", ("footer", "foot", "copyright", "legal", "contentinfo", "colophon")),
    ("head", ("header", "masthead", "topbar", "logo", "search", "login", "toolbar")),
    ("main", ("content", "article", "post", "entry", "story", "main", "body", "text", "prose", "page")),
)
_HINT = {w: name for name, words in reversed(_HINTS) for w in words}


#: Power of the feature potentials: the features of a node are not independent, nor are those of its neighbours.
TEMPER = 0.5


class Node:
    """A block element, or (``text`` is not None) a block of text in it."""

    __slots__ = ("parent", "tag", "kind", "hint", "text", "linked", "mark")

    def __init__(self, parent: int, tag: str, kind: str, hint: str, text: str | None = None, linked: float = 0.0, mark: str | None = None):
        self.parent, self.tag, self.kind, self.hint, self.text, self.linked, self.mark = parent, tag, kind, hint, text, linked, mark


#: Words that name a part of a layout and say nothing about what is in it.
_PLAIN = frozenset("box wrap wrapper area container inner outer block section item items list bar row col column region module holder panel card group links link left right top bottom primary secondary unit slot area site global buttons button form title heading thread".split())


def _hint(attributes: str) -> str:
    """What the names of class, id and role hint at; with a ``~`` before it where the hint is one word of a longer name that says something else."""
    if "=" not in attributes:
        return ""
    found = ""
    for m in _ATTRIBUTE.finditer(attributes):
        for name in re.split(r"[\s\"']+", m[2].lower()):
            words = [w for w in re.split(r"[_\-]+", name) if w]
            hints = [_HINT[w] for w in words if w in _HINT]
            if not hints:
                continue
            got = next((h for h in hints if h != "main"), "main")
            if any(w not in _HINT and w not in _PLAIN and not w.isdigit() for w in words):
                got = "~" + got
            # A whole name says more than a part of one, and junk more than content.
            if not found or (found[0] == "~", found.endswith("main")) > (got[0] == "~", got.endswith("main")):
                found = got
    return found


def parse(page: str | None) -> list[Node]:
    """The nodes of a page in document order, parents before children; the first is the document itself."""
    nodes = [Node(-1, "#document", "html", "")]
    stack = [0]
    opened: Counter = Counter()  # of each tag on the stack
    reach = [-1]  # for each element on the stack: where the p is that a block in it ends, or -1
    pieces: list[str] = []
    linked = 0  # characters of the waiting text inside links
    anchors = 0

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            text = _SPACES.sub(" ", htmllib.unescape("".join(pieces))).strip()
            if text:
                owner = nodes[stack[-1]]
                nodes.append(Node(stack[-1], "#text", "text", "", text, min(1.0, linked / len(text)), owner.mark))
        pieces, linked = [], 0

    def close(to: int) -> None:
        flush()
        for k in stack[to:]:
            opened[nodes[k].tag] -= 1
        del stack[to:], reach[to:]

    def text(raw: str) -> None:
        nonlocal linked
        pieces.append(raw)
        if anchors:
            linked += len(raw)

    page = page or ""
    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        ending = bool(m[2] or m[5])
        if tag == "a":
            anchors = 0 if ending else 1
            continue
        if tag in ("br", "wbr", "img", "input"):
            pieces.append(" " if tag == "br" else "")
            continue
        kind = _KINDS.get(tag)
        if kind is None:
            continue
        if ending:
            flush()
            if opened[tag]:  # an element is looked for only where there is one: each step up is paid by what it closes
                close(next(k for k in range(len(stack) - 1, 0, -1) if nodes[stack[k]].tag == tag))
            continue
        flush()
        if reach[-1] > 0 and tag not in ("button", "select", "option", "textarea", "label"):
            close(reach[-1])
        if tag in _CLOSES and any(opened[t] for t in _CLOSES[tag][0]):
            ends, until = _CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                here = nodes[stack[k]].tag
                if here in until:
                    break
                if here in ends:
                    close(k)
                    if tag != "tr":
                        break
        attributes = m[4] or m[7] or ""
        mark = re.search(r"data-content=\"([01])\"", attributes) if "data-content" in attributes else None
        nodes.append(Node(stack[-1], tag, kind, _hint(attributes), mark=mark[1] if mark else nodes[stack[-1]].mark))
        if kind != "void" and not attributes.endswith("/"):
            reach.append(len(stack) if tag == "p" else reach[-1] if kind in ("item", "form", "quote") else -1)
            stack.append(len(nodes) - 1)
            opened[tag] += 1
    if at < len(page):
        text(page[at:])
    flush()
    return nodes


def features(node: Node) -> tuple[str, ...]:
    """What is seen of a node."""
    if node.text is None:
        return ("hint:" + node.hint,)
    n = len(node.text)
    words = node.text.count(" ") + 1
    return (
        f"words:{min(6, int(math.log2(words)))}",
        f"linked:{int(node.linked * 3.99)}",
        f"ends:{'.' if node.text[-1] in '.!?…:;\"”»' else ','}",
        f"sign:{'©' in node.text or 'cookie' in node.text.lower() or n < 2}",
    )


class DomModel:
    """Potentials of the tree model, from counts."""

    def __init__(self) -> None:
        self.edges: Counter = Counter()
        self.seen: Counter = Counter()

    @staticmethod
    def _edge_kind(child: Node) -> str:
        """Its kind, with what its whole name hints at; a part of a name is a feature only."""
        return child.kind + ("/" + child.hint if child.hint and child.hint[0] != "~" else "")

    def learn(self, pages: list[str]) -> DomModel:
        """Labelled pages: elements with ``data-content="1"`` or ``"0"``, which holds for what is in them."""
        for page in pages:
            nodes = parse(page)
            weight = [[0, 0] for _ in nodes]
            for k in range(len(nodes) - 1, -1, -1):
                node = nodes[k]
                if node.text is not None:
                    weight[k][node.mark == "1"] += len(node.text)
                if node.parent >= 0:
                    for y in (0, 1):
                        weight[node.parent][y] += weight[k][y]
            # A marked element's state is its mark; one around parts of both kinds is what most of its text is.
            state = [int(node.mark == "1") if node.mark else int(w[1] * 2 > w[0] + w[1]) for node, w in zip(nodes, weight, strict=True)]
            for k, node in enumerate(nodes):
                y = state[k]
                if node.parent >= 0:
                    self.edges[self._edge_kind(node), state[node.parent], y] += 1
                for f in features(node):
                    self.seen[node.kind == "text", f, y] += 1
                self.seen[node.kind == "text", "all", y] += 1
        return self

    def _edge(self, kind: str) -> tuple[tuple[float, float], tuple[float, float]]:
        """P(child's state | parent's state)."""
        out = []
        for above in (0, 1):
            n = [self.edges[kind, above, y] for y in (0, 1)]
            prior = (0.5, 0.5) if "/" not in kind else self._edge(kind.split("/")[0])[above]
            total = sum(n) + 2.0
            out.append(((n[0] + 2.0 * prior[0]) / total, (n[1] + 2.0 * prior[1]) / total))
        return tuple(out)

    def _seen(self, is_text: bool, feature: str) -> tuple[float, float]:
        """P(feature | state); those of texts, several and dependent, are tempered."""
        return tuple(((self.seen[is_text, feature, y] + 1.0) / (self.seen[is_text, "all", y] + 8.0)) ** (TEMPER if is_text else 1.0) for y in (0, 1))

    def ready(self) -> DomModel:
        self._edge_cache: dict[str, tuple] = {}
        self._seen_cache: dict[tuple[bool, str], tuple[float, float]] = {}
        return self

    def marginals(self, nodes: list[Node]) -> np.ndarray:
        """P(content) of every node, by messages up and down the tree."""
        n = len(nodes)
        edges, own = [None] * n, [(1.0, 1.0)] * n
        for k, node in enumerate(nodes):
            kind = self._edge_kind(node)
            e = self._edge_cache.get(kind)
            if e is None:
                e = self._edge_cache[kind] = self._edge(kind)
            edges[k] = e
            a, b = 1.0, 1.0
            for f in features(node):
                key = (node.kind == "text", f)
                p = self._seen_cache.get(key)
                if p is None:
                    p = self._seen_cache[key] = self._seen(*key)
                a, b = a * p[0], b * p[1]
            own[k] = a, b
        below = list(own)  # own evidence times the messages of the children
        up = [(1.0, 1.0)] * n
        for k in range(n - 1, 0, -1):
            (a, b), e, p = below[k], edges[k], nodes[k].parent
            m0, m1 = e[0][0] * a + e[0][1] * b, e[1][0] * a + e[1][1] * b
            up[k] = m0, m1 = m0 / (m0 + m1), m1 / (m0 + m1)
            x, y = below[p]
            x, y = x * m0, y * m1
            below[p] = x / (x + y), y / (x + y)
        down = [(0.5, 0.5)] * n
        out = np.zeros(n)
        for k, node in enumerate(nodes):
            if k:
                # The parent's belief without this child's message.
                (a, b), (c, d), (m0, m1), e = below[node.parent], down[node.parent], up[k], edges[k]
                a, b = a * c / max(m0, 1e-300), b * d / max(m1, 1e-300)
                s = a + b
                a, b = a / s, b / s
                x, y = a * e[0][0] + b * e[1][0], a * e[0][1] + b * e[1][1]
                down[k] = x / (x + y), y / (x + y)
            x, y = below[k][0] * down[k][0], below[k][1] * down[k][1]
            out[k] = y / (x + y)
        return out


def main_text(page: str | None, model: DomModel, threshold: float = 0.5) -> str:
    """The content blocks of a page, in order, one to a line."""
    if not page:
        return ""
    nodes = parse(page)
    if len(nodes) == 1:
        return ""
    p = model.marginals(nodes)
    return "\n".join(node.text for node, x in zip(nodes, p.tolist(), strict=True) if node.text is not None and x > threshold)


def training_pages(n: int = 400, seed: int = 7) -> list[str]:
    """Labelled pages in layouts of many kinds."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioutnrsl") for _ in range(r.randint(1, 9)))

    def sentence(low: int = 2, high: int = 18) -> str:
        return " ".join(word() for _ in range(r.randint(low, high))).capitalize() + r.choice([".", ".", ".", "!", "?", ""])

    prose = lambda: " ".join(sentence(1) for _ in range(r.choice([1, 1, 2, 3, 5, 8])))
    link = lambda: f'<a href="/{word()}">{" ".join(word() for _ in range(r.randint(1, 4)))}</a>'
    links = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 9))) + "</ul>"

    def named(*names: str) -> str:
        name = r.choice(names)
        return r.choice([f' class="{name}"', f' id="{name}"', f' class="{word()} {name}"', f' class="{name}-{r.choice(["box", "wrap", "area", "1"])}"', f' class="{r.choice(["site", "top", "global"])}-{name}"'] if r.random() > 0.04 else [f' class="{word()}-{name}"'])

    def loose() -> str:
        """A name that holds a hint's word and means something else."""
        return f' class="{r.choice(sorted(_HINT))}-{word()}"' if r.random() < 0.1 else ""

    def article() -> str:
        out = [f"<h1>{sentence(2, 9)}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.choice([1, 2, 3, 5, 8, 13])):
            out.append(
                r.choices(
                    [f"<p{loose()}>{prose()}</p>", f"<p><b>{prose()}<br>", f"<h2>{sentence(1, 6)}</h2>", "<ul>" + "".join(f"<li>{word() if short else sentence(1, 8)}</li>" for short in [r.random() < 0.5] for _ in range(r.randint(1, 5))) + "</ul>", f"<blockquote><p>{prose()}</p></blockquote>", f"<table><tr><td>{word()}</td><td>{sentence(1, 4)}</td></tr></table>", f"<p>{sentence(1, 4)} {link()} {sentence(1, 4)}</p>", f"<figure><img src=x><figcaption>{sentence()}</figcaption></figure>", f"<div{loose()}>{prose()}</div>", f"<pre>{prose()}</pre>"],
                    [60, 6, 7, 6, 4, 3, 6, 2, 3, 2],
                )[0]
            )
        if r.random() < 0.3:
            out.insert(r.randrange(len(out) + 1), f'<div{named("ad", "ads", "advert", "sponsored", "promo")} data-content="0">{prose()}</div>')
        if r.random() < 0.25:
            out.insert(r.randrange(len(out) + 1), r.choice([f'<aside{named("related", "share", "widget")} data-content="0">{links()}</aside>', f'<form data-content="0"><label>{sentence(1, 3)}</label><button>{word()}</button></form>', f'<div{named("newsletter", "notice", "subscribe")} data-content="0"><p>{prose()}</p></div>', f'<div{named("share", "tags", "social")} data-content="0">{links()}</div>']))
        if r.random() < 0.15:
            several = "".join(f"<p>{prose()}</p>" if r.random() < 0.5 else f'<div{named("comment", "reply")}><p>{prose()}</p></div>' for _ in range(r.randint(1, 4)))
            out.append(f'<{(t := r.choice(["div", "section", "ul"]))}{named("comments", "comment", "discussion")} data-content="0"><h3>{word()}</h3>{several}</{t}>')
        return "".join(out)

    def page() -> str:
        junk_before = [
            f'<nav data-content="0">{links()}</nav>', f'<header data-content="0"><div>{sentence(1, 4)}</div>{links()}</header>', f'<div{named("ad", "banner", "sponsor")} data-content="0">{prose()}</div>',
            f'<div{named("menu", "navbar", "breadcrumbs", "navigation")} data-content="0">{links()}</div>', f'<div{named("cookie", "consent", "notice", "alert")} data-content="0"><p>{prose()}</p><button>{word()}</button></div>',
            f'<div{named("header", "masthead", "topbar")} data-content="0"><h1>{word()}</h1><p>{sentence(1, 6)}</p></div>', f'<form{named("search", "login")} data-content="0">{word()} <input><button>{word()}</button></form>',
            f'<aside data-content="0"><h3>{word()}</h3><p>{prose()}</p></aside>', f'<div{named("sidebar", "widget")} data-content="0"><h3>{word()}</h3>{links()}<p>{prose()}</p></div>',
        ]
        comments = "".join(f'<{t}{named("comment", "reply")}><p>{prose()}</p></{t}>' for t in [r.choice(["div", "li", "article"])] for _ in range(r.randint(1, 5)))
        junk_after = [
            f'<footer data-content="0">&copy; {word()} &middot; {prose()}</footer>', f'<div{named("footer", "copyright", "legal")} data-content="0"><p>{prose()}</p>{links()}</div>',
            f'<section{named("comments", "discussion", "disqus")} data-content="0"><h2>{word()}</h2>{comments}</section>', f'<div{named("comments", "comment-list", "responses comments")} data-content="0">{comments}</div>',
            f'<aside{named("sidebar", "related", "")} data-content="0"><h3>{word()}</h3>{links()}<p>{prose()}</p></aside>', f'<div{named("related", "recommended", "popular")} data-content="0"><h3>{word()}</h3>{links()}</div>',
            f'<form data-content="0"><label>{sentence(1, 3)}</label><textarea>{sentence(1, 4)}</textarea><button>{word()}</button></form>', f'<nav data-content="0">{links()}</nav>',
        ]
        r.shuffle(junk_before)
        r.shuffle(junk_after)
        inner = article()
        body = r.choices([f'<article data-content="1">{inner}</article>', f'<main data-content="1">{inner}</main>', f'<main><article data-content="1">{inner}</article></main>', f'<div{named("content", "post", "entry", "article", "story")} data-content="1">{inner}</div>', f'<main><div{named("content", "post")} data-content="1">{inner}</div></main>', f'<div data-content="1">{inner}</div>', f'<section data-content="1">{inner}</section>', inner], [6, 2, 2, 4, 2, 1, 1, 2])[0]
        mark = ' data-content="1"' if body is inner else ''
        wrap = r.random()
        whole = "".join(junk_before[: r.randint(0, 4)]) + body + "".join(junk_after[: r.randint(0, 4)])
        if wrap < 0.2 and not mark:
            whole = f'<div class="{word()}">{whole}</div>'
        if mark and r.random() < 0.5:
            return f"<div{mark}>{whole}</div>" if r.random() < 0.5 else f"<html{mark}>{whole}"
        return f'<!DOCTYPE html><html><head data-content="0"><title>{sentence(2, 9)}</title><script>var a="<p>";</script></head><body{mark}>{whole}</body></html>'

    return [page() for _ in range(n)]


def trained(pages: list[str] | None = None) -> DomModel:
    return DomModel().learn(pages or training_pages()).ready()


def extract(pages: DataFrame, model: DomModel | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    ship_package(pages.sparkSession)
    model = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [main_text(h, model) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["c0", "c1", "c2", "c3"])

    kinds = [pages.schema[n].dataType.simpleString() for n in ("page_id", "url")]
    rows = pages.select("page_id", "url", F.col("html"))
    return rows.mapInArrow(run, f"c0 {kinds[0]}, c1 {kinds[1]}, c2 string, c3 bigint").toDF("page_id", "url", "text", "n_chars")
