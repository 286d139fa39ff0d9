"""Main text of HTML pages by a tree-structured graphical model.

A page's block elements are nodes of a tree. Each node has a unary potential (linear in
its tag, attribute cues, link share and text) and each edge a parent-child potential.
Sum-product messages up and down the tree give each node's marginal of being content; the
text of content nodes, in page order, is the result. The trees of a batch of pages are one
forest, so a message pass is a few array operations for each depth.

The model is trained here from labelled pages that ``labelled_pages`` makes: articles
of several layouts among menus, headers, sidebars, adverts, notices, forms and comments. Unary
and parent-child potentials are fitted together, by the conditional likelihood of the labels.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import slices, texts

#: A comment, a declaration, a tag (a quote counts only after an equals sign) or text.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|\Z)|[^<]+|<", re.S)
_ATTR = re.compile(r"(class|id|role|aria-label|hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_CUE = re.compile(r"[a-z]+")

#: Elements whose content is no part of a page's text.
RAW = frozenset(("script", "style", "template", "textarea", "iframe", "title", "select"))
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I) for name in RAW}
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"))
TAGS = "html head body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre figure figcaption nav header footer aside form fieldset address details summary".split()
#: Elements that begin and end a block of text; all others, unknown ones too, run along with the text around them.
BLOCKS = frozenset((*TAGS, "thead", "tbody", "tfoot", "caption", "legend", "center", "hgroup", "dialog", "menu", "dir", "search", "option", "optgroup"))
#: Siblings that a block ends, up to the next element of SCOPE.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset(("ul", "ol", "dl", "table", "body", "html"))

CUES = {
    "good": "article content main post entry story text body page".split(),
    "menu": "nav menu navbar breadcrumb breadcrumbs toc pagination pager tabs links".split(),
    "head": "header masthead banner topbar logo branding".split(),
    "foot": "footer foot copyright legal colophon bottom".split(),
    "side": "sidebar side aside widget related recommended trending popular rail more".split(),
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner".split(),
    "talk": "comment comments reply replies disqus respond discussion thread reader feedback".split(),
    "note": "cookie cookies consent notice popup modal newsletter subscribe signup alert gdpr overlay".split(),
    "form": "form login search register input".split(),
    "share": "share social tags meta byline follow".split(),
}
_CUE_OF = {w: k for k, ws in enumerate(CUES.values()) for w in ws}
_TAG_AT = {t: k for k, t in enumerate(TAGS)}
_CUE0 = len(TAGS) + 1
_ABOVE = _CUE0 + len(CUES)
_REST = _ABOVE + len(CUES)
WIDTH = _REST + 9
CUT = 0.5
_STRUCTURAL = frozenset(("nav", "header", "footer", "aside", "form", "article", "main", "section", "div", "body", "ul", "ol", "table"))


@dataclass(slots=True)
class Node:
    tag: str
    attrs: str
    parent: int
    depth: int
    chars: int = 0
    linked: int = 0
    links: int = 0


class _Scope:
    """An open block: its node, the inline elements open in it, and the siblings it may still end."""

    __slots__ = ("count", "inline", "node", "reach", "tag")

    def __init__(self, tag: str, node: int, reach: dict[str, int]):
        self.tag, self.node, self.reach = tag, node, reach
        self.inline: list[str] = []
        self.count: dict[str, int] = {}


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """The block elements of a page, parents before children, and (node, text) of each block in page order.

    Every tag is looked at once and every element opened and closed once, so time is linear in the page,
    whatever is left open.
    """
    nodes = [Node("html", "", -1, 0)]
    scopes = [_Scope("html", 0, {})]
    open_tags: Counter = Counter()
    blocks: list[list] = []  # [node, pieces]
    fresh, anchors, at, n = True, 0, 0, len(page)
    match = _TOKEN.match

    def close_to(depth: int) -> None:
        """The scopes from ``depth`` on are closed."""
        nonlocal anchors
        for s in scopes[depth:]:
            open_tags[s.tag] -= 1
            anchors -= s.count.get("a", 0)
        del scopes[depth:]

    while at < n:
        m = match(page, at)
        at = m.end()
        name = m[2]
        top = scopes[-1]
        if name is None:
            s = m[0]
            if s[0] == "<" and len(s) > 1:
                continue
            if fresh or blocks[-1][0] != top.node:
                if s.isspace():
                    continue
                if top.tag == "head":
                    close_to(len(scopes) - 1)
                    top = scopes[-1]
                blocks.append([top.node, []])
                fresh = False
            blocks[-1][1].append(s)
            node = nodes[top.node]
            node.chars += len(s)
            if anchors:
                node.linked += len(s)
            continue
        closing, name, attrs = m[1], name.lower(), m[3]
        if name in RAW:
            if not closing:
                end = _RAW_END[name].search(page, at)
                at = end.end() if end else n
            continue
        if name in VOID:
            if name == "br" and blocks and not fresh:
                blocks[-1][1].append(" ")
            elif name == "hr":
                fresh = True
            continue
        if name not in BLOCKS:
            if not closing:
                if attrs.endswith("/") and name not in ("a", "b", "i", "em", "strong", "span"):
                    continue
                top.inline.append(name)
                top.count[name] = top.count.get(name, 0) + 1
                if name == "a":
                    anchors += 1
                    nodes[top.node].links += 1
            elif top.count.get(name):
                while (x := top.inline.pop()) != name:
                    top.count[x] -= 1
                    anchors -= x == "a"
                top.count[name] -= 1
                anchors -= name == "a"
            continue
        fresh = True
        if name == "html":
            continue
        if closing:
            if name == "body":
                continue
            if name in CLOSES:
                if name in top.reach:
                    close_to(top.reach[name])
            elif open_tags[name] > 0:
                depth = len(scopes) - 1
                while scopes[depth].tag != name:
                    depth -= 1
                close_to(depth)
            continue
        if open_tags["head"] > 0 and name != "head":
            close_to(next(k for k, s in enumerate(scopes) if s.tag == "head"))
        ends = [top.reach[x] for x in CLOSES.get(name, ()) if x in scopes[-1].reach]
        if ends:
            close_to(min(ends))
        elif scopes[-1].tag == "p":
            close_to(len(scopes) - 1)
        top = scopes[-1]
        nodes.append(Node(name, attrs, top.node, nodes[top.node].depth + 1))
        reach = {} if name in SCOPE else top.reach
        if name in CLOSES:
            reach = {**reach, name: len(scopes)}
        scopes.append(_Scope(name, len(nodes) - 1, reach))
        open_tags[name] += 1
    return nodes, [(b[0], "".join(b[1])) for b in blocks]


_CUES_OF: dict[str, tuple[tuple[int, ...], bool]] = {}


def _cues(attrs: str) -> tuple[tuple[int, ...], bool]:
    """Numbers of the cues that an element's attributes name, and whether it is hidden."""
    got = _CUES_OF.get(attrs)
    if got is None:
        found, hidden = set(), False
        for m in _ATTR.finditer(attrs):
            kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if kind in ("hidden", "style"):
                hidden = hidden or kind == "hidden" or "none" in value
            else:
                found.update(_CUE_OF[w] for w in _CUE.findall(value.lower()) if w in _CUE_OF)
        if len(_CUES_OF) > 50_000:
            _CUES_OF.clear()
        got = _CUES_OF[attrs] = (tuple(found), hidden)
    return got


class Forest:
    """The trees of several pages: features, parents, and nodes by depth."""

    def __init__(self, trees: list[list[Node]]):
        nodes = [n for t in trees for n in t]
        base = np.repeat(np.cumsum([0, *map(len, trees)])[:-1], [len(t) for t in trees]) if trees else np.zeros(0, np.int64)
        self.parent = np.array([n.parent for n in nodes], np.int64) + base
        depth = np.array([n.depth for n in nodes], np.int64)
        order = np.argsort(depth, kind="stable")
        cut = np.searchsorted(depth[order], np.arange(int(depth.max(initial=-1)) + 2))
        self.levels = [order[a:b] for a, b in zip(cut, cut[1:])]
        self.kind = np.array([n.tag in _STRUCTURAL for n in nodes], np.int64)
        x = np.zeros((len(nodes), WIDTH))
        for i, n in enumerate(nodes):
            x[i, _TAG_AT.get(n.tag, len(TAGS))] = 1
            if n.attrs:
                found, hidden = _cues(n.attrs)
                for k in found:
                    x[i, _CUE0 + k] = 1
                x[i, _REST + 8] = hidden
        inside = x[:, _ABOVE:_REST]
        for level in self.levels[1:]:
            up = self.parent[level]
            inside[level] = np.maximum(inside[up], x[up, _CUE0:_ABOVE])
        chars, linked, links = (np.array([getattr(n, f) for n in nodes], float) for f in ("chars", "linked", "links"))
        x[:, _REST : _REST + 8] = np.stack((
            np.minimum(np.log1p(chars), 6) / 6, linked / np.maximum(chars, 1), np.minimum(links, 5) / 5, chars > 0, chars > 80,
            (chars > 0) & (chars <= 25), np.array([n.parent == 0 for n in nodes], float), np.ones(len(nodes)),
        ), 1) if len(nodes) else np.zeros((0, 8))
        self.x = x


@dataclass
class Model:
    weights: np.ndarray
    pair: np.ndarray  # log potential of (parent label, child label), for other and for structural children


def beliefs(forest: Forest, score: np.ndarray, pair: np.ndarray, edges: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Each node's marginal of being content, by log messages up and then down the trees; with ``edges``, expected label pairs by kind of child."""
    n = len(score)
    local = np.stack([np.zeros(n), score], 1)
    up, said, down = np.zeros((n, 2)), np.zeros((n, 2)), np.zeros((n, 2))
    even = lambda m: m - np.logaddexp(m[:, :1], m[:, 1:])
    for level in reversed(forest.levels[1:]):
        a = (local[level] + up[level])[:, None, :] + pair[forest.kind[level]]
        said[level] = m = even(np.logaddexp(a[:, :, 0], a[:, :, 1]))
        q = forest.parent[level]
        lo = q.min()
        if q.max() - lo > 64 * len(q):  # few parents far apart
            np.add.at(up, q, m)
            continue
        for y in (0, 1):
            part = np.bincount(q - lo, m[:, y])
            up[lo : lo + len(part), y] += part
    seen = np.zeros((2, 2, 2))
    for level in forest.levels[1:]:
        q, k = forest.parent[level], forest.kind[level]
        a = (local[q] + down[q] + up[q] - said[level])[:, :, None] + pair[k]
        down[level] = even(np.logaddexp(a[:, 0], a[:, 1]))
        if edges:
            a = a + (local[level] + up[level])[:, None, :]
            a = np.exp(a - a.max((1, 2), keepdims=True))
            np.add.at(seen, k, a / a.sum((1, 2), keepdims=True))
    total = local + up + down
    return np.exp(total[:, 1] - np.logaddexp(total[:, 0], total[:, 1])), seen


def marginals(trees: list[list[Node]], model: Model) -> np.ndarray:
    """Each node's probability of being content, tree after tree."""
    forest = Forest(trees)
    return beliefs(forest, forest.x @ model.weights, model.pair)[0]


def extract_all(pages: list[str], model: Model) -> list[str]:
    """The main text of each page."""
    parsed = [parse(p) for p in pages]
    content, out, base = marginals([nodes for nodes, _ in parsed], model) > CUT, [], 0
    for nodes, blocks in parsed:
        done = (" ".join(entities.unescape(t).split()) for i, t in blocks if content[base + i])
        out.append("\n\n".join(t for t in done if t))
        base += len(nodes)
    return out


def extract(page: str, model: Model) -> str:
    return extract_all([page], model)[0]


# --- labelled pages -----------------------------------------------------------------


def labelled_pages(count: int = 200, seed: int = 11) -> list[tuple[str, str]]:
    """(html, main text) of made-up pages."""
    r = random.Random(seed)
    words = ["".join(r.choice(("ka", "lo", "mi", "ran", "tes", "vu", "sol", "per", "ni", "da")) for _ in range(r.randint(1, 4))) for _ in range(400)]

    def say(lo: int, hi: int) -> str:
        return " ".join(r.choice(words) for _ in range(r.randint(lo, hi))).capitalize() + r.choice((".", ".", ".", "!", "?", ""))

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{r.choice(words)}">{say(1, 3)}</a></li>' for _ in range(n)) + "</ul>"

    def attr(*names: str) -> str:
        return f' {r.choice(("class", "class", "id"))}="{r.choice(names)}"' if names and r.random() < 0.9 else ""

    def noise(kind: str) -> str:
        if kind == "nav":
            return r.choice((f"<nav>{links(r.randint(3, 9))}</nav>", f'<div{attr("menu", "navbar", "main-nav")}>{links(r.randint(3, 8))}</div>', f"<nav><a href=/>{say(1, 2)}</a> | <a href=/x>{say(1, 2)}</a></nav>"))
        if kind == "header":
            return r.choice((f"<header><h1>{say(1, 3)}</h1><p>{say(2, 6)}</p></header>", f'<div{attr("header", "masthead", "site-header")}><a href="/">{say(1, 2)}</a><p>{say(1, 5)}</p></div>', f"<header>{noise('nav')}</header>"))
        if kind == "footer":
            return r.choice((f"<footer>&copy; {say(1, 2)} &middot; {say(2, 12)}</footer>", f"<footer><p>{say(4, 20)}</p>{links(3)}</footer>", f'<div{attr("footer", "site-footer", "legal")}><p>&copy; {say(3, 15)}</p></div>'))
        if kind == "ad":
            return r.choice((f'<div class="{r.choice(("ad", "ads", "advert", "sponsored", "promo", "ad-slot"))}">{say(2, 25)}</div>', f'<aside class="ad"><p>{say(3, 20)}</p></aside>', f'<div class="ad"><a href="/buy">{say(2, 8)}</a></div>'))
        if kind == "side":
            return r.choice((f"<aside><h3>{say(1, 3)}</h3>{links(r.randint(2, 6))}</aside>", f'<div{attr("sidebar", "related", "widget")}><h2>{say(1, 2)}</h2><p>{say(4, 20)}</p>{links(3)}</div>', f"<aside><p>{say(5, 30)}</p></aside>"))
        if kind == "notice":
            return f'<{(t := r.choice(("div", "section", "aside")))} class="{r.choice(("cookie-notice", "notice", "cookie-banner", "newsletter", "consent", "alert"))}"><p>{say(4, 20)}</p><button>{say(1, 2)}</button></{t}>'
        if kind == "form":
            return r.choice((f'<form action="/s"><label>{say(1, 3)}</label><input name=q><button>{say(1, 1)}</button></form>', f'<form class="signup"><p>{say(3, 12)}</p><input type=email></form>', f"<form><fieldset><legend>{say(1, 2)}</legend><p>{say(3, 9)}</p></fieldset></form>"))
        if kind == "comments":
            t, c = r.choice(("div", "section", "ol")), r.choice(("comments", "comment-list", "discussion", "reader-comments", "replies"))
            inner = ""
            for _ in range(r.randint(1, 4)):
                one = "li" if t == "ol" else r.choice(("div", "article"))
                inner += f'<{one} class="comment"><p>{say(4, 40)}</p></{one}>'
            return f'<{t} {r.choice(("class", "id"))}="{c}"><h3>{say(1, 2)}</h3>{inner}</{t}>'
        return f"<script>var t='</p>';{r.choice(words)}(0);</script>" if kind == "script" else f"<!-- {say(1, 3)} -->"

    def body(noisy: float) -> tuple[str, list[str]]:
        parts, said = [], []

        def put(tag: str, text: str, close: bool = True) -> None:
            said.append(text)
            shown = text.replace("&", "&amp;")
            if r.random() < 0.3:
                k = r.choice(("b", "em", "strong", "span"))
                at = shown.find(" ")
                shown = f"<{k}>{shown[:at]}</{k}>{shown[at:]}" if at > 0 else shown
            if r.random() < 0.12 and " " in shown:
                at = shown.rfind(" ")
                shown = f'{shown[:at]} <a href="/{r.choice(words)}">{shown[at + 1:]}</a>'
            parts.append(f"<{tag}>{shown}" + (f"</{tag}>" if close else ""))

        if r.random() < 0.8:
            put("h1", say(1, 9))
        for _ in range(r.randint(1, 7)):
            form = r.random()
            if form < 0.7:
                put("p", say(1, 12) if r.random() < 0.3 else say(10, 90), r.random() < 0.9)
            elif form < 0.8:
                put("h2", say(1, 5))
            elif form < 0.87:
                parts.append("<blockquote>"), put("p", say(5, 30)), parts.append("</blockquote>")
            elif form < 0.89:
                parts.append("<table><tr>"), put("td", say(1, 6)), put("td", say(1, 6)), parts.append("</tr></table>")
            elif form < 0.91:
                parts.append("<figure><img src=x>"), put("figcaption", say(3, 12)), parts.append("</figure>")
            elif form < 0.95:
                tag = r.choice(("ul", "ol"))
                parts.append(f"<{tag}>")
                for _ in range(r.randint(2, 5)):
                    put("li", say(2, 14))
                parts.append(f"</{tag}>")
            else:
                tag = r.choice(("div", "section"))
                parts.append(f"<{tag}>"), put("p", say(5, 40)), put("p", say(5, 40)), parts.append(f"</{tag}>")
            if r.random() < noisy:
                parts.append(noise(r.choice(("ad", "ad", "script", "form", "notice", "side", "mark"))))
        return "".join(parts), said

    out = []
    for _ in range(count):
        inner, said = body(0.12)
        form = r.random()
        if form < 0.55:
            main = f"<article>{inner}</article>"
        elif form < 0.75:
            main = f"<main>{inner}</main>" if r.random() < 0.5 else f"<main><article>{inner}</article></main>"
        else:
            main = f'<div{attr("content", "post-body", "article", "entry-content", "main", "story")}>{inner}</div>'
        if r.random() < 0.3:
            talk = noise("comments")
            main = main.replace("</article>", talk + "</article>") if r.random() < 0.4 and "</article>" in main else main + talk
        before = [noise(k) for k in ("header", "nav", "ad", "notice", "mark") if r.random() < 0.6]
        after = [noise(k) for k in ("side", "form", "ad", "script") if r.random() < 0.35]
        wrap = ("<div>", "</div>") if r.random() < 0.25 else ("", "")
        foot = noise("footer") if r.random() < 0.85 else ""
        page = f"<!DOCTYPE html><html><head><title>{say(1, 5)}</title><style>p{{margin:0}}</style></head><body>{''.join(before)}{wrap[0]}{main}{''.join(after)}{wrap[1]}{foot}</body></html>"
        out.append((page, "\n\n".join(" ".join(s.split()) for s in said)))
    return out


def labels(nodes: list[Node], blocks: list[tuple[int, str]], main: str) -> list[int]:
    """1 for each node that is content: most text of its own is in the main text, or a child is content."""
    wanted = set(main.split("\n\n"))
    votes = [0] * len(nodes)
    for i, t in blocks:
        votes[i] += 1 if " ".join(entities.unescape(t).split()) in wanted else -1
    y = [int(v > 0) for v in votes]
    for i in range(len(nodes) - 1, 0, -1):
        y[nodes[i].parent] |= y[i]
    return y


def train(pages: list[tuple[str, str]] | None = None, *, rounds: int = 120, rate: float = 0.5, decay: float = 2e-5) -> Model:
    """Unary weights and parent-child potentials from (html, main text) pages.

    Gradient ascent (Adam) on the log likelihood of the labels: what is observed less what the
    messages expect, for features and for pairs of labels alike; ``decay`` draws weights to zero.
    """
    parsed = [(*parse(page), main) for page, main in (labelled_pages() if pages is None else pages)]
    forest = Forest([nodes for nodes, _, _ in parsed])
    y = np.array([v for nodes, blocks, main in parsed for v in labels(nodes, blocks, main)], np.int64)
    child = np.concatenate([*forest.levels[1:], np.zeros(0, np.int64)])
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (forest.kind[child], y[forest.parent[child]], y[child]), 1)
    scale = np.sqrt((forest.x**2).mean(0) + 1e-3) if len(y) else np.ones(WIDTH)
    z = forest.x / scale
    at, first, second = np.zeros(WIDTH + 8), np.zeros(WIDTH + 8), np.zeros(WIDTH + 8)
    for k in range(1, rounds + 1):
        p, expected = beliefs(forest, z @ at[:WIDTH], at[WIDTH:].reshape(2, 2, 2), edges=True)
        slope = np.concatenate([z.T @ (y - p), (seen - expected).ravel()]) / max(1, len(y)) - decay * at
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        at = at + rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    return Model(at[:WIDTH] / scale, at[WIDTH:].reshape(2, 2, 2))


def extracted(pages: DataFrame, model: Model | None = None, *, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row; other columns go.

    A null page is an empty one; its text is empty. Null keys and repeated rows stay, empty tables give no
    rows, pages of any length are read whole. No shuffle.
    """
    model = model or train()
    a, b = pages.schema[key].dataType.simpleString(), pages.schema[url].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200, 4 << 20):
            done = extract_all(texts(batch.column(2)), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(done, pa.string()), pa.array([len(t) for t in done], pa.int64())], names=[key, url, "text", "n_chars"])

    return pages.select(F.col(key), F.col(url), F.col(page)).mapInArrow(run, f"`{key}` {a}, `{url}` {b}, text string, n_chars long")
