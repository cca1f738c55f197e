"""Operator 4, main text of HTML pages: gradient-boosted trees over DOM nodes, decoded on the tree.

A tolerant parser builds the page's tree; runs of text inside a block are its leaves. Boosted trees give every element and
leaf the log-odds of holding main text, from its tag, attribute tokens, depth, subtree densities, and its place among its
siblings and ancestors. Decoding picks the labels of greatest total log-odds under one rule: what is kept lies in kept
ancestors. So a paragraph in a dropped block can't survive, and a block with enough good text pulls its container in.

The trees are trained here on pages that this module writes itself (`sample_page`), with layouts drawn at random.

Defined results: null or empty html gives an empty text. Unclosed and unknown tags, broken references and pages that end
inside a tag are read as far as they go. Rows repeat or ids are null: each is read alone; other columns pass by unread; an
empty table gives an empty table. A page of any length, depth or number of siblings is read whole.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_arrow

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text isn't read: code, form controls, drawings. What media, objects and formulas hold is text.
SILENT = frozenset("script style head title noscript template svg iframe select button textarea datalist".split())
RAW = frozenset("script style title textarea iframe noscript".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img object map canvas audio video meter progress output math semantics annotation maction mrow mi mn mo ms mtext mspace mfrac msqrt mroot msup msub msubsup mover munder munderover mmultiscripts mstyle mpadded mphantom menclose merror".split())
PARAGRAPH_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

#: Attribute tokens that speak for or against main text.
GOOD = frozenset("article articlebody body content entry main maincontent page post story text prose markdown longform".split())
BAD = frozenset(
    "ad ads advert advertisement adsense adslot banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside rail footer foot header masthead topbar cookie cookies consent notice alert popup modal overlay gdpr comment comments reply replies respond disqus discussion share sharing social follow related recommended recommendations more subscribe newsletter signup login search form widget pagination pager tags meta byline toolbar hidden copyright legal disclaimer".split()
)
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+)(>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    tokens: frozenset = frozenset()
    hidden: bool = False
    label: int | None = None
    text: str | None = None  # of a leaf
    in_link: int = 0  # characters of a leaf that stand in links
    children: list = field(default_factory=list)


def _attributes(raw: str) -> tuple[frozenset, bool, int | None]:
    words, hidden, label = set(), False, None
    for m in _ATTRIBUTE.finditer(raw):
        name, value = m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or "")
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            words |= set(_WORD.findall(_CAMEL.sub(" ", value).lower()))
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = True
        elif name == "data-main-text":
            label = int(value == "1")
    return frozenset(words), hidden, label


def parse(page: str | None) -> list[Node]:
    """Nodes in page order, the root first. Inline elements add no node: their text belongs to the block around them."""
    nodes = [Node("#root", -1, 0)]
    stack: list[tuple[str, int]] = [("#root", 0)]  # open elements; inline ones point at their block
    page = page or ""
    run: list[str] = []
    run_link, links, silent = 0, 0, 0

    def flush():
        nonlocal run_link
        if run:
            text = _SPACE.sub(" ", "".join(run)).strip()
            if text:
                block = stack[-1][1]
                nodes[block].children.append(len(nodes))
                nodes.append(Node("#text", block, nodes[block].depth + 1, text=text, in_link=min(run_link, len(text)), label=nodes[block].label))
            run.clear()
        run_link = 0

    def say(text: str):
        nonlocal run_link
        if text and not silent:
            text = entities.unescape(text) if "&" in text else text
            run.append(text)
            if links:
                run_link += len(text.strip())

    def pop_to(depth: int):
        nonlocal links, silent
        while len(stack) > depth:
            tag, block = stack[-1]
            if tag not in INLINE and not silent:
                flush()
            stack.pop()
            links -= tag == "a"
            silent -= tag in SILENT

    at, end = 0, len(page)
    while at < end:
        i = page.find("<", at)
        if i < 0:
            say(page[at:])
            break
        say(page[at:i])
        m = _TOKEN.match(page, i)
        if m is None:
            say("<")
            at = i + 1
            continue
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or m[4] != ">":  # comment, declaration, or the page's end inside a tag
            continue
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
                if tag in INLINE and stack[k][0] not in INLINE:  # an inline end tag doesn't close blocks
                    break
            continue
        if tag in PARAGRAPH_ENDS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    pop_to(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        if tag in CLOSES:
            closed, scope = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in closed:
                    pop_to(k)
                    if tag != "tr" or stack[-1][0] not in closed:
                        break
                elif stack[k][0] in scope:
                    break
        if tag in INLINE:
            if tag == "br":
                say(" ")
            elif tag not in VOID:
                if tag == "a":
                    for k in range(len(stack) - 1, 0, -1):  # links don't nest
                        if stack[k][0] == "a":
                            pop_to(k)
                            break
                        if stack[k][0] not in INLINE:
                            break
                stack.append((tag, stack[-1][1]))
                links += tag == "a"
            continue
        if tag in VOID:
            if tag == "hr" and not silent:
                flush()
            continue
        if not silent and (tag not in SILENT or tag == "head"):  # silent elements stand inside of lines
            flush()
        if tag in SILENT:
            if tag in RAW:
                closing = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = closing.end() if closing else end
                continue
            stack.append((tag, stack[-1][1]))
            silent += 1
            continue
        if tag == "body" and silent:  # an unclosed head
            pop_to(next(k for k, (t, _) in enumerate(stack) if t in SILENT))
        tokens, hidden, label = _attributes(m[3]) if "=" in m[3] or "hidden" in m[3] else (frozenset(), False, None)
        block = stack[-1][1]
        if hidden:
            stack.append((tag, block))
            # text in hidden blocks isn't part of the page as read
            nodes.append(Node("#hidden", -1, 0))
            stack[-1] = (tag, len(nodes) - 1)
            continue
        nodes[block].children.append(len(nodes))
        nodes.append(Node(tag, block, nodes[block].depth + 1, tokens, label=nodes[block].label if label is None else label))
        stack.append((tag, len(nodes) - 1))
    pop_to(1)
    flush()
    return nodes


GROUPS = ("#text", "p", "li", "article main", "div section td th tbody tr table center", "nav menu", "header", "footer", "aside", "form fieldset", "h1", "h2 h3 h4 h5 h6", "ul ol dl", "blockquote pre figure figcaption", "body html #root")
_GROUP = {t: k for k, g in enumerate(GROUPS) for t in g.split()}
#: Groups in which a node's ancestors are counted.
ABOVE_BAD, ABOVE_GOOD = frozenset({5, 7, 8, 9}), frozenset({3})
FEATURES = 25


def features(nodes: list[Node]) -> np.ndarray:
    """One row for each node: its tag, tokens, depth, subtree, siblings and ancestors."""
    n = len(nodes)
    chars, link, blocks, tags, stops, longest, paragraphs = (np.zeros(n) for _ in range(7))
    for i in range(n - 1, -1, -1):
        v = nodes[i]
        if v.text is not None:
            chars[i], link[i], blocks[i], longest[i] = len(v.text), v.in_link, 1, len(v.text)
            stops[i] = sum(map(v.text.count, ".,;:!?"))
        else:
            tags[i] += 1
            paragraphs[i] += v.tag == "p"
        if v.parent >= 0:
            p = v.parent
            for a in (chars, link, blocks, tags, stops, paragraphs):
                a[p] += a[i]
            longest[p] = max(longest[p], longest[i])
    x = np.zeros((n, FEATURES))
    bad_above, good_above, tag_bad, tag_good = (np.zeros(n) for _ in range(4))
    total = max(1.0, chars[0])
    tags_of = [Counter(nodes[c].tag for c in v.children) if v.children else None for v in nodes]
    order = np.cumsum([len(v.text) if v.text is not None else 0 for v in nodes])
    for i, v in enumerate(nodes):
        group = _GROUP.get(v.tag, 4)
        p = v.parent
        good, bad = len(v.tokens & GOOD), len(v.tokens & BAD)
        if p >= 0:
            bad_above[i] = bad_above[p] + (len(nodes[p].tokens & BAD) > 0 and not nodes[p].tokens & GOOD)
            good_above[i] = good_above[p] + (len(nodes[p].tokens & GOOD) > 0)
            pg = _GROUP.get(nodes[p].tag, 4)
            tag_bad[i], tag_good[i] = tag_bad[p] + (pg in ABOVE_BAD), tag_good[p] + (pg in ABOVE_GOOD)
            kin = nodes[p].children
            same = tags_of[p][v.tag]
            parent_group, parent_chars, kin_n = pg, max(1.0, chars[p]), len(kin)
        else:
            same, parent_group, parent_chars, kin_n = 1, len(GROUPS), max(1.0, chars[i]), 1
        c = max(1.0, chars[i])
        x[i] = (
            group, good, bad, v.depth, np.log1p(chars[i]), link[i] / c, stops[i] / c, np.log1p(blocks[i]), tags[i] / c, np.log1p(longest[i]),
            np.log1p(paragraphs[i]), chars[i] / parent_chars, same, kin_n, parent_group, bad_above[i], good_above[i], tag_bad[i], tag_good[i],
            order[i] / total, chars[i] / total, chars[i] / max(1.0, blocks[i]), group in ABOVE_BAD, group in ABOVE_GOOD, link[i] / max(1.0, blocks[i]),
        )
    return x


@dataclass
class Boosted:
    """Trees of a fixed depth as arrays: feature and cut of each inner node in heap order, values of the leaves."""

    base: float
    feature: np.ndarray  # (trees, 2**depth - 1)
    cut: np.ndarray
    value: np.ndarray  # (trees, 2**depth)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, c, v in zip(self.feature, self.cut, self.value):
            at = np.zeros(len(x), dtype=np.int64)
            while at[0] < inner if len(at) else False:
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Boosted:
    """Logistic boosting with histograms: second-order gains over binned features, a level of all trees' nodes at a time."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])  # code > b exactly if x > edges[b]
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    f = np.full(len(y), base)
    out = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), dtype=np.int64)
        feature, cut = np.zeros(2**depth - 1, dtype=np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            node = at - first
            best = np.full(width, 1e-6)
            where = np.full((width, 2), -1)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                key = node * bins + code[j]
                gs = np.bincount(key, weights=g, minlength=width * bins).reshape(width, bins).cumsum(axis=1)
                hs = np.bincount(key, weights=h, minlength=width * bins).reshape(width, bins).cumsum(axis=1)
                gl, hl, gt, ht = gs[:, : len(e)], hs[:, : len(e)], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                k = gain.argmax(axis=1)
                value = gain[np.arange(width), k]
                better = value > best
                best[better] = value[better]
                where[better] = np.column_stack([np.full(width, j), k])[better]
            for q in range(width):
                if where[q, 0] >= 0:
                    feature[first + q], cut[first + q] = where[q, 0], edges[where[q, 0]][where[q, 1]]
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > cut[at])
        leaf = at - (2**depth - 1)
        value = rate * np.bincount(leaf, weights=g, minlength=2**depth) / (np.bincount(leaf, weights=h, minlength=2**depth) + ridge)
        f += value[leaf]
        out.append((feature, cut, value))
    return Boosted(base, *map(np.stack, zip(*out)))


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Labels of greatest total log-odds in which a kept node's ancestors are kept; the root always is."""
    best = odds.copy()
    for i in range(len(nodes) - 1, 0, -1):
        if nodes[i].parent >= 0 and best[i] > 0:
            best[nodes[i].parent] += best[i]
    keep = np.zeros(len(nodes), dtype=bool)
    keep[0] = True
    for i in range(1, len(nodes)):
        keep[i] = nodes[i].parent >= 0 and keep[nodes[i].parent] and best[i] > 0
    return keep


def text_of(nodes: list[Node], keep: np.ndarray) -> str:
    return "\n\n".join(v.text for v, k in zip(nodes, keep) if k and v.text is not None)


def _words(r: random.Random, n: int) -> str:
    out = []
    while len(out) < n:
        sentence = ["".join(r.choice("bcdfglmnprstv") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(r.randint(2, 14))]
        out += [*sentence[:-1], sentence[-1] + r.choice(".....,;!?")]
    return " ".join(out[:n])


def sample_page(seed: int) -> str:
    """A page of a random layout; data-main-text="1" marks the blocks that are main text, "0" those inside that aren't."""
    r = random.Random(seed)
    w = lambda a, b: _words(r, r.randint(a, b))
    bare = r.random() < 0.25  # no telling tags or attributes around noise

    def block(tag, token, inner):
        if bare and r.random() < 0.5:
            return f"<{tag}>{inner}</{tag}>"
        return f'<{tag} {r.choice(("class", "id"))}="{token}{r.choice(("", "", " clearfix", "-inner", " box"))}">{inner}</{tag}>'

    def links(n):
        return "".join(f'<li><a href="/{k}">{w(1, 3)}</a></li>' for k in range(n))

    def menu():
        inner = f"<ul>{links(r.randint(3, 9))}</ul>"
        return f"<nav>{inner}</nav>" if r.random() < 0.6 else block("div", r.choice(("menu", "navbar", "nav", "breadcrumbs")), inner)

    def advert():
        return block(r.choice(("div", "div", "section", "aside")), r.choice(("ad", "ads", "advert", "promo", "sponsored", "banner")), r.choice((f"<p>{w(3, 30)}</p>", w(3, 20), f'<a href="/x">{w(3, 12)}</a>')))

    def notice():
        return block("div", r.choice(("cookie-notice", "notice", "consent", "alert", "newsletter", "popup")), f"<p>{w(5, 40)}</p>" if r.random() < 0.6 else w(5, 30))

    def comments():
        each = "".join(block("div", r.choice(("comment", "reply")), f"<p>{w(4, 50)}</p>" if r.random() < 0.7 else w(4, 40)) for _ in range(r.randint(1, 6)))
        title = f"<h3>{w(1, 3)}</h3>" if r.random() < 0.5 else ""
        return block(r.choice(("section", "div", "div")), r.choice(("comments", "discussion", "replies")), title + each)

    def sidebar():
        inner = f"<h3>{w(1, 4)}</h3>" + r.choice((f"<ul>{links(r.randint(2, 6))}</ul>", f"<p>{w(5, 40)}</p>", f"<p>{w(5, 20)}</p><p>{w(5, 20)}</p>"))
        return f"<aside>{inner}</aside>" if r.random() < 0.5 else block("div", r.choice(("sidebar", "related", "widget", "rail")), inner)

    def form():
        return f'<form action="/s"><label>{w(1, 4)}</label><input name="q"><p>{w(2, 15)}</p><button>{w(1, 2)}</button></form>'

    def footer():
        inner = r.choice((f"&copy; {w(2, 6)} &middot; {w(2, 30)}", f"<p>&copy; {w(3, 40)}</p>", f"<ul>{links(3)}</ul><p>{w(3, 12)}</p>"))
        return f"<footer>{inner}</footer>" if r.random() < 0.7 else block("div", r.choice(("footer", "copyright", "legal")), inner)

    def header():
        inner = f"<h2>{w(1, 4)}</h2>" if r.random() < 0.5 else f'<a href="/">{w(1, 3)}</a> {w(1, 6)}'
        return f"<header>{inner}</header>" if r.random() < 0.7 else block("div", r.choice(("header", "masthead", "topbar")), inner)

    body = []
    if r.random() < 0.9:
        body.append(f"<h1>{w(1, 12)}</h1>")
    for _ in range(r.choice((1, 1, 2, 3, 4, 6, 9, 15))):
        kind = r.random()
        words = w(1, 8) if r.random() < 0.2 else w(8, 120)
        if kind < 0.62:
            body.append(f"<p>{words}</p>" if r.random() < 0.7 else f"<p><b>{words}<br>")
        elif kind < 0.72:
            body.append(f"<h2>{w(1, 8)}</h2>")
        elif kind < 0.8:
            body.append("<ul>" + "".join(f"<li>{w(2, 20)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
        elif kind < 0.86:
            body.append(f"<blockquote><p>{words}</p></blockquote>")
        elif kind < 0.92:
            body.append(f'<p>{w(3, 20)} <a href="/y">{w(1, 4)}</a> {w(3, 20)}</p>')
        else:
            body.append(f"<div>{words}</div>")
    inside = []
    for part in (advert, comments, sidebar, menu, form, notice):
        if r.random() < 0.1:
            inside.append(part().replace(">", ' data-main-text="0">', 1))
    for part in inside:
        body.insert(r.randint(1, len(body)) if len(body) > 1 else len(body), part)
    kind = r.random()
    if kind < 0.55:
        tag, attrs = "article", r.choice(("", "", ' class="post"'))
    elif kind < 0.7:
        tag, attrs = "main", ""
    elif kind < 0.92:
        tag, attrs = r.choice(("div", "section")), f' {r.choice(("class", "id"))}="{r.choice(("content", "main-content", "entry-content", "post-body", "article", "story"))}"'
    else:
        tag, attrs = "div", ""
    main = f'<{tag}{attrs} data-main-text="1">{"".join(body)}</{tag}>'
    before = [f() for f in (header, menu, advert, notice, form) if r.random() < 0.5]
    after = [f() for f in (comments, sidebar, advert, form, notice) if r.random() < 0.4]
    r.shuffle(before)
    r.shuffle(after)
    if r.random() < 0.9:
        after.append(footer())
    inner = "".join([*before, main, *after])
    if r.random() < 0.3:
        inner = f'<div class="{r.choice(("wrapper", "container", "page", "layout"))}">{inner}</div>'
    return f"<!DOCTYPE html><html><head><title>{w(1, 6)}</title><style>p{{}}</style><script>1;</script></head><body>{inner}</body></html>"


SAMPLE_PAGES = 700  #: pages to learn from


@lru_cache(maxsize=1)
def model(pages: int = SAMPLE_PAGES) -> Boosted:
    xs, ys = [], []
    for seed in range(pages):
        nodes = parse(sample_page(seed))
        label = np.array([v.label == 1 if v.text is not None else False for v in nodes])
        for i in range(len(nodes) - 1, 0, -1):  # an element holds main text if a leaf below does
            label[nodes[i].parent] |= label[i]
        xs.append(features(nodes))
        ys.append(label)
    return boost(np.concatenate(xs), np.concatenate(ys).astype(float))


def extract_pages(pages: list[str | None], trees: Boosted, step: int = 256) -> list[str]:
    out = []
    for lo in range(0, len(pages), step):
        parsed = [parse(p) for p in pages[lo : lo + step]]
        odds = trees.log_odds(np.concatenate([features(n) for n in parsed]))
        at = 0
        for nodes in parsed:
            out.append(text_of(nodes, decode(nodes, odds[at : at + len(nodes)])))
            at += len(nodes)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model())

    def run(c):
        text = extract_pages(c["html"], shared.value)
        return {"page_id": c["page_id"], "url": c["url"], "text": text, "n_chars": list(map(len, text))}

    return map_arrow(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")
