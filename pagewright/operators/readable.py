"""Main content of a page without `article` and `main`: paragraphs score their ancestors, and the best block takes its kin along.

One pass over the tree counts text, commas and linked text of every element; then each paragraph hands points to the
elements around it, fewer with distance; blocks lose points by the share of their text that stands in links. The best block
may give way to one around it, and siblings that score well enough or read like prose join it. A result that is too short is tried
again with fewer assumptions: first without dropping what looks unlikely, then without points for names, then without cleaning.
"""

from __future__ import annotations

import re

#: The patterns and points of the public readability heuristic.
UNLIKELY = re.compile(
    r"-ad-|ai2html|banner|breadcrumbs|combx|comment|community|cover-wrap|disqus|extra|footer|gdpr|header|legends|menu|related|remark|replies|rss|shoutbox|sidebar|skyscraper|social|sponsor|supplemental|ad-break|agegate|pagination|pager|popup|yom-remote", re.I
)
MAYBE = re.compile(r"and|article|body|column|content|main|shadow", re.I)
GOOD = re.compile(r"article|body|content|entry|hentry|h-entry|main|page|pagination|post|text|blog|story", re.I)
BAD = re.compile(r"-ad-|hidden|^hid$| hid$| hid |^hid |banner|combx|comment|com-|contact|footer|gdpr|masthead|media|meta|outbrain|promo|related|scroll|share|shoutbox|sidebar|skyscraper|sponsor|shopping|tags|widget", re.I)
UNLIKELY_ROLES = frozenset("menu menubar complementary navigation alert alertdialog dialog".split())
TAG_POINTS = {"div": 5, "pre": 3, "td": 3, "blockquote": 3} | dict.fromkeys("address ol ul dl dd dt li form".split(), -3) | dict.fromkeys("h1 h2 h3 h4 h5 h6 th".split(), -5)
NAME_POINTS = 25
LEAST_PARAGRAPH, ENOUGH, LEVELS, TOP = 25, 500, 5, 5

_PARAGRAPHS = frozenset("section h2 h3 h4 h5 h6 p td pre".split())
_BLOCKS = frozenset("blockquote dl div img ol p pre table ul section article h1 h2 h3 h4 h5 h6".split())
_COMMAS = re.compile("[,،﹐︐︑⹁⸴⸲，]")


def _names(e) -> list[str]:
    return [x for x in (e.attrs.get("class"), e.attrs.get("id")) if x]


def name_points(e) -> int:
    """25 for each of class and id that sounds like content, -25 for each that sounds like something else."""
    return sum(NAME_POINTS * (bool(GOOD.search(n)) - bool(BAD.search(n))) for n in _names(e))


class _Attempt:
    def __init__(self, body, unlikely: bool, names: bool, clean: bool):
        self.body, self.names, self.clean = body, names, clean
        self.gone: set[int] = set()
        self.seen: dict[int, tuple[int, int, int]] = {}  # of an element: characters, commas, characters in links
        self.order: list = []
        self._measure(body, unlikely, False)
        self.points: dict[int, float] = {}
        self.blocks: dict[int, object] = {}

    def _measure(self, e, unlikely: bool, inside: bool) -> tuple[int, int, int]:
        """Counts below e, leaving out what is dropped. inside: of a table or code, which keep what they hold."""
        from .dom import El

        self.order.append(e)
        chars = commas = linked = 0
        for k in e.kids:
            if isinstance(k, El):
                name = " ".join(_names(k))
                odd = unlikely and not inside and k.tag not in ("body", "a") and (k.attrs.get("role") in UNLIKELY_ROLES or UNLIKELY.search(name) and not MAYBE.search(name))
                if odd or k.tag in ("script", "style", "noscript", "template", "head"):
                    self.gone.add(id(k))
                    continue
                c, m, n = self._measure(k, unlikely, inside or k.tag in ("table", "code"))
                linked += c if k.tag == "a" else n
            else:
                text = re.sub(r"\s+", " ", k)
                c, m = len(text) - (text == " "), len(_COMMAS.findall(text))
            chars, commas = chars + c, commas + m
        self.seen[id(e)] = chars, commas, linked
        return chars, commas, linked

    def density(self, e) -> float:
        chars, _, linked = self.seen[id(e)]
        return linked / chars if chars else 0.0

    def _paragraph(self, e) -> bool:
        from .dom import El

        if e.tag in _PARAGRAPHS:
            return True
        return e.tag == "div" and not any(isinstance(k, El) and (k.tag in _BLOCKS or any(x.tag in _BLOCKS for x in k.walk())) for k in e.kids)

    def score(self) -> None:
        for e in self.order:
            chars, commas, _ = self.seen[id(e)]
            if chars < LEAST_PARAGRAPH or not self._paragraph(e):
                continue
            worth, around, level = 1 + commas + min(chars // 100, 3), e.up, 0
            while around is not None and around.up is not None and level < LEVELS:
                if id(around) not in self.points:
                    self.points[id(around)] = TAG_POINTS.get(around.tag, 0) + (name_points(around) if self.names else 0)
                    self.blocks[id(around)] = around
                self.points[id(around)] += worth / (1 if level == 0 else 2 if level == 1 else level * 3)
                around, level = around.up, level + 1
        for k, e in self.blocks.items():
            self.points[k] *= 1 - self.density(e) if k in self.seen else 1

    def best(self):
        """The block with most points, or one around it that several good blocks or its own points speak for."""
        if not self.blocks:
            return None
        ranked = sorted(self.blocks.values(), key=lambda e: -self.points[id(e)])[:TOP]
        top = ranked[0]
        above = lambda e: [] if e.up is None else [e.up, *above(e.up)]
        rivals = [above(e) for e in ranked[1:] if self.points[id(e)] >= 0.75 * self.points[id(top)]]
        if len(rivals) >= 3:
            for around in above(top):
                if around.tag in ("body", "html", "#document"):
                    break
                if sum(any(x is around for x in r) for r in rivals) >= 3:
                    top = around
                    break
        last = self.points.get(id(top), 0.0)
        least = last / 3
        for around in above(top):
            if around.tag in ("body", "html", "#document"):
                break
            own = self.points.get(id(around))
            if own is None:
                continue
            if own < least:
                break
            if own > last:
                top = around
                break
            last = own
        while top.up is not None and top.up.tag not in ("body", "html", "#document") and sum(not isinstance(k, str) and id(k) not in self.gone for k in top.up.kids) == 1:
            top = top.up
        return top

    def with_kin(self, top) -> list:
        """top, and those of its siblings that belong to it."""
        if top.up is None or top.tag in ("body", "html"):
            return [top]
        own = self.points.get(id(top), 0.0)
        least, out = max(10, own * 0.2), []
        for k in top.up.kids:
            if isinstance(k, str) or id(k) in self.gone:
                continue
            if k is top:
                out.append(k)
                continue
            same = k.attrs.get("class") and k.attrs.get("class") == top.attrs.get("class")
            if id(k) in self.points and self.points[id(k)] + (own * 0.2 if same else 0) >= least:
                out.append(k)
            elif k.tag == "p":
                chars, text = self.seen[id(k)][0], k.text().strip()
                if chars > 80 and self.density(k) < 0.25 or 0 < chars < 80 and not self.density(k) and re.search(r"\.( |$)", text):
                    out.append(k)
        return out

    def cleaned(self, kept: list) -> None:
        """Marks lists, tables and blocks inside of the result that look like anything but text."""
        if not self.clean:
            return
        for e in [x for k in kept for x in k.walk()]:
            if e.tag not in ("div", "ul", "ol", "table", "section", "aside") or id(e) in self.gone or id(e) not in self.seen:
                continue
            weight = name_points(e) if self.names else 0
            chars, commas, _ = self.seen[id(e)]
            if weight < 0:
                self.gone.add(id(e))
            elif commas < 10:
                tags = [x.tag for x in e.walk()]
                many = tags.count("li") - 100 > tags.count("p") and e.tag not in ("ul", "ol")
                links = self.density(e) > (0.2 if weight < NAME_POINTS else 0.5)
                if many or links or chars < LEAST_PARAGRAPH and "img" not in tags and e.tag not in ("ul", "ol", "table"):
                    self.gone.add(id(e))


def main_blocks(root) -> tuple[list, set[int]]:
    """(the blocks of the main content in page order, ids of elements inside that are left out); no blocks if nothing has points."""
    body = next((e for e in root.walk() if e.tag == "body"), root)
    most: tuple[int, list, set] = (0, [], set())
    for unlikely, names, clean in ((True, True, True), (False, True, True), (False, False, True), (False, False, False)):
        a = _Attempt(body, unlikely, names, clean)
        a.score()
        top = a.best()
        if top is None:
            continue
        kept = a.with_kin(top)
        a.cleaned(kept)
        size = sum(a.seen[id(k)][0] for k in kept)
        if size >= ENOUGH:
            return kept, a.gone
        if size > most[0]:
            most = size, kept, a.gone
    return most[1], most[2]
