"""Page products that need a tree: Markdown, metadata, links, visible text, selected fields, site audit.

One Arrow UDF parses a page once and returns all products asked for. The tree builder is tolerant (unclosed and implied
tags). Main content is `<article>`, else `<main>`, else what readable.py finds by scores, else the body.
"""

from __future__ import annotations

import gc
import json
import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from . import readable

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
IMPLIED = {"li": ("li", ("ul", "ol")), "tr": ("tr", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "option": ("option", ("select",))}
PRUNED = frozenset("script style svg iframe noscript nav footer form".split())
LEAST_USEFUL, FALLBACK_SHARE = 200, 0.25
HIDDEN = frozenset("script style noscript template".split())
BLOCKS = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form header html li main ol p section table tbody td tfoot th thead tr ul".split())


class El:
    __slots__ = ("tag", "attrs", "kids", "up")

    def __init__(self, tag, attrs=None, up=None):
        self.tag, self.attrs, self.kids, self.up = tag, attrs or {}, [], up

    def walk(self):
        """Elements below, in page order."""
        for k in self.kids:
            if isinstance(k, El):
                yield k
                yield from k.walk()

    def text(self) -> str:
        return "".join(k if isinstance(k, str) else k.text() for k in self.kids)

    def remove(self):
        self.up.kids = [k for k in self.up.kids if k is not self]


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = El("#document")

    def _open(self):
        e = self.at
        while e.up is not None:
            yield e
            e = e.up

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_PARAGRAPH:
            p = next((e for e in self._open() if e.tag in ("p", "td", "th", "li", "button", "table", "blockquote", "div", "section", "article")), None)
            if p is not None and p.tag == "p":
                self.at = p.up
        if tag in IMPLIED:
            closed, scope = IMPLIED[tag]
            old = next((e for e in self._open() if e.tag in closed.split() or e.tag in scope), None)
            if old is not None and old.tag in closed.split():
                self.at = old.up
        el = El(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.kids.append(el)
        if tag not in VOID:
            self.at = el

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        found = next((e for e in self._open() if e.tag == tag), None)
        if found is not None:
            self.at = found.up

    def handle_data(self, data):
        self.at.kids.append(data)


def parse(html: str | None) -> El:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


# Selectors: tag, #id, .class, [attr], [attr op value], descendant, child, commas.
_SIMPLE = re.compile(r"""([a-zA-Z][\w-]*|\*)|#([\w-]+)|\.([\w-]+)|\[\s*([\w:-]+)\s*(?:([~|^$*]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+))\s*)?\]""")


def compile_selector(selector: str):
    out = []
    for alternative in selector.split(","):
        steps, joint = [], " "
        for token in re.findall(r"""\s*>\s*|\s+|(?:[^\s>\["']|\[[^\]]*\])+""", alternative.strip()):
            if not token.strip():
                continue
            if token.strip() == ">":
                joint = ">"
                continue
            tests, at = [], 0
            for m in _SIMPLE.finditer(token):
                if m.start() != at:
                    raise ValueError(f"selector not supported: {selector!r}")
                at = m.end()
                tests.append(m.groups())
            if at != len(token):
                raise ValueError(f"selector not supported: {selector!r}")
            steps.append((joint, tests))
            joint = " "
        out.append(steps)
    return out


def _fits(el: El, tests) -> bool:
    for tag, id_, cls, attr, op, *values in tests:
        value = next((v for v in values if v is not None), None)
        if tag and tag != "*" and el.tag != tag.lower():
            return False
        if id_ and el.attrs.get("id") != id_:
            return False
        if cls and cls not in el.attrs.get("class", "").split():
            return False
        if attr:
            have = el.attrs.get(attr.lower())
            if have is None:
                return False
            if op and not {"=": have == value, "~=": value in have.split(), "|=": have == value or have.startswith(f"{value}-"), "^=": have.startswith(value), "$=": have.endswith(value), "*=": value in have}[op]:
                return False
    return True


def _matches(el: El, steps) -> bool:
    joint, tests = steps[-1]
    if not _fits(el, tests):
        return False
    if len(steps) == 1:
        return True
    up = el.up
    while up is not None and up.tag != "#document":
        if _matches(up, steps[:-1]):
            return True
        if joint == ">":
            return False
        up = up.up
    return False


def select(root: El, selector: str) -> list[El]:
    compiled = compile_selector(selector)
    return [e for e in root.walk() if any(_matches(e, s) for s in compiled)]


def _one_line(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def _absolute(root: El, base: str) -> None:
    for e in root.walk():
        key = "href" if e.tag == "a" else "src" if e.tag == "img" else None
        value = e.attrs.get(key, "") if key else ""
        if value and not re.match(r"#|mailto:|tel:|javascript:|data:", value):
            try:
                e.attrs[key] = urljoin(base, value)
            except ValueError:
                pass


def _prune_link_lists(root: El) -> None:
    """Drops lists and blocks of which four fifths of the text stand in three links or more."""
    solid = lambda e: len(re.sub(r"\s+", "", e.text()))
    for e in list(root.walk()):
        if e.tag not in ("div", "section", "aside", "ul", "ol") or e.attrs.get("id") in ("content", "main") or e.up is None:
            continue
        total = solid(e)
        links = [x for x in e.walk() if x.tag == "a"]
        if total >= 15 and len(links) >= 3 and sum(map(solid, links)) / total >= 0.8:
            e.remove()


def _main_content(root: El) -> El:
    for tag in ("article", "main"):
        found = next((e for e in root.walk() if e.tag == tag and e.text().strip()), None)
        if found is not None:
            return found
    kept, gone = readable.main_blocks(root)
    if kept:
        for e in [e for k in kept for e in k.walk() if id(e) in gone]:
            e.remove()
        whole = El("div")
        whole.kids = list(kept)
        return whole
    return next((e for e in root.walk() if e.tag == "body"), root)


class _Markdown:
    def __init__(self, links: str, images: str):
        self.links, self.images = links, images
        self.references: dict[str, int] = {}

    def inline(self, node) -> str:
        if isinstance(node, str):
            return re.sub(r"\s+", " ", node)
        t, body = node.tag, "".join(map(self.inline, node.kids))
        if t == "br":
            return "  \n"
        if t == "img":
            alt, src = node.attrs.get("alt", ""), node.attrs.get("src", "")
            if self.images == "alt_only":
                return f"\n\n> 🖼️ *[Imagem: {alt.strip()}]*\n\n" if alt.strip() else ""
            return f"![{alt}]({src})" if self.images == "markdown" and src else ""
        core = body.strip()
        if not core:
            return " " if body else ""
        pad = lambda s: (" " if body[0] == " " else "") + s + (" " if body[-1] == " " else "")
        if t in ("b", "strong"):
            return pad(f"**{core}**")
        if t in ("i", "em"):
            return pad(f"_{core}_")
        if t == "code":
            return pad(f"`{core}`")
        if t == "a":
            href = node.attrs.get("href", "").strip()
            if self.links == "strip" or not href:
                return body
            if self.links == "references":
                return pad(f"{core} [{self.references.setdefault(href, len(self.references) + 1)}]")
            return pad(f"[{core}]({href})")
        return body

    def table(self, el: El) -> str:
        rows = [[_one_line("".join(map(self.inline, c.kids))) for c in r.kids if isinstance(c, El) and c.tag in ("td", "th")] for r in el.walk() if r.tag == "tr"]
        rows = [r for r in rows if r]
        if not rows:
            return self.blocks(el.kids)
        line = lambda r: "| " + " | ".join(r) + " |"
        return "\n".join([line(rows[0]), line(["---"] * len(rows[0])), *map(line, rows[1:])])

    def blocks(self, kids) -> str:
        out, run = [], []

        def flush():
            text = re.sub(r" *\n *", "\n", re.sub(r"[ \t]+", " ", "".join(run)).replace(" \n", "  \n")).strip()
            run.clear()
            if text:
                out.append(text)

        for k in kids:
            tag = k.tag if isinstance(k, El) else ""
            if re.fullmatch("h[1-6]", tag):
                flush()
                text = _one_line("".join(map(self.inline, k.kids)))
                out += [f"{'#' * int(tag[1])} {text}"] if text else []
            elif tag == "hr":
                flush()
                out.append("* * *")
            elif tag == "pre":
                flush()
                out.append("```\n" + k.text().strip("\n") + "\n```")
            elif tag in ("ul", "ol"):
                flush()
                items = [x for x in k.kids if isinstance(x, El) and x.tag == "li"]
                lines = []
                for n, item in enumerate(items, 1):
                    body = self.blocks(item.kids).replace("\n", "\n    ")
                    lines.append((f"{n}.  " if tag == "ol" else "*   ") + body)
                out += ["\n".join(lines)] if lines else []
            elif tag == "blockquote":
                flush()
                body = self.blocks(k.kids)
                out += ["\n".join(f"> {line}" if line else ">" for line in body.split("\n"))] if body else []
            elif tag == "table":
                flush()
                body = self.table(k)
                out += [body] if body else []
            elif tag in BLOCKS:
                flush()
                body = self.blocks(k.kids)
                out += [body] if body else []
            elif isinstance(k, El) and any(x.tag in BLOCKS or re.fullmatch("h[1-6]|pre|hr", x.tag) for x in k.walk()):
                flush()  # an unclosed inline element around blocks
                body = self.blocks(k.kids)
                out += [body] if body else []
            else:
                run.append(self.inline(k))
        flush()
        return "\n\n".join(out)


def _render(html: str, url: str | None, selector: str | None, links: str, images: str, prune: bool) -> str:
    root = parse(html)
    if url:
        _absolute(root, url)
    for e in [e for e in root.walk() if e.tag in PRUNED]:
        e.remove()
    if prune:
        _prune_link_lists(root)
    writer = _Markdown(links, images)
    found = select(root, selector)[:1] if selector else []
    body = writer.blocks(found if found else _main_content(root).kids)
    if writer.references:
        body += "\n\n---\n### Referências\n" + "\n".join(f"[{n}]: {u}" for u, n in writer.references.items())
    return re.sub(r"\n{3,}", "\n\n", body).strip()


def to_markdown(html: str | None, url: str | None = None, selector: str | None = None, links: str = "inline", images: str = "ignore") -> str:
    """Markdown of the main content or of the first element that a selector finds."""
    pruned = _render(html or "", url, selector, links, images, True)
    if len(pruned) >= LEAST_USEFUL:
        return pruned
    whole = _render(html or "", url, selector, links, images, False)
    return whole if len(pruned) < len(whole) * FALLBACK_SHARE else pruned


def visible_text(root: El) -> str:
    body = next((e for e in root.walk() if e.tag == "body"), None)
    parts: list[str] = []

    def walk(e):
        for k in e.kids:
            if isinstance(k, str):
                if k:
                    parts.append(k)
            elif k.tag not in HIDDEN:
                walk(k)

    if body is not None:
        walk(body)
    return " ".join(parts)


def links_of(root: El, url: str | None) -> list[dict]:
    """Anchors with absolute http(s) targets, fragments dropped."""
    out = []
    for e in root.walk():
        if e.tag == "a" and e.attrs.get("href", "").strip():
            try:
                target = urljoin(url or "", e.attrs["href"].strip()).split("#")[0]
                if urlsplit(target).scheme in ("http", "https"):
                    out.append({"href": target, "text": _one_line(e.text()), "place": len(out)})
            except ValueError:
                continue
    return out


def hrefs_of(root: El) -> list[str]:
    """What anchors point at, as it stands there."""
    return [e.attrs["href"].strip() for e in root.walk() if e.tag == "a" and e.attrs.get("href", "").strip()]


def phone_links_of(root: El) -> list[str]:
    """Targets of tel: links, in page order."""
    return [e.attrs["href"].strip() for e in root.walk() if e.tag == "a" and e.attrs.get("href", "").strip().lower().startswith("tel:")]


def metadata(root: El) -> dict:
    metas = [e for e in root.walk() if e.tag == "meta"]

    def meta(*names):
        for key, name in names:
            for e in metas:
                if e.attrs.get(key) == name:
                    value = (e.attrs.get("content") or e.attrs.get("href") or "").strip()
                    if value:
                        return value
                    break
        return None

    title = next((_one_line(e.text()) for e in root.walk() if e.tag == "title"), "")
    keywords = meta(("name", "keywords"))
    blocks = []
    for e in root.walk():
        if e.tag == "script" and e.attrs.get("type") == "application/ld+json":
            try:
                blocks.append(json.dumps(json.loads(e.text()), ensure_ascii=False))
            except ValueError:
                continue
    return {
        "title": title or meta(("property", "og:title"), ("name", "twitter:title")),
        "description": meta(("name", "description"), ("property", "og:description")),
        "og_title": meta(("property", "og:title")), "og_description": meta(("property", "og:description")), "og_image": meta(("property", "og:image")),
        "og_type": meta(("property", "og:type")), "og_url": meta(("property", "og:url")),
        "canonical": next((e.attrs.get("href") for e in root.walk() if e.tag == "link" and e.attrs.get("rel") == "canonical" and e.attrs.get("href")), None),
        "author": meta(("name", "author"), ("property", "article:author"), ("name", "twitter:creator")),
        "published": meta(("property", "article:published_time"), ("name", "publication-date"), ("name", "date")),
        "keywords": [k.strip() for k in keywords.split(",") if k.strip()] if keywords else None,
        "json_ld": blocks or None,
    }


def fields(root: El, schema: dict[str, str]) -> dict[str, list[str]]:
    """selector or selector@attribute by key -> values; a missing element gives an empty list."""
    out = {}
    for key, raw in schema.items():
        selector, _, attribute = raw.partition("@")
        found = select(root, selector.strip())

        def value(e):
            if attribute.strip():
                return e.attrs.get(attribute.strip(), "").strip()
            if e.tag == "a" and "href" in e.attrs:
                return e.attrs["href"].strip() or e.text().strip()
            if e.tag == "img" and "src" in e.attrs:
                return e.attrs["src"].strip()
            return e.text().strip()

        got = [value(e) for e in found]
        out[key] = got if len(got) == 1 else [v for v in got if v]
    return out


class SelectFields:
    """Table function select_fields(html, url, schema): a row a page, with a column of texts for each key of the schema.

    schema is JSON of key -> selector or selector@attribute and must be a constant, as it names the columns. A row at a time in
    Python, as a selector needs the page's tree; null pages give empty lists. Links are made absolute against url if it is given.
    """

    @staticmethod
    def analyze(html, url, schema):
        from pyspark.sql.functions import AnalyzeResult

        if not schema.isConstantExpression or schema.value is None:
            raise ValueError("select_fields: the schema must be constant text")
        keys = json.loads(schema.value)
        if not isinstance(keys, dict) or not keys or not all(isinstance(v, str) for v in keys.values()):
            raise ValueError("select_fields: the schema must be a JSON object of selectors")
        if len({k.lower() for k in keys}) < len(keys):
            raise ValueError("select_fields: keys must differ in more than case")
        for raw in keys.values():
            compile_selector(raw.partition("@")[0].strip())
        return AnalyzeResult(T.StructType([T.StructField(k, T.ArrayType(T.StringType())) for k in keys]))

    def eval(self, html, url, schema):
        keys = json.loads(schema)
        root = parse(html or "")
        if url:
            _absolute(root, url)
        found = fields(root, keys)
        yield tuple(found[k] for k in keys)


def register_functions(spark) -> None:
    """Makes select_fields known to SQL in this session."""
    spark.udtf.register("select_fields", F.udtf(SelectFields))


# What tells of online booking, services and tracking.
BOOKING_VENDOR = re.compile(r"calendly\.com|doctoralia|feegow|ninsaude|clinicorp|dentally|cliniko|vetstoria|petsapp|setmore|simplybook|booksy|fresha|treatwell|acuityscheduling|zocdoc|doctolib|pabau|phorest|zenoti|that-time\.co\.uk|jane\.app|writeupp|gettimely|vagaro|mindbodyonline|squareup\.com/appointments|facesconsent|portal\.dental|carestack|//[^/?#]*(?:booking|appointment|agend|reserv)[^/?#]*\.", re.I)
BOOKING_PATH = re.compile(r"/(agend|marcar|reserv|book|appointment|schedul)[^/]*/?$", re.I)
SERVICES_HEADING = re.compile(r"servi[cç]os|services|tratamentos|especialidades|solu[cç][oõ]es|produtos|products|what we (do|offer)|o que fazemos", re.I)
TRACKING = re.compile(r"googletagmanager\.com|google-analytics\.com|gtag\(|connect\.facebook\.net|fbq\(|plausible\.io|hotjar\.com|clarity\.ms", re.I)


def booking_target(href: str, base: str) -> bool:
    if re.match(r"(tel:|mailto:|#|javascript:)", href, re.I):
        return False
    if BOOKING_VENDOR.search(href):
        return True
    try:
        return bool(BOOKING_PATH.search(urlsplit(urljoin(base, href)).path))
    except ValueError:
        return False


def audit(html: str, url: str, root: El | None = None) -> dict:
    """SEO checklist of 100 points, conversion channels, services and digital maturity. root: the page, if it is parsed already."""
    root = root or parse(html)
    all_ = list(root.walk())
    own = metadata(root)
    own["title"] = next((_one_line(e.text()) for e in all_ if e.tag == "title"), "") or None
    description = next(((e.attrs.get("content") or "").strip() for e in all_ if e.tag == "meta" and e.attrs.get("name") == "description"), "") or None
    heads = lambda tag, most: list(dict.fromkeys(t for e in all_ if e.tag == tag and (t := _one_line(e.text())[:120])))[:most]
    h1, h2 = heads("h1", 5), heads("h2", 8)
    booking = next((e.attrs["href"] for e in all_ if e.tag == "a" and "href" in e.attrs and booking_target(e.attrs["href"], url)), None)
    booking = booking or next((e.attrs["src"] for e in all_ if e.tag in ("iframe", "script") and BOOKING_VENDOR.search(e.attrs.get("src", ""))), None)
    form = any(e.tag == "form" for e in all_)
    whatsapp = bool(re.search(r"wa\.me/\d{8,15}|api\.whatsapp\.com/send/?\?phone=\d{8,15}", html.replace("\\/", "/")))
    services: dict[str, None] = {}
    for h in all_:
        if h.tag in ("h2", "h3") and SERVICES_HEADING.search(_one_line(h.text())):
            kin = [k for k in h.up.kids if isinstance(k, El)]
            for s in kin[kin.index(h) + 1 : kin.index(h) + 4]:
                if s.tag in ("h1", "h2", "h3"):
                    break
                for x in [s] if s.tag == "li" else [x for x in s.walk() if x.tag in ("li", "h3", "h4")]:
                    if 3 < len(t := _one_line(x.text())) < 70:
                        services[t] = None
    for e in all_:
        cls = e.attrs.get("class", "")
        if {"service", "servico"} & set(cls.split()) or "service-" in cls:
            t = _one_line((next((x for x in e.walk() if x.tag in ("h2", "h3", "h4")), e)).text())
            if 3 < len(t) < 70:
                services[t] = None
    social = bool(own["og_title"] or own["og_description"])
    images = [e for e in all_ if e.tag == "img"]
    viewport = any(e.tag == "meta" and e.attrs.get("name") == "viewport" for e in all_)
    ld = any(e.tag == "script" and e.attrs.get("type") == "application/ld+json" for e in all_)
    title, secure = own["title"], url.startswith("https://")
    checks = [  # fixed values: points and texts of the issues
        (bool(title), 10, "missing <title>"),
        (not title or 20 <= len(title) <= 65, 5, f"title length {len(title or '')} (aim for 20-65)"),
        (bool(description), 10, "missing meta description"),
        (not description or 70 <= len(description) <= 165, 5, f"meta description length {len(description or '')} (aim for 70-165)"),
        (len(h1) == 1, 10, "missing <h1>" if not h1 else f"{len(h1)} <h1> tags (use one)"),
        (bool(h2), 5, "no <h2> headings"),
        (social, 10, "missing Open Graph tags"),
        (any(e.tag == "link" and e.attrs.get("rel") == "canonical" for e in all_), 5, "missing canonical link"),
        (any(e.tag == "html" and e.attrs.get("lang") for e in all_), 5, "missing <html lang>"),
        (viewport, 10, "missing viewport meta (not mobile-ready)"),
        (ld, 10, "no JSON-LD structured data"),
        (not images or sum(bool(i.attrs.get("alt", "").strip()) for i in images) / len(images) >= 0.8, 5, "more than 20% of images lack alt text"),
        (secure, 10, "not served over https"),
    ]
    signals = [secure, viewport, bool(TRACKING.search(html)), ld, bool(booking), whatsapp, form, social]
    return {
        "seo_score": sum(p for ok, p, _ in checks if ok), "seo_issues": [issue for ok, _, issue in checks if not ok], "digital_maturity": int(100 * sum(signals) / 8 + 0.5),
        "booking_url": booking, "contact_form": form, "whatsapp": whatsapp, "services": list(services)[:10], "h1": h1, "h2": h2,
    }


_S, _L = T.StringType(), T.LongType()
_struct = lambda **k: T.StructType([T.StructField(n, t) for n, t in k.items()])
METADATA = _struct(title=_S, description=_S, og_title=_S, og_description=_S, og_image=_S, og_type=_S, og_url=_S, canonical=_S, author=_S, published=_S, keywords=T.ArrayType(_S), json_ld=T.ArrayType(_S))
LINK = _struct(href=_S, text=_S, place=T.IntegerType())
AUDIT = _struct(seo_score=T.IntegerType(), seo_issues=T.ArrayType(_S), digital_maturity=T.IntegerType(), booking_url=_S, contact_form=T.BooleanType(), whatsapp=T.BooleanType(), services=T.ArrayType(_S), h1=T.ArrayType(_S), h2=T.ArrayType(_S))
KINDS = {"markdown": _S, "visible": _S, "links": T.ArrayType(LINK), "phone_links": T.ArrayType(_S), "hrefs": T.ArrayType(_S), "metadata": METADATA, "fields": T.MapType(_S, T.ArrayType(_S)), "audit": AUDIT}


ROWS_A_BATCH = 2_000  #: of an Arrow batch between Spark and a worker, where the session doesn't say otherwise
PAGES_A_SWEEP = 250  #: whose trees may wait for the collector


def _small_batches() -> None:
    """Keeps the pages that a worker holds at once few: at the default a batch of large ones fills it."""
    spark, rows = SparkSession.getActiveSession(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark is not None and int(spark.conf.get(rows)) == 10_000:
        spark.conf.set(rows, str(ROWS_A_BATCH))


def products(html: Column, url: Column, want: list[str], selector: str | None = None, links: str = "inline", images: str = "ignore", schema: dict[str, str] | None = None) -> Column:
    """Struct of the products asked for; a page is parsed in one UDF call for all of them."""
    if links not in ("inline", "references", "strip") or images not in ("ignore", "alt_only", "markdown"):
        raise ValueError("links: inline, references or strip; images: ignore, alt_only or markdown")
    _small_batches()
    if selector:
        compile_selector(selector)
    kind = T.StructType([T.StructField(n, KINDS[n]) for n in want])

    @F.pandas_udf(kind)
    def run(pages, urls):
        import pandas as pd

        rows, known = [], {}
        for page, own in zip(pages, urls):
            page, own, root = page or "", own or "", None
            row = known.get((page, own))  # pages that are the same have the same products
            if row is not None:
                rows.append(row)
                continue
            row = known[page, own] = {}
            if len(known) % PAGES_A_SWEEP == 0:
                gc.collect()  # trees point up and down, so they stay until they are swept
            for n in want:
                if n != "markdown":  # which changes its tree
                    root = root or parse(page)
                if n == "markdown":
                    row[n] = to_markdown(page, own, selector, links, images)
                elif n == "audit":
                    row[n] = audit(page, own, root)
                else:
                    row[n] = {"visible": lambda: visible_text(root), "links": lambda: links_of(root, own), "phone_links": lambda: phone_links_of(root), "hrefs": lambda: hrefs_of(root), "metadata": lambda: metadata(root), "fields": lambda: fields(root, schema or {})}[n]()
            rows.append(row)
        return pd.DataFrame(rows, columns=want)

    return run(html, url)


def decode_bytes(content: bytes | None, content_type: str | None) -> str | None:
    """Text of a body: by its byte-order mark, its header's charset, a meta charset in its first 2 KB, else UTF-8."""
    if content is None:
        return None
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if content.startswith(mark):
            return content[len(mark) :].decode(name, "replace")
    head = re.search(r"charset\s*=\s*[\"']?([\w:.-]+)", content_type or "", re.I)
    meta = head or re.search(r"<meta[^>]*charset\s*=\s*[\"']?([\w:.-]+)", content[:2048].decode("latin-1"), re.I)
    name = meta[1].lower() if meta else "utf-8"
    name = {"iso-8859-1": "cp1252", "latin1": "cp1252", "ascii": "cp1252", "us-ascii": "cp1252"}.get(name, name)
    try:
        return content.decode(name, "replace")
    except LookupError:
        return content.decode("utf-8", "replace")


def decoded(content: Column, content_type: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def run(bodies, kinds):
        import pandas as pd

        return pd.Series([decode_bytes(b, k) for b, k in zip(bodies, kinds)])

    return run(content, content_type)


MOST_BYTES = 15_000_000  #: of a body; larger ones give an error instead of a text


def document_text(pages: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """pages (url, content, content_type, and final_url after redirects if known) -> url, final_url, kind, text, parse_error.

    PDF files are read by sources/pdf.py, plain text passes, the rest is HTML, whose links are resolved against the final URL.
    """
    from ..sources import pdf

    if "final_url" not in pages.columns:
        pages = pages.withColumn("final_url", F.col("url"))
    large = F.octet_length("content") > most_bytes
    pages = pages.withColumn("large", F.coalesce(large, F.lit(False))).withColumn("content", F.when(~large, F.col("content")))
    low = F.lower(F.coalesce("content_type", F.lit("")))
    kind = F.when(low.contains("application/pdf") | (F.decode(F.substring("content", 1, 5), "ISO-8859-1") == "%PDF-"), "pdf").when(low.rlike("text/(plain|markdown)"), "text").otherwise("html")
    read = pages.withColumn("kind", kind).withColumn("body", decoded(F.col("content"), F.col("content_type")))
    plain = F.trim(F.regexp_replace("body", "\r\n", "\n"))
    made = products(F.when(F.col("kind") == "html", F.col("body")), F.col("final_url"), ["markdown"])["markdown"]
    files = pdf.pdf_text(read.where("kind = 'pdf' and not large").select("url", "content")).dropDuplicates(["url"])
    read = read.join(files.select("url", F.col("text").alias("pdf_text"), F.col("parse_error").alias("pdf_error")), "url", "left")
    text = F.when(F.col("large"), F.lit(None).cast("string")).when(F.col("kind") == "text", plain).when(F.col("kind") == "html", made).otherwise(F.col("pdf_text"))
    return read.select("url", "final_url", "kind", text.alias("text"), F.when(F.col("large"), "the body is too large").otherwise(F.col("pdf_error")).alias("parse_error"))


def markdown_pages(pages: DataFrame, **options) -> DataFrame:
    """pages (url, html) -> markdown, chars, tokens before and after, reduction in percent."""
    from ..functions.numbers import reduction_percent, tokens

    made = pages.withColumn("markdown", products(F.col("html"), F.col("url"), ["markdown"], **options)["markdown"])
    before, after = tokens(F.length("html")), tokens(F.length("markdown"))
    return made.withColumns({"char_count": F.length("markdown").cast("long"), "html_tokens": before, "estimated_tokens": after, "reduction": reduction_percent(before, after)})
