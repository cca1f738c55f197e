import html as entities
import re

import pytest

from pagewright.llm import htmlmain


@pytest.fixture(scope="module")
def trees():
    return htmlmain.model()


def main_text(trees, page):
    return htmlmain.extract_pages([page], trees)[0]


def test_pages_it_hasn_t_seen(trees):
    right = total = 0
    for seed in range(9000, 9150):
        nodes = htmlmain.parse(htmlmain.sample_page(seed))
        keep = htmlmain.decode(nodes, trees.log_odds(htmlmain.features(nodes)))
        for v, k in zip(nodes, keep):
            if v.text is not None:
                total += len(v.text)
                right += len(v.text) * (bool(k) == (v.label == 1))
    assert right / total > 0.98


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><header><a href="/">Site</a></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="ad">Buy now, it is cheap.</div><article><h1>A  title &amp; more</h1><p><b>First words<br>go on, and so on.<p>Second   &eacute;t&#233; paragraph, with <a href="/x">a link</a> in it.</p>
<div class="ad">Buy more.</div></article><section class="comments"><h3>Comments</h3><div class="comment"><p>First! I like this very much.</p></div></section>
<aside><p>Related things to read here.</p></aside><form><p>Subscribe to us</p></form><footer>&copy; 2026 us, all rights.</footer>"""


def test_one_page(trees):
    assert main_text(trees, PAGE) == "A title & more\n\nFirst words go on, and so on.\n\nSecond été paragraph, with a link in it."


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!--", "<div hidden><p>x</p></div>", "<script>a", "</p></p>", "<a><a><a>", "&", "<p>&am", "<title>x", "<p a='"])
def test_odd_pages(trees, page):
    assert isinstance(main_text(trees, page), str)


def test_long_and_deep_pages(trees):
    assert len(main_text(trees, "<article>" + "<p>some words, here. </p>" * 5000 + "</article>")) > 50_000
    main_text(trees, "<div>" * 3000 + "x" + "</div>" * 3000)
    main_text(trees, "<p" + " a" * 200_000)
    main_text(trees, '<p a="' + "<" * 200_000)


def test_no_child_outlives_its_parent(trees):
    nodes = htmlmain.parse(PAGE)
    keep = htmlmain.decode(nodes, trees.log_odds(htmlmain.features(nodes)))
    assert all(keep[v.parent] for v, k in zip(nodes, keep) if k and v.parent >= 0)


def test_decoding_is_optimal():
    """Against all labelings of small trees that keep the rule."""
    import itertools
    import random

    import numpy as np

    r = random.Random(1)
    for _ in range(60):
        parents = [-1] + [r.randrange(i) for i in range(1, r.randint(2, 9))]
        nodes = [htmlmain.Node("div", p, 0) for p in parents]
        odds = np.array([r.uniform(-2, 2) for _ in parents])
        best = max(sum(o for o, k in zip(odds, keep) if k) for keep in itertools.product([False, True], repeat=len(parents)) if keep[0] and all(not k or p < 0 or keep[p] for k, p in zip(keep, parents)))
        assert np.isclose(odds[htmlmain.decode(nodes, odds)].sum(), best)


def article_of(page):
    """The given tables' pages by hand: blocks of the article, split at h1 and p."""
    inside = page[page.index("<article>") + 9 :].split("</article>")[0]
    blocks = [re.sub(r"<[^>]*(>|$)", "", re.sub("<br>", " ", b)) for b in re.split(r"</?(?:p|h1)\b[^>]*>", inside)]
    return "\n\n".join(t for b in blocks if (t := re.sub(r"\s+", " ", entities.unescape(b)).strip()))


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    out = htmlmain.extract(pages).collect()
    assert len(out) == len(html) and all(r.text == article_of(html[r.page_id]) and r.n_chars == len(r.text) for r in out)


def test_table(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None)]
    out = htmlmain.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(r.n_chars for r in out)[0] == 0 and len({r.text for r in out}) == 2
    assert htmlmain.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_many_siblings_are_counted_alike():
    """The sibling feature is the number of equal tags under a parent, however many children it has."""
    for n in (5, 63, 64, 300):
        nodes = htmlmain.parse("<body><div>" + "<p>text</p><span>x</span><h2>y</h2>" * n + "</div></body>")
        x = htmlmain.features(nodes)
        assert {x[i, 12] for i, v in enumerate(nodes) if v.tag == "p"} == {n} == {x[i, 12] for i, v in enumerate(nodes) if v.tag == "h2"}


def test_a_very_long_page(trees):
    body = "".join(f"<p>Sentence {i} of the article, which goes on, and on.</p>" for i in range(20_000))
    page = f"<html><body><nav><a href='/'>Home</a></nav><article>{body}</article><footer>Copyright</footer></body></html>"
    text = htmlmain.extract_pages([page], trees)[0]
    assert text.split("\n\n") == [f"Sentence {i} of the article, which goes on, and on." for i in range(20_000)]


def slow_odds(trees, row):
    """One node's log-odds, tree by tree and step by step."""
    total = trees.base
    for feature, cut, value in zip(trees.feature, trees.cut, trees.value):
        at = 0
        while at < len(feature):
            at = 2 * at + 1 + int(row[feature[at]] > cut[at])
        total += value[at - len(feature)]
    return total


def test_pages_by_brute_force(trees):
    """Small pages whole: odds step by step, and every labelling in which what is kept lies in kept ancestors."""
    import itertools
    import random

    r = random.Random(4)
    words = "<p>Some words of the article, which say a thing or two. And more of them.</p> <nav><a href='/'>Home</a></nav> <div class='comment'>Nice!</div> <h2>A heading</h2> <footer>Copyright 2024</footer> <li>one item</li> <aside>Read also</aside>"
    parts = [p for p in re.findall(r"<(?:p|nav|div|h2|footer|li|aside).*?</(?:p|nav|div|h2|footer|li|aside)>", words)]
    for _ in range(25):
        inner = "".join(r.choice(parts) for _ in range(r.randint(1, 3)))
        page = f"<body><{(tag := r.choice(['article', 'div', 'section']))}>{inner}</{tag}></body>"
        nodes = htmlmain.parse(page)
        odds = [slow_odds(trees, x) for x in htmlmain.features(nodes)]
        best = max(
            (k for k in itertools.product([False, True], repeat=len(nodes)) if k[0] and all(not on or v.parent < 0 or k[v.parent] for on, v in zip(k, nodes))),
            key=lambda k: sum(o for o, on in zip(odds, k) if on),
        )
        want = "\n\n".join(v.text for v, on in zip(nodes, best) if on and v.text is not None)
        assert htmlmain.extract_pages([page], trees) == [want]


@pytest.mark.parametrize(
    "inside, text",
    [
        ("The sum <math><mi>a</mi><mo>+</mo><mn>1</mn></math> holds.", "The sum a+1 holds."),
        ("See <object data='f.svg'>the figure text</object> here.", "See the figure text here."),
        ("Hear <audio src='a'>the sound</audio> and <video><source src='b'>the film</video> now.", "Hear the sound and the film now."),
        ("Press <button><div>OK</div></button>to go <input name='q'>on <script>var x;</script>and on.", "Press to go on and on."),
        ("Pick <select><option>one<option>two</select>it <svg><text>s</text></svg>up.", "Pick it up."),
    ],
)
def test_lines_stay_whole(inside, text):
    assert [n.text for n in htmlmain.parse(f"<p>{inside}</p>") if n.text is not None] == [text]
