import pytest

from pagewright.operators import dom, readable

PROSE = "Words of a story, told at length, with commas, pauses and more of them. " * 4


def page(inside):
    return f"<html><body>{inside}</body></html>"


def kept(html):
    root = dom.parse(html)
    blocks, gone = readable.main_blocks(root)
    return " ".join(" ".join(b.text().split()) for b in blocks)


def test_links_and_names_speak_against_a_block():
    menu = "<div>" + "".join(f"<a href='/{i}'>A long link, to some other page, {i}</a> " for i in range(20)) + "</div>"
    text = kept(page(f"{menu}<div id='x'><p>{PROSE}</p><p>{PROSE}</p></div><div class='comment'><p>{PROSE * 3}</p></div>"))
    assert text == f"{PROSE}{PROSE}".strip()


def test_points_reach_ancestors():
    """Paragraphs in several wrappers of one block: the block around them wins."""
    inner = "".join(f"<div><p>{PROSE} {i}</p><p>{PROSE} again {i}</p></div>" for i in range(4))
    text = kept(page(f"<div class='top'><p>Short teaser, of no weight at all.</p></div><div class='wrap'>{inner}</div>"))
    assert all(f"again {i}" in text for i in range(4))


def test_siblings_join():
    text = kept(page(f"<section><p>A sentence beside it.</p><div class='text'><p>{PROSE}</p><p>{PROSE}</p></div><p>No end, short</p><p><a href='/x'>Only a link here.</a></p><div class='text'><p>{PROSE} second half</p></div></section>"))
    assert text.startswith("A sentence beside it.") and "second half" in text and "No end" not in text and "Only a link" not in text


def test_relaxed_when_too_short():
    assert "alone" in kept(page(f"<div class='sidebar'><p>{PROSE} alone</p></div>"))
    assert kept(page("<p>tiny</p>")) == "" and kept("") == ""


@pytest.mark.parametrize("gone", ["<ul class='related'><li><p>See, also, these, other things</p></li></ul>", "<div class='share'>Share it, now, with friends, all</div>", "<table><tr><td><a href='/a'>All of this table is one link, is it not</a></td></tr></table>"])
def test_cleaned_inside(gone):
    html = page(f"<div class='entry'><p>{PROSE}</p>{gone}<p>{PROSE}</p><p>{PROSE}</p></div>")
    out = dom.to_markdown(html)
    assert out == "\n\n".join([PROSE.strip()] * 3)
