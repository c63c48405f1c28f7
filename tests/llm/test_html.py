"""Block rules of pages against a plain version of the two passes; broken markup in linear time."""

import time

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sightline.llm import html_extract as H

PAGES = "/root/testdata/sf0.01/pages.parquet"
PROSE = "The house is in the middle of the street and it was built by the people who lived with us for a long time. "
OTHER = "Zorba kelim vastu pondi harek lomas tirel gandu besom wirak folen dasta mirel. "


def two_passes(blocks):
    """The docstrings of ``classify`` and ``keep``, block by block, looking at all others each time."""
    prose = [b for b in blocks if not b.around and not b.heading and len(b.text) >= 70]
    by_words = any(b.linked <= 0.2 * len(b.text) and H.density(b.text) >= 0.08 for b in prose)
    first = []
    for b in blocks:
        n, share = len(b.text), H.density(b.text)
        wide = n if by_words else n + 2 * len(H.WIDE.findall(b.text))
        long, linked = n > 200, b.linked / n
        if b.around or (b.doubt and (n < 70 or linked > 0.2 or (by_words and share < 0.16))):
            label = "bad"
        elif linked > (0.5 if b.scope else 0.2):
            label = "bad" if wide >= 70 or linked > 0.8 else "short"
        elif wide < 70 or b.heading:
            label = "short"
        elif by_words and share >= 0.16:
            label = "good" if long or b.scope else "near"
        elif by_words:
            label = "near" if share >= 0.08 or long or b.scope else "bad"
        else:
            label = "good" if wide > 200 or b.scope else "near"
        first.append(label)
    if "good" not in first:
        first = ["good" if x == "near" else x for x in first]

    def nearest(labels, i, step, undecided):
        j = i + step
        while 0 <= j < len(blocks):
            b = blocks[j]
            if b.scope == blocks[i].scope and labels[j] not in undecided and not (b.scope and (b.around or b.doubt)):
                return labels[j]
            j += step
        return ""

    second = list(first)
    for i, x in enumerate(first):
        if x == "near":
            sides = {nearest(first, i, k, ("short", "near")) for k in (-1, 1)}
            second[i] = "good" if "good" in sides or sides == {""} else "bad"
    out = []
    for i, x in enumerate(second):
        if x == "short":
            a, z = (nearest(second, i, k, ("short",)) for k in (-1, 1))
            if blocks[i].scope:
                x = "bad" if {a, z} - {""} == {"bad"} else "good"
            elif blocks[i].heading:
                x = z or "bad"
            else:
                x = "good" if a == z == "good" else "bad"
        out.append(x)
    return [b.text for b, x in zip(blocks, out) if x == "good"]


def block(draw):
    text = (draw(st.sampled_from([PROSE, OTHER, PROSE[:40], "城市大多建在大河两岸" * 3])) * draw(st.integers(1, 4))).strip()
    return H.Block(text, int(len(text) * draw(st.sampled_from([0, 0, 0, 0.3, 0.6, 1]))), draw(st.integers(0, 2)), draw(st.integers(0, 5)) == 0, draw(st.integers(0, 5)) == 0, draw(st.integers(0, 7)) == 0)


@settings(max_examples=400, deadline=None)
@given(st.data())
def test_two_passes_over_any_blocks(data):
    blocks = [block(data.draw) for _ in range(data.draw(st.integers(0, 12)))]
    assert [b.text for b in H.keep(blocks)] == two_passes(blocks)


def test_two_passes_over_pages():
    for page in pd.read_parquet(PAGES).html:
        assert [b.text for b in H.keep(H.blocks_of(page))] == two_passes(H.blocks_of(page))


def test_density_decides_blocks(monkeypatch):
    """Without the density, most blocks that are good by themselves would not be."""
    pages = [H.blocks_of(x) for x in pd.read_parquet(PAGES).html]
    good = lambda: sum(H.classify(b) == "good" for page in pages for b in page)
    with_words = good()
    monkeypatch.setattr(H, "density", lambda text: 0.0)
    assert with_words > 1000 and good() == 0
    monkeypatch.undo()
    page = f"<body><p>{PROSE * 3}</p><p>{OTHER * 2}</p><table><tr><td>{OTHER * 2}</table><div class=menu>x</div></body>"
    assert PROSE.strip() in H.main_text(page)
    lists = f"<body><div><p>{PROSE * 3}</p></div><div class=footer>x</div><p>{OTHER}</p></body>"
    assert OTHER.strip() not in H.main_text(lists)
    monkeypatch.setattr(H, "STOP_LOW", 0.0)
    assert OTHER.strip() in H.main_text(lists.replace("<div class=footer>x</div>", ""))


def test_subjects_of_articles_stay():
    text = PROSE.strip()
    for name in ("search-results", "meta tags", "tag", "search"):
        assert H.main_text(f"<article><p>{text}</p><div class='{name}'><p>{text}</p><p>Tags: a, b</p></div></article>") == f"{text}\n\n{text}"
    for name in ("related", "share", "newsletter", "search sidebar"):
        assert H.main_text(f"<article><p>{text}</p><div class='{name}'><p>{text}</p></div></article>") == text


BROKEN = {
    "tags": "<a " * 330_000, "declarations": "<!x" * 330_000, "ends": "<div>" * 80_000 + "</b>" * 80_000, "quotes": '<a "' * 250_000, "mixed": "<a '\">" * 160_000, "script": "<script>" + "</script" * 120_000,
    "comments": "<!--" * 250_000, "less": "<" * 1_000_000, "cues": "<p " + " " * 500_000 + "<p class" + " " * 500_000, "odd": "<a x=\"'>'\">\"'" * 80_000, "cdata": "<![CDATA[" * 110_000, "nested": "<b><i></b></i>" * 70_000,
}


@pytest.mark.parametrize("name", BROKEN)
def test_broken_markup_takes_linear_time(name):
    began = time.process_time()
    H.main_text(BROKEN[name])
    assert time.process_time() - began < 4  # 1 MB; a fraction of a second where nothing else runs


def test_markup_shapes():
    for page, want in (
        ('<p>a <a title="x > y">b</a> c', "a b c"), ("<p>1 < 2 and 3 <4", "1 < 2 and 3 <4"), ("<p>a<!-- > --> b<!-->c<![CDATA[d]]> e", "a bcd e"), ("<p>a <a x=\"y>b</a>", "a b"), ("<p>a</ >b<?php x?>c", "abc"),
        ("<p>a<script>if (a</b) '<p>'</script >b", "ab"), ("<p>a<textarea><p>x</textarea>b", "ab"),
    ):
        assert " ".join(b.text for b in H.blocks_of(page)) == want


ARTICLE = f"<article><h1>Houses</h1><p>{PROSE * 3}</p></article>"


@pytest.mark.parametrize("before", ["<head><title>t</title><body>", "<html><head><meta charset=utf-8><link rel=x href=y>", "<head><title>t</title><script>x</script>", "<html><head><style>p{}</style></head><body>"])
def test_what_cannot_stand_in_a_head_ends_it(before):
    for page in (ARTICLE, f"<p>{PROSE * 3}", PROSE * 3):
        assert H.main_text(before + page).endswith((PROSE * 3).strip())
    assert H.main_text(f"<head>{PROSE * 3}<title>{PROSE}</title>") == (PROSE * 3).strip()
    assert H.main_text(f"<head><noscript>{PROSE}</noscript><title>{PROSE * 3}</title>") == ""


def test_blocks_end_paragraphs():
    text = (PROSE * 3).strip()
    for inner in ("Buy now", "<b>Buy <i>now", "<a href=x>Buy now"):
        assert H.main_text(f"<p class=ad>{inner}<div><p>{text}</p></div>") == text
    assert H.main_text(f"<div><p hidden>gone<h2>Head</h2><p>{text}") == f"Head\n\n{text}"
    assert H.main_text(f"<p>{text}<table><tr><td class=ad>x<td>{text}<tr><td><p class=ad>y<td>{text}</table>") == "\n\n".join([text] * 3)
    assert H.main_text(f"<ul><li class=ad><p>x<li>{text}</ul>") == text
    # within a cell or a button, blocks leave the paragraph around it open
    assert H.main_text(f"<p class=ad><button><div>x</div></button>Buy {text}") == ""


def test_slashes_of_values_close_nothing():
    assert [H.self_closed(x) for x in (" href=http://x.org/", " href= http://x.org/", " href=\"x\"/", " /", "/", " a b/", " a='=' c/", " a=b /", " a=b c=/d/")] == [False, False, True, True, True, True, True, True, False]
    linked = "".join(f"<p><a href=http://x.org/>{PROSE}</a></p>" for _ in range(3))
    assert H.blocks_of(linked)[0].linked == len(PROSE.strip()) and H.main_text(f"<p>{PROSE * 3}</p>{linked}") == (PROSE * 3).strip()


def test_forms_around_the_page():
    text = (PROSE * 3).strip()
    for page in (f"<main><p>{text}</p></main>", f"<div><p>{text}</p><p>{text}</p></div>"):
        form = f"<body><form id=form1 method=post><input type=hidden name=x><div class=menu>{PROSE}</div>{page}<div class=footer>x</div></form>"
        assert H.main_text(form) == H.main_text(f"<body><div class=menu>{PROSE}</div>{page}<div class=footer>x</div>") != ""
    form = f"<form action=/subscribe><p>{text}</p><input name=mail></form>"
    assert H.main_text(f"<p>{text}</p><p>{text}</p>{form}") == f"{text}\n\n{text}"
    assert H.main_text(f"<article><p>{text}</p></article>{form}{form}") == H.main_text(f"<article><p>{text}</p></article>") == text


@pytest.mark.parametrize("page", ["<p><table>" + "<b><div>" * 90_000, "<p>" + "<b>" * 150_000 + "<div>" * 90_000, "<p><b>" * 150_000, "<head>" * 150_000 + "<p>x", "<form><p>" * 100_000, "<a b=/" * 100 + " " * 900_000 + "/>"])
def test_left_out_ends_take_linear_time(page):
    began = time.process_time()
    H.main_text(page)
    assert time.process_time() - began < 4
