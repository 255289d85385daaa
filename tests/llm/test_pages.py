"""Main text of pages whose names hold side words, and of pages of great depth."""

import time

import pytest

from factlattice.llm import page_dom, page_text

PARA = "Some people say that the river was high this year, and that the fields near it were under water for weeks. Others do not."
INNER = f"<h1>The headline</h1><p>{PARA}</p><p>{PARA} More.</p>"
WANT = ["The headline", PARA, PARA + " More."]
AROUND = "<html><head><title>t</title></head><body><nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></nav>{}<footer><p>Copyright us.</p></footer></body></html>"
PAGES = {
    "filed": (f'<article class="post tag-legal category-notice">{INNER}</article>', WANT),
    "hentry": (f'<article class="post-12 post hentry tag-ads">{INNER}</article>', WANT),
    "one_filed": (f'<article class="tag-sidebar">{INNER}</article>', WANT),
    "policy": (f'<article class="comment-policy">{INNER}</article>', WANT),
    "id": (f'<div class="content" id="login-security">{INNER}</div>', WANT),
    "div": (f'<div class="post tag-login">{INNER}</div>', WANT),
    "plain": (f'<article class="post">{INNER}</article>', WANT),
    "byline": (f'<article><header><h1>Headline</h1><p class="byline">By Jane Roe, 3 May</p></header><p>{PARA}</p><p>{PARA}</p></article>', ["Headline", "By Jane Roe, 3 May", PARA, PARA]),
    "section": (f'<article>{INNER}<section class="notice-period"><h2>Notice period</h2><p>{PARA}</p></section><p>{PARA}</p></article>', [*WANT, "Notice period", PARA, PARA]),
    "comments": (f'<article>{INNER}</article><div class="comments"><h3>Comments</h3><div class="comment"><p>{PARA}</p></div></div>', WANT),
    "cookies": (f'<div class="cookie-notice"><p>{PARA}</p></div><article class="post tag-ads">{INNER}</article><div class="related-posts"><h3>Related</h3><ul><li><a href=x>A story</a></li></ul></div>', WANT),
    "advert": (f'<article>{INNER}<aside class="ad"><p>{PARA}</p></aside></article>', WANT),
}


@pytest.mark.parametrize("name", PAGES)
@pytest.mark.parametrize("around", [AROUND, "{}"], ids=["page", "bare"])
def test_names_with_side_words(name, around):
    body, want = PAGES[name]
    assert page_text.extract(page_text.trained(), [around.format(body)])[0].split("\n") == want


@pytest.mark.parametrize("page", ["<blockquote>" * 200_000, "<div>" * 100_000 + "</span2>" * 100_000, "<p>x" * 100_000, "<div>" * 50_000 + "<li>a" * 50_000, "<td>" * 100_000], ids=["nested", "unmatched", "p", "items", "cells"])
def test_depth_costs_linear_time(page):
    began = time.time()
    page_dom.parse(page)
    whole = time.time() - began
    began = time.time()
    page_dom.parse(page[: len(page) // 4])
    assert whole < 12 * (time.time() - began) + 1


def test_a_deep_page_is_read_whole():
    began = time.time()
    (text,) = page_text.extract(page_text.trained(), ["<div>" * 50_000 + f"<article>{INNER}</article>" + "</div>" * 50_000])
    assert text.split("\n") == WANT and time.time() - began < 30


def test_ended_paragraphs_and_items():
    def shape(node):
        return [node.tag, *(shape(c) for c in node.children)] if node.children else node.tag

    of = lambda page: shape(page_dom.parse(page))
    assert of("<div><p>a<p>b<ul><li>c<li>d<ul><li>e</ul><li>f</ul><p>g</div><p>h") == ["#root", ["div", "p", "p", ["ul", "li", ["li", ["ul", "li"]], "li"], "p"], "p"]
    assert of("<table><tr><td>a<td>b<tbody></table>") == ["#root", ["table", ["tr", "td", ["td", "tbody"]]]]
    assert of("<p>a<section><p>b</section></p><div>c</div>") == ["#root", "p", ["section", "p"], "div"]
