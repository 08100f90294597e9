"""Pages on which names, forms or teasers must not cost the article, and pages nested deeply."""

import time

import pytest

from odflux.llm.html_text import main_text

PARTS = [("This is a sentence of the article with enough words to count. " * 4 + str(k)).strip() for k in range(6)]
ARTICLE = "".join(f"<p>{p}</p>" for p in PARTS)
TEXT = "\n\n".join(PARTS)
LINKS = "<ul>" + "".join(f"<li><a href=x>Link {k}</a></li>" for k in range(8)) + "</ul>"
REPLIES = "".join(f"<p>{'A reader writes many words below the article here. ' * 6}{k}</p>" for k in range(9))


@pytest.mark.parametrize("page", [
    f"<nav>{LINKS}</nav><div class='layout with-sidebar'><div>{ARTICLE}</div><div class=sidebar>{LINKS}</div></div><footer>Foot</footer>",
    f"<div class='no-sidebar'>{ARTICLE}</div>",
    f"<div class='page with-sidebar'><article>{ARTICLE}</article><aside>{LINKS}</aside></div>",
    f"<div id='search-page'><main>{ARTICLE}</main><div class=related>{LINKS}</div></div>",
    f"<form action=x><div class=menu>{LINKS}</div><div>{ARTICLE}</div><input name=q></form>",
    f"<form><div class='page search'><div class=widget><article>{ARTICLE}</article></div></div></form>",
    f"<article class=card><h3>Teaser</h3><p>Short teaser text for another page</p></article><div>{ARTICLE}</div>",
    f"<div>{ARTICLE}</div><div class=comments>{REPLIES}</div>",
    f"<article>{ARTICLE}</article><section id=comments>{REPLIES}{REPLIES}</section>",
    f"<div class='widget related'><article><p>One more page</p></article></div><div>{ARTICLE}</div>",
], ids=str)
def test_article_stays(page):
    assert main_text(f"<html><head><title>T</title></head><body>{page}</body></html>") == TEXT


def test_short_article_with_long_comments_stays_short():
    page = f"<article><p>Only a few words.</p></article><div class=comments>{REPLIES}</div><nav>{LINKS}</nav>"
    assert main_text(page) == "Only a few words."


def test_hidden_text_is_none():
    assert main_text(f"<div hidden>{REPLIES}</div><div>{ARTICLE}</div><div style='display: none'>{REPLIES}</div>") == TEXT
    assert main_text(f"<div aria-hidden=true>{ARTICLE}</div>") == ""


@pytest.mark.parametrize("tag", ["div", "span", "li", "form", "article"])
def test_time_grows_with_the_page(tag):
    def seconds(n):
        start = time.perf_counter()
        assert main_text("<i><div>" + f"<{tag}>x" * n + "</i>" * n)
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(100_000) < 60 * max(seconds(5000), 0.02)
