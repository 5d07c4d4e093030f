"""Names inside an article: what only shares a word with boilerplate stays."""

from __future__ import annotations

import pytest

from scoreloom.llm import html_extract

STAY = ["p class='share-price'", "div class='related-work'", "ul class='menu-items'", "section class='navigation'", "div class='login-shell'", "blockquote class='social-quote'",
        "p id='banner-of-liberty'", "div class='ad-hoc'", "p class='cookie-recipe'"]
GO = ["div class='share'", "div class='post-share-buttons'", "ul class='related-posts'", "p class='ad'", "div class='x advert y'", "aside", "div class='comments'", "div class='site-footer'",
      "div class='newsletter-form'", "div role='complementary'", "div class='social_icons'", "nav class='navigation'"]


@pytest.mark.parametrize("tag", STAY)
def test_text_inside_an_article_stays(tag):
    page = f"<article><p>One</p><{tag}>Two</{tag.split()[0]}><p>Three</p></article>"
    assert html_extract.article_text(page, frozenset()) == "One\nTwo\nThree"


@pytest.mark.parametrize("tag", GO)
def test_boilerplate_inside_an_article_goes(tag):
    page = f"<article><p>One</p><{tag}>Two</{tag.split()[0]}><p>Three</p></article>"
    assert html_extract.article_text(page, frozenset()) == "One\nThree"


def test_outside_an_article_names_decide_as_before():
    page = "<div class='share-price'>no</div><div class='navigation'>no</div><p>Text</p><main><p class='share-price'>12.50</p></main>"
    assert html_extract.article_text(page, frozenset()) == "12.50"
