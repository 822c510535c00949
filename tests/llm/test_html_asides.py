import time

import pytest

from pagelens.llm.html_text import main_text

BODY = "The river rose by two metres over night and the bridge was closed to all traffic."


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-sidebar", "ad-free", "menu-open", "login-page", "related-work", "sidebar", "widget"])
def test_a_wrapper_of_the_article_is_no_aside(name):
    assert main_text(f"<body><div class='{name}'><article><p>{BODY}</p></article></div><div class='footer'>Imprint</div></body>", ()) == BODY


@pytest.mark.parametrize("name", ["side-by-side", "social-history", "side"])
def test_compound_names_within_an_article_stay(name):
    assert main_text(f"<article><p>{BODY}</p><div class='{name}'>Both views.</div></article>", ()) == f"{BODY} Both views."


@pytest.mark.parametrize("name", ["reader-comments", "user-comments", "comment-thread", "disqus_thread", "discussion", "related-stories", "most-read", "consent-manager", "promo-teaser", "advertisement-label", "subscribe-now", "outbrain", "ad", "cookie-banner", "site-nav", "share buttons", "ad-slot-3"])
def test_whole_names_go(name):
    assert main_text(f"<body><article><p>{BODY}</p><div class='{name}'>Buy now.</div></article></body>", ()) == BODY
    assert main_text(f"<body><p>{BODY}</p><div id='{name.split()[0]}'>Buy now.</div></body>", ()) == BODY


def test_comments_stay_out_though_each_is_an_article():
    assert main_text(f"<main><p>{BODY}</p></main><div id='comments'><article>First!</article></div>", ()) == BODY


def test_an_article_beside_the_main_element_is_a_teaser():
    assert main_text(f"<main><article><p>{BODY}</p></article><p>More.</p></main><article>Another story</article>", ()) == f"{BODY} More."
    assert main_text(f"<article><p>{BODY}</p></article><article>Second part</article>", ()) == f"{BODY} Second part"


@pytest.mark.parametrize("piece", ["<a b='", "<a ", "<a b=\"x' ", "<div>", "<b>", "<b><p>", "<a '\">", "<p class=x>", "</p", "<", "<!", "<script", "<li><ul>", "<a b='>"])
def test_hostile_markup_takes_linear_time(piece):
    began = time.process_time()
    main_text(piece * (1_000_000 // len(piece)), ())
    main_text(piece * (500_000 // len(piece)) + "<p>" * 30_000 + "x", ())
    assert time.process_time() - began < 15
