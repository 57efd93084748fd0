"""Operator 8 on pages where points, not tags, must decide."""

import pytest

pytest.importorskip("tidemark.llm")
from tidemark.llm.html_extract import main_text  # noqa: E402

TEXT = "<p>First, a paragraph, with commas, and words, long enough to tell it from the others on this page, as it goes on.</p><p>Second, one more, of the same kind, and also long enough, with commas, and words, and so on.</p>"
WANT = TEXT[3:-4].replace("</p><p>", "\n")
TEASER = "<div class=story><a href=1>Another story, with a title, that is long</a><p><a href=1>read, on</a></p></div>"


def test_best_container_without_article():
    page = f"<body><div><a href=a>Home</a> <a href=b>News</a></div><h1>Title</h1><div id=x1>{TEXT}</div><div>{TEASER * 4}</div><div><a href=c>Imprint</a></div></body>"
    assert main_text(page) == "Title\n" + WANT


def test_stories_around_the_article():
    for tag in ("article", "div"):
        assert main_text(f"<main><div>{TEASER * 3}</div><{tag}>{TEXT}</{tag}><div>{TEASER * 5}</div></main>") == WANT


def test_page_in_a_form():
    page = f'<body><form action="/" id="aspnet"><div><a href=1>Home</a></div><div id=body>{TEXT}</div></form></body>'
    assert main_text(page) == WANT
    assert main_text(f"<article>{TEXT}<form><p>Your email, please, and a comment</p></form></article>") == WANT


@pytest.mark.parametrize("name", ["entry-header", "article-header", "social-science", "notice-of-motion"])
def test_words_with_other_uses(name):
    assert main_text(f'<article><div class="{name}"><h1>Title</h1></div>{TEXT}</article>') == "Title\n" + WANT


@pytest.mark.parametrize("name", ["header", "site-header", "social-links", "share-bar", "cookie-notice", "related-posts", "comments"])
def test_unwanted_names(name):
    assert main_text(f'<article>{TEXT}<div class="{name}"><p>Some, other, words</p></div></article>') == WANT


def test_long_page_and_ties():
    many = "".join(f"<p>Paragraph {i}, with a comma.</p>" for i in range(20_000))
    assert main_text(f"<article>{many}</article>").count("\n") == 19_999
