"""Operator 8 keeps the whole article: its lists of links, and what lies below layout classes."""

import pytest

pytest.importorskip("tidemark.llm")
from tidemark.llm.html_extract import main_text  # noqa: E402

TEXT = "<p>First, a paragraph, with commas, and words.</p><p>Second, one more, of the same kind.</p>"
WANT = "First, a paragraph, with commas, and words.\nSecond, one more, of the same kind."


def test_link_lists_in_article():
    page = f"<body><ul><li><a href=h>Home</a></ul><article>{TEXT}<h2>References</h2><ul><li><a href=1>One paper</a><li><a href=2>Another paper</a>, 2001</ul></article></body>"
    assert main_text(page) == WANT + "\nReferences\nOne paper\nAnother paper, 2001"


@pytest.mark.parametrize("name", ["page has-sidebar", "no-sidebar", "with-comments", "side-by-side"])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_layout_classes(name, tag):
    other = '<div class="sidebar"><p>Side, text</p></div><div id="comments"><p>nice, one</p></div>'
    for page in (f'<div class="{name}"><{tag}>{TEXT}</{tag}>{other}</div>', f'<div id="{name}"><div class="{name}"><{tag}>{TEXT}</{tag}></div>{other}</div>'):
        assert main_text(f"<body>{page}</body>") == WANT
    assert main_text(f'<main><div class="{name}"><article>{TEXT}</article></div>{other}</main>') == WANT


def test_named_parts_go():
    for named in ('<div class="comments"><article><p>short, reply</p></article></div>', '<div class="comments">' + "<p>long, long, long, long, reply, to, all</p>" * 9 + "</div>", '<div hidden class="x">a, b, c</div>'):
        assert main_text(f"<article>{TEXT}</article>{named}") == main_text(f"<main>{TEXT}{named}</main>") == WANT
