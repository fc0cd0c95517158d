"""Markup that leaks, and articles that are not the page's."""

from __future__ import annotations

import re
import time

from grovelark.llm import html_main


def text(page: str) -> str:
    has_main, pieces, _ = html_main.parse(page)
    return " ".join("".join(p[0] for p in pieces if p[1] or not has_main).split())


def test_quotes_within_tags():
    assert text('<p>a <a href=x"y>link</a> b</p>') == "a link b"
    assert text("<p>a <a href=it's title='t>u'>link</a> b</p>") == "a link b"
    assert text('<p>a <img alt="x > y" src=a.png> b <b class="c"">d</b></p>') == "a b d"
    assert text('<p data-x = "1" data-y=2/>a<br/>b</p> 3 < 4 > 2') in ("a b 3 < 4 > 2", "ab 3 < 4 > 2")
    assert text('<a title="never closed>x</a> y') == "x y"


def test_tags_are_read_in_time_that_follows_the_page():
    page = "<p " + "a='b' c=\"d\" e=f'g " * 50_000 + ">x</p>" + "<a href=\"" * 2000
    start = time.perf_counter()
    list(re.finditer(html_main._TAG, page))
    assert time.perf_counter() - start < 5


def test_comment_articles_are_not_main():
    body = "<article><h1>Title</h1><p>" + "word " * 60 + "</p></article>"
    after = '<article class="comment"><p>reader one</p></article><section class="comments"><article><p>reader two</p></article></section>'
    assert text(body + after) == "Title " + " ".join(["word"] * 60)
    inside = body.replace("</article>", "<article><p>reader three</p></article></article>")
    assert text(inside) == "Title " + " ".join(["word"] * 60)
    assert text("<article class='widget'><p>" + "word " * 9 + "</p></article><p>x</p>").startswith("word word")
    assert text("<main><article><p>one</p></article><article><p>two</p></article></main>") == "one two"


def test_an_article_named_by_class_loses_what_is_named_so_within_it():
    assert text("<article class='share'><p>the own text</p><div class='ad'>no</div></article>") == "the own text"
    assert text("<article class='share'><div class='ad'>most of the page</div><p>x</p></article>") == "most of the page x"
