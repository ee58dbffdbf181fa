"""Pages whose wrappers bear the class names of menus and sidebars, or are a form."""

import random

import pytest

from pulseweave.llm import html_text

from .test_html import WEIGHTS

ARTICLE = "<article><h1>T</h1><p>one two three four</p><form><p>mail</p></form><div class='ad'>buy</div></article>"
TEXT = "T\n\none two three four"
LONG = "<p>The content of a page without any mark is its longest run of words.</p><p>And more of it.</p>"
LONG_TEXT = "The content of a page without any mark is its longest run of words.\n\nAnd more of it."

PAGES = {
    f"<body class='single has-sidebar'>{ARTICLE}</body>": TEXT,
    f"<html class='no-search'><body class='right-sidebar'>{ARTICLE}<div class='sidebar'><p>no</p></div></body></html>": TEXT,
    f"<div id='page' class='no-sidebar'>{ARTICLE}</div>": TEXT,
    f"<div class='right-sidebar'>{ARTICLE}</div><div class='right-sidebar'><p>not this of two</p></div>": TEXT,
    "<main class='layout header-fixed'><p>one two three four</p></main>": "one two three four",
    f"<form action='/x'>{ARTICLE}</form><div id='comments'><p>{'reader ' * 50}</p></div>": TEXT,
    f"<form>{LONG}</form>": LONG_TEXT,
    f"<div class='page header-fixed'>{LONG}<div class='related'><p>other</p></div></div>": LONG_TEXT,
    "<article><p>one two</p><div class='related'><main><p>no</p></main></div></article>": "one two",
    f"<nav>{LONG}</nav>": "",
}


@pytest.mark.parametrize("page", PAGES)
def test_containers(page):
    assert html_text.main_text(page, WEIGHTS) == PAGES[page]


def test_the_article_counts_as_inside():
    found = html_text.count_kinds(f"<body class='has-sidebar'>{ARTICLE}</body>")
    assert found["word:p", True] == 4 and found["word:p", False] == 1


UNMARKED = {
    f"<body><nav><a href='/'>x</a>{LONG}</body>": LONG_TEXT,  # a menu that never closes holds the page
    f"<body class='single with-sidebar'>{LONG}</body>": LONG_TEXT,
    f"<div class='search results'>{LONG}</div>": LONG_TEXT,
    f"<div id='side'>{LONG}</div>": LONG_TEXT,
    f"<body>{ARTICLE}<div class='user-reviews'><p>a reader</p></div><div class='adsense'><p>buy this now</p></div></body>": TEXT,
    "<article><header><h1>Title</h1></header><p>one two three</p></article>": "Title\n\none two three",
    f"<header><h1>Site</h1></header>{ARTICLE}": TEXT,
    f"<div><a>m</a></div><div>{LONG}</div><ul><li><a>x</a></li><li><a>y</a></li></ul>": LONG_TEXT,
    "<article><p>one two three four five</p><ul><li>plain items stay here</li></ul></article>": "one two three four five\n\nplain items stay here",
    "<article><p>one two three four five</p><ul>" + "<li><a>x</a></li>" * 30 + "</ul></article>": "one two three four five",
}


@pytest.mark.parametrize("page", UNMARKED)
def test_wrappers_and_pages_without_marks(page):
    assert html_text.main_text(page, WEIGHTS) == UNMARKED[page]


def test_best_run_is_the_highest_sum():
    r = random.Random(4)
    for _ in range(300):
        scores = [r.choice([-6, -2, -0.5, 0.25, 1, 3]) for _ in range(r.randint(0, 25))]
        low, high = html_text.best_run(scores)
        most = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=0)
        assert sum(scores[low:high]) == pytest.approx(max(most, 0)) and (high > low) == (most > 0)


def test_weights_decide():
    page = "<article><p>one two</p><p>a longer paragraph of words</p></article><p>outside of it</p>"
    assert html_text.main_text(page, {}) == "one two\n\na longer paragraph of words"
    assert html_text.main_text(page, {"in|p": -50.0, "in|/p": -50.0}) == "a longer paragraph of words"
    assert html_text.main_text(page, {"out|word:p": 3.0, "out|p": -0.1, "out|/p": -0.1, "in|/article": -0.1}) == "one two\n\na longer paragraph of words\n\noutside of it"
