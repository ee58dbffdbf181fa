"""Main text of hand-made pages, and rows that are null, empty, repeated or have other columns."""

import pytest

from pulseweave.llm import html_text

WEIGHTS = {"word:p": 2.0, "word:heading": 2.0, "word:other": 0.3, "word:a": 0.05, "word:li": 0.3, "p": -0.2, "/p": -0.2, "h1": -0.2, "/h1": -0.2, "a": -3.0, "/a": -3.0, "li": -3.0, "/li": -3.0, "div": -2.0, "/div": -2.0, "br": -0.1, "b": -0.1}

PAGES = {
    "": "",
    "   ": "",
    "<p>&nbsp;</p><script>var a = '<p>no</p>';</script>": "",
    "<article><h1>T</h1><p>One  two\n three</p><p>A&amp;B &lt;i&gt; &eacute; &#233;&#x41;</p></article>": "T\n\nOne two three\n\nA&B <i> é éA",
    "<article><p>un<b>brok</b>en <i>x</i><br>y</article>": "unbroken x y",
    "<article><p><b>first<br><p>second</p></article><footer>&copy; no</footer>": "first\n\nsecond",
    "<nav><a href='/x'>menu</a></nav><article><p>text here</p><aside>aside</aside><div class='ad'>buy</div><p>more</p><div id=\"comments\"><p>reader</p></div></article>": "text here\n\nmore",
    "<ARTICLE><P>upper</P><FORM><p>form</p></FORM></ARTICLE>": "upper",
    "<article><p>open <!-- never closed </p>": "open",
    "<article><p>a <img alt='x > y'> b</p><style>p{}</style></article>": "a b",
    "<article><p>1 < 2 and 3 > 2</p></article>": "1 < 2 and 3 > 2",
    "<article><p title=\"unclosed>text</p></article>": "text",
    "<head><title>no</title></head><body><div><a>m</a><a>n</a></div><p>The content of a page without any mark is its longest run of words.</p><p>And more of it.</p><ul><li><a>x</a></li><li><a>y</a></li></ul></body>": "The content of a page without any mark is its longest run of words.\n\nAnd more of it.",
    "just text": "just text",
}


@pytest.mark.parametrize("page", PAGES)
def test_main_text(page):
    assert html_text.main_text(page, WEIGHTS) == PAGES[page]


def test_extract(spark):
    rows = [(i, f"u{i}", p, 5) for i, p in enumerate(PAGES)] + [(3, "u3", list(PAGES)[3], 6), (None, None, None, 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int").repartition(3)
    found = html_text.extract(pages).collect()
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    by_page = {r.page_id: r.text for r in found}
    for i, (page, text) in enumerate(PAGES.items()):
        if "<article" in page.lower():
            assert by_page[i] == text
    assert by_page[None] == "" and html_text.extract(pages.limit(0)).count() == 0
    weights = html_text.fit(pages)
    assert all((w > 0) == ("word:" in k) for k, w in weights.items()) and weights["named"] < 0


def test_long_page_is_linear():
    page = "<article>" + "<p>word word</p>" * 20000 + "<div title=\"" * 300
    assert len(html_text.main_text(page, WEIGHTS)) > 190000


@pytest.mark.parametrize("name", ["commentList", "googleAd", "CommentsBox", "siteFooter", "comment-list", "comment_list", "navBar"])
def test_names_in_pieces(name):
    page = f"<article><h1>T</h1><p>one two three four</p><div class='{name}'><p>not this</p></div><p>five six</p></article><div id={name}>nor this</div>"
    for weights in (WEIGHTS, {}):
        assert html_text.main_text(page, weights) == "T\n\none two three four\n\nfive six"


@pytest.mark.parametrize("name", ["reading", "adapter", "shadow", "has-sidebar", "hasSidebar", "Addendum", "headerless"])
def test_names_that_only_look_alike(name):
    page = f"<article><p>one two</p><div class='{name}'><p>this too</p></div></article>"
    assert html_text.main_text(page, WEIGHTS) == "one two\n\nthis too"


def test_heading_before_the_paragraphs_of_an_unmarked_page():
    page = "<div><a href=x>menu</a></div><h1>Title</h1><p>" + "word " * 20 + "</p><p>end here</p><div><a>x</a></div>"
    assert html_text.main_text(page, {}) == "Title\n\n" + " ".join(["word"] * 20) + "\n\nend here"


def test_an_advert_does_not_part_an_article():
    page = "<article><p>short one</p><div class='ad'><p>" + "buy now " * 40 + "</p></div><p>short two</p></article>"
    for weights in (WEIGHTS, {}):
        assert html_text.main_text(page, weights) == "short one\n\nshort two"


def test_the_run_decides_without_names(spark, monkeypatch):
    """Weights fitted on marked pages cut menus and footers off; without the scan they stay."""
    page = lambda k: f"<body><nav><ul><li><a>go {k}</a></li><li><a>there</a></li></ul></nav><div class=x>buy {k}</div><article><h1>T {k}</h1><p>text of {k} here</p><p>and more</p></article><footer>made by {k}</footer></body>"
    monkeypatch.setattr(html_text, "_named_outside", lambda attrs: False)
    monkeypatch.setattr(html_text, "OUTSIDE", frozenset())
    counts = sum((html_text.count_kinds(page(k)) for k in range(20)), html_text.Counter())
    weights = html_text.weights_of({k: (counts[k, True], counts[k, False]) for k, _ in counts})
    assert html_text.main_text(page(3), weights) == "T 3\n\ntext of 3 here\n\nand more"
    monkeypatch.setattr(html_text, "best_run", lambda scores: (0, len(scores)))
    assert html_text.main_text(page(3), weights) == "go 3\n\nthere\n\nbuy 3\n\nT 3\n\ntext of 3 here\n\nand more\n\nmade by 3"
