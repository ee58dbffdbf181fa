"""Main text of web pages as the maximum-scoring run of tokens.

A page is a row of words and tags. Words score positive and tags negative, and
a linear scan finds the run with the highest sum: the content. Weights come
from labelled pages, which need no hand: where a page marks its article (one
``article`` or ``main`` element), its tokens are inside or outside of the content.
Spark counts both for each kind of token over all pages, and a weight is the log
odds, kept above zero for words and below for tags. The kinds are a fixed set:
tag names, and words by the element around them, each once for all pages, once
for tokens in a marked article and once for tokens outside of it on a page that
has one; the odds are those of a token of that kind to be inside. So markup is evidence like any other, and the sum decides.

What HTML or class names declare to be menus, headers, footers, sidebars,
notices, adverts, forms or comments is a feature too: it turns a word's score negative (the log odds of
such words in labelled pages, below zero), unless the element holds the marked article or most of the words in paragraphs
(an element of such a name that its own end tag closes is never spared);
the header of an article is its own. The run goes over all tokens of the page; what it takes is widened to whole
blocks, and of these only words with a score above zero are text. In a marked article, a word with such a name
around it costs little, so that an advert does not part the article in two. Scripts and styles are no tokens. Names are read
in pieces: ``commentList``, ``comment-list`` and ``comment_list`` are the same. Character
references are decoded, white space inside a block (a line break is such) becomes
one space, and blocks are joined by two newlines.

Defined cases: a null, empty or wordless page gives the empty text; markup that
never closes reaches to the end of the page; repeated rows give the same text;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|textarea|iframe|select|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-z][a-z0-9:-]*)(?P<attrs2>[^>]*)(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
#: Elements that break a line of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
INLINE = frozenset("a abbr b bdi bdo big br button cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never content, and words that say so in class, id or role.
OUTSIDE = frozenset("nav header footer aside form head menu button dialog search".split())
OUTSIDE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads\w*|adv|advert\w*|sponsor\w*|promo\w*|banner|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|header|masthead|footer|comments?|reviews|discussion|disqus|respond|replies|cookies?|consent|notice|alert|popup|modal|newsletter|subscribe|signup|share|sharing|social|related|recommend\w*|widget|toolbar|pagination|pager|complementary|contentinfo|search)(?:$|[\s_-])",
    re.I,
)
#: Elements that no class word puts outside, and first parts of class names that tell of a layout, not of what the element is.
WHOLE = frozenset("html body main article".split())
LAYOUT_WORDS = re.compile(r"(?<!\S)(?:has|with|without|no)[_-]\S*", re.I)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
MARKED = ("article", "main")
WORD_KINDS = ("p", "a", "li", "heading", "cell", "other")
#: Least weight of a word.
LEAST = 0.01
#: Weights of kinds that no labelled page has, and of those inside of a marked article.
DEFAULT = {"word": 1.0, "tag": -3.0, "in|word": 3.0, "in|tag": -0.1, "in|a": -1.0, "in|/a": -1.0, "in|word:a": 0.3, **{f"{end}{name}": -0.3 for name in "p h1 h2 h3 b i em strong br blockquote".split() for end in ("", "/")}}
#: Score of a word, and of a tag, under a name that says it is not content: without labelled pages, and in a marked article.
NAMED_WORD, NAMED_TAG, NAMED_INSIDE = -0.5, -0.1, -0.02


def _word_kind(stack: list[tuple[str, bool]]) -> str:
    for name, _ in reversed(stack):
        if name in ("p", "a", "li"):
            return name
        if name[0] == "h" and name[1:].isdigit():
            return "heading"
        if name in ("td", "th", "dt", "dd"):
            return "cell"
        if name in BLOCKS:
            return "other"
    return "other"


#: Where a name in camel case has its pieces.
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


def _named_outside(attrs: str) -> bool:
    return any(OUTSIDE_WORDS.search(CAMEL.sub("-", LAYOUT_WORDS.sub("", CAMEL.sub("-", " ".join(x))))) for x in NAMED.findall(attrs))


def tokens(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(kind, text, outside, place) of each token: kind is ``/name``, ``name`` or ``word:kind``; place is ``in`` or ``out`` of the marked articles of a page, and empty where it has none.

    What is outside by name is so only if it does not hold the page: its one marked article or, where
    there is none or several, most of its words in paragraphs.
    """
    found: list[tuple[str, str, tuple[int, ...], bool]] = []
    stack: list[tuple[str, int]] = []  # name and: 0, or the number of a container to be judged at the end
    judged: tuple[int, ...] = ()
    holds: set[int] = set()  # containers around an article
    shut: set[int] = set()  # elements that are never content, closed by their own end tag
    containers = marked = articles = 0

    def close() -> str:
        nonlocal marked, judged
        name, out = stack.pop()
        if out:
            judged = judged[:-1]
        marked -= name in MARKED
        return name

    for m in TOKEN.finditer(page):
        kind = m.lastgroup
        if kind == "text":
            text = html.unescape(m["text"]) if "&" in m["text"] else m["text"]
            found.append((f"word:{_word_kind(stack)}", text, judged, marked > 0))
            continue
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        ends = bool(m["end"] or m["end2"])
        known = name if name in BLOCKS or name in INLINE or name in VOID else "unknown"
        plain = name in VOID or (name in INLINE and name not in ("a", "button"))
        if plain or ends:
            found.append((f"/{known}" if ends else known, "", judged, marked > 0))
        if plain:
            continue
        if ends:
            if any(n == name for n, _ in stack):
                while stack[-1][0] != name:
                    close()
                if name in OUTSIDE and name != "form":
                    shut.add(stack[-1][1])
                close()
            continue
        while stack and ((stack[-1][0] == "p" and name in BLOCKS) or (stack[-1][0] == name and name in ("li", "td", "th", "tr", "dt", "dd")) or (name in BLOCKS and stack[-1][0] == "a")):
            close()
        out = 0
        if name in OUTSIDE and not (name == "header" and any(n == "article" for n, _ in stack)) or (name not in WHOLE and _named_outside(m["attrs"] or m["attrs2"] or "")):
            out = containers = containers + 1
            judged = (*judged, out)
        found.append((known, "", judged, marked > 0))
        stack.append((name, out))
        if name in MARKED:
            if not marked:
                articles += 1
                holds.update(judged)
            marked += 1
    inside: set[int] = set()
    if containers:
        if articles == 1:
            inside = holds
        else:
            words = [0] * (containers + 1)
            for kind, text, around, _ in found:
                if kind == "word:p":
                    n = len(text.split())
                    words[0] += n
                    for k in around:
                        words[k] += n
            inside = {k for k, n in enumerate(words) if 2 * n > words[0]}
        inside -= shut
    for kind, text, around, own in found:
        yield kind, text, any(k not in inside for k in around), ("in" if own else "out") if articles else ""


def count_kinds(page: str) -> Counter:
    """(kind, inside) counts of a page with one marked article, else none; kinds alone and behind ``in|`` or ``out|``."""
    found: Counter = Counter()
    articles, before = 0, False
    for kind, text, outside, place in tokens(page):
        own = place == "in"
        articles += own and not before
        before = own
        n = len(text.split()) if text else 1
        found[kind, own and not outside] += n
        if outside:
            found["named", own] += n
        else:
            found[f"{place}|{kind}", own] += n
    return found if articles == 1 else Counter()


def fit(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Weights of token kinds from all pages; the kinds are a fixed set of a few hundred."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for page in batch.column(0):
                found.update(count_kinds(page.as_py() or ""))
        rows = [(k, inside, n) for (k, inside), n in found.items()]
        kinds, insides, n = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(insides, pa.bool_()), pa.array(n, pa.int64())], ["kind", "inside", "n"])

    counts = pages.select(F.col(html_col).cast("string").alias("html")).mapInArrow(run, "kind string, inside boolean, n long").groupBy("kind").agg(F.sum(F.when(F.col("inside"), F.col("n"))).alias("inside"), F.sum(F.when(~F.col("inside"), F.col("n"))).alias("outside")).collect()
    return weights_of({r["kind"]: (r["inside"] or 0, r["outside"] or 0) for r in counts})


def weights_of(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """The weight of each kind from its tokens in and out of marked articles."""
    weights = {}
    for kind, (inside, outside) in counts.items():
        odds = log((inside + 1) / (outside + 1))
        if kind == "named":  # such words in a marked article are not content either: below zero in any case
            weights[kind] = max(min(odds, NAMED_WORD), -3.0)
        else:
            weights[kind] = min(max(odds, LEAST), 3.0) if "word:" in kind else max(min(odds, -0.1), -6.0)
    return weights


def best_run(scores: Sequence[float]) -> tuple[int, int]:
    """First and behind the last of the run with the highest sum, the first such; empty if no sum is above zero."""
    best, low, high, run, start = 0.0, 0, 0, 0.0, 0
    for i, score in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += score
        if run > best:
            best, low, high = run, start, i + 1
    return low, high


def score_of(weights: dict[str, float], kind: str, outside: bool, place: str) -> float:
    """The score of one word, or of a tag."""
    word = kind.startswith("word:")
    if outside:
        return NAMED_INSIDE if place == "in" else weights.get("named", NAMED_WORD) if word else NAMED_TAG
    weight = weights.get(f"{place}|{kind}")
    if weight is not None:
        return weight
    if place == "in":
        return DEFAULT.get(f"in|{kind}", DEFAULT["in|word" if word else "in|tag"])
    return weights.get(kind, DEFAULT["word"] if word else DEFAULT["tag"] if place else DEFAULT.get(kind, DEFAULT["tag"]))


def main_text(page: str | None, weights: dict[str, float]) -> str:
    if not page:
        return ""
    blocks: list[list[str]] = [[]]
    scores: list[float] = []
    places: list[int] = []  # the block of each score above zero, else -1
    for kind, text, outside, place in tokens(page):
        word, weight = kind.startswith("word:"), score_of(weights, kind, outside, place)
        if word:
            if weight > 0:
                blocks[-1].append(text)
        elif kind.lstrip("/") in BLOCKS:
            if blocks[-1]:
                blocks.append([])
        elif kind == "br" and not outside:
            blocks[-1].append(" ")
        scores.append(weight * len(text.split()) if word else weight)
        places.append(len(blocks) - 1 if weight > 0 and text.strip() else -1)
    low, high = best_run(scores)
    texts = (" ".join("".join(blocks[b]).split()) for b in sorted({b for b in places[low:high] if b >= 0}))
    return "\n\n".join(t for t in texts if t)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    weights = fit(pages, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), weights) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
