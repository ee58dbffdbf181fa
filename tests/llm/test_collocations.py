"""Phrase mining against counting by hand of every occurrence."""

import random
import re
from collections import Counter

import pytest

from pulseweave.llm import collocations

from .test_documents import SCHEMA, same

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus():
    r = random.Random(3)
    vocab = [f"w{k}" for k in range(12)] + ["É", "é", "the", "THE", "#"]
    texts = []
    for k in range(150):
        words = []
        for _ in range(r.randint(1, 60)):
            words += r.choice([["new", "york"], ["new", "york", "city"], [r.choice(vocab)], [r.choice(vocab) + r.choice(".,;:!?")], ["a" + r.choice("\n\t\r\x0b"), "b"], [".", ".."]])
        texts.append((r.choice((" ", "  ")).join(words), ("en", "de", None, "und")[k % 4]))
    texts += [texts[0]] * 40 + [(None, "en"), ("", None), (" \t.,", "fr"), ("same " * 5000, "en"), ("in\x85side \x1cword " * 30, "de")]
    return [(i, t, lang, None, "x", 0, "y", 0) for i, (t, lang) in enumerate(texts)]


def plain(rows, least, covered, most):
    f, n = Counter(), Counter()
    for row in rows:
        lang = row[2] or "und"
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (row[1] or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    out = []
    for (lang, p), a in f.items():
        if len(p) == 1 or a < least:
            continue
        score, k = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        longer = [b for (own, q), b in f.items() if own == lang and b >= least and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if not any(100 * b >= covered * a for b in longer):
            out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    found, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= most:
            found.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return found


@pytest.mark.parametrize(("least", "covered", "most"), [(10, 50, 2000), (2, 90, 7)])
def test_phrases(spark, least, covered, most):
    rows = corpus()
    expected = plain(rows, least, covered, most)
    assert len(expected) > 20
    same(collocations.mine(spark.createDataFrame(rows, SCHEMA).repartition(5), least=least, covered=covered, most=most, slices=3), expected)


def test_parse_is_lossless_and_chunks_are_shared(spark):
    rows = corpus()
    found = collocations.chunks(spark.createDataFrame(rows, SCHEMA).repartition(3), every=4).collect()
    assert len({(c.lang, c.chunk, c.last) for c in found}) == len(found) and max(c.times for c in found) > 40
    # every word but those of a closing trigger lies in one chunk only
    words = Counter()
    for c in found:
        own = c.chunk.split(" ")
        for w in own if c.last else own[:-2]:
            words[c.lang, w] += c.times
    expected = Counter()
    for row in rows:
        spaced = re.sub(r"[.,;:!?\x0a-\x0d]+", " . ", (row[1] or "").translate(LOWER))
        expected.update((row[2] or "und", w) for w in re.findall(r"[^\x20\x09]+", spaced))
    assert words == expected


def test_full_bit_table_loses_nothing(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(collocations, "MOST_BITS", 11)  # nearly every bit is set
    same(collocations.mine(spark.createDataFrame(rows, SCHEMA), least=3), plain(rows, 3, 50, 2000))


def test_scores_beyond_64_bits(spark):
    big = 4_000_000_000_000
    at = lambda phrase, n: spark.createDataFrame([("en", phrase, n)], "lang string, phrase string, times long")
    words = spark.createDataFrame([("en", "a", big + 7), ("en", "b", big + 5)], "lang string, phrase string, times long")
    (row,) = collocations.cuts({1: words, 2: at("a b", big), 3: at("x y z", 1).limit(0)}).collect()
    assert row.score == 1_000_000 * big * big // ((big + 7) * (big + 5))


def test_empty_table(spark):
    assert collocations.mine(spark.createDataFrame([], SCHEMA)).collect() == []
