"""Periodic runs against trying every lag at every place."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pulseweave.llm import periodic

from .test_documents import ROWS, SCHEMA, same

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if j > i and length >= max(6, 4 * q) and not any(all(w[x] == w[x - p] for x in range(start + p, start + length)) for p in range(1, q)):
                out.append((start, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(words):
    return list(zip(*(x.tolist() for x in periodic.runs(np.array(words, np.int64), len(words))), strict=True))


blocks = st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=7), st.integers(1, 7)), max_size=6)


@settings(max_examples=300, deadline=None)
@given(blocks)
def test_repeated_blocks(parts):
    words = [w for block, times in parts for w in block * times]
    assert found(words) == plain(words)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=70))
def test_two_words(words):
    assert found(words) == plain(words)


def test_texts_side_by_side_do_not_meet():
    assert found([1, 2] * 2 + [3, 4] * 2) == [] == found([1, 1, 1, 11, 11, 11])


def test_long_and_dense():
    start = time.time()
    for period in (1, 2, 1000, 250_000):
        assert found((np.arange(1_000_000) % period).tolist()) == [(0, 1_000_000, period)]
    assert time.time() - start < 90


def rewritten(doc_id, words):
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(rows, plant):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for row in rows:
        words = WORD.findall(row[1] or "")
        words = rewritten(row[0], words) if plant else words
        known = plain(words)
        drop = {i for s, length, q in known for i in range(s + q, s + length)}
        best = min(known, key=lambda r: (-r[1], r[0], r[2])) if known else (None, None, None)
        milli = 1000 * best[1] // best[2] if known else None
        yield row[0], len(known), *best, milli, sha("".join(f"{s},{length},{q}\n" for s, length, q in known)), sha(" ".join(w for i, w in enumerate(words) if i not in drop))


def table():
    r = random.Random(2)
    texts = ["go home now " * 9 + "end", "a a a a a a", "a a a a a", "x y\tx\ny x  y x y z", " ".join(r.choice("ab") for _ in range(400))]
    return ROWS + [(1000 + k, t, None, None, "x", 0, "y", 0) for k, t in enumerate(texts * 12)]


def test_documents(spark):
    docs = spark.createDataFrame(table(), SCHEMA)
    same(periodic.digest(periodic.find_runs(docs.repartition(3))), list(expected(table(), False)))
    planted = list(expected(table(), True))
    same(periodic.digest(periodic.find_runs(docs.repartition(40), rewrite=periodic.repeated_words)), planted)
    assert sum(x[1] for x in planted) > 60


def test_empty_table(spark):
    assert periodic.digest(periodic.find_runs(spark.createDataFrame([], SCHEMA))).collect() == []
