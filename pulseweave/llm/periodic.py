"""Periodic runs of words: stretches that repeat a block of words at least four times.

A sparse table of diagonals goes over the text: the diagonal of lag q holds how
many words in a row equal the word q places before. Every place is met with an
earlier occurrence of what stands there, which lengthens the diagonal of that
lag; a diagonal that is not lengthened ends there and gives a run if it is long enough.

Earlier occurrences of single words are too many (half a text may be one word).
A run of period q in [s, 2 s) has at least 3 q equal words on its diagonal, so
it is enough to meet places with occurrences of the 3 s words that stand there,
for s = 1, 2, 4, ... And only the latest earlier occurrence counts: two lags below 2 s
that both hold for 3 s words force a common smaller period, so neither is the
smallest one. So each level has at most one entry per place, a text of n words
costs n log n however it repeats, and the diagonals that are left are exactly
those with the smallest period: where a smaller one holds, it is met first.
Window numbers come from pairs of numbers of half the length, never from hashes;
a window that occurs once in its text drops out, so plain prose ends after two levels.
Many short texts share one table; their words have different numbers.

Defined cases: null is a text without words; texts without runs have an empty
list and their words joined by single spaces; a text is taken whole at any
length; repeated rows get equal results; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .word_arrays import joined, numbered_words, owners, steps

#: A run has at least this many words, and this many times its period.
LEAST, POWERS = 6, 4
RUNS = "array<struct<start: long, length: long, period: long>>"


def _numbered(keys: np.ndarray) -> np.ndarray:
    """Equal keys get equal numbers; -1 where a key occurs once."""
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return np.where(counts[inverse] > 1, inverse, -1)


def _ended(at: np.ndarray, lag: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of the diagonals made of entries (place, lag) that follow each other."""
    order = np.lexsort((at, lag))
    at, lag = at[order], lag[order]
    new = np.ones(len(at), bool)
    new[1:] = (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    period = lag[first]
    return at[first] - period, at[last] - at[first] + window + period, period


def runs(words: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of ``words``, by start and period. Equal numbers are equal words of one text; no text has over ``longest`` words, and texts lie one behind the other."""
    n, s, ids, found = len(words), 1, _numbered(words), []
    places = np.flatnonzero(ids >= 0)
    while POWERS * s <= longest and len(places):
        m = np.int64(ids.max() + 1)
        pair = places[places + s < n]
        pair = pair[ids[pair + s] >= 0]
        half = np.unique(ids[pair] * m + ids[pair + s], return_inverse=True)[1] if len(pair) else np.zeros(0, np.int64)
        inside = pair + 2 * s < n
        inside[inside] = ids[pair[inside] + 2 * s] >= 0
        at = pair[inside]
        if len(at):
            window = half[inside] * m + ids[at + 2 * s]
            order = np.argsort(window, kind="stable")
            before, after = at[order[:-1]], at[order[1:]]
            lag = after - before
            hit = (window[order[1:]] == window[order[:-1]]) & (lag >= s) & (lag < 2 * s)
            if hit.any():
                start, length, period = _ended(after[hit], lag[hit], 3 * s)
                enough = length >= np.maximum(LEAST, POWERS * period)
                found.append(np.stack([start[enough], length[enough], period[enough]]))
        twice = _numbered(half) if len(half) else half
        ids = np.full(n, -1)
        ids[pair] = twice
        places, s = pair[twice >= 0], 2 * s
    start, length, period = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def repeated_words(doc_id: int | None, n: int) -> np.ndarray | None:
    """The rule by which the query repeats words of a tenth of all texts: place i takes the word of place [i]; None: unchanged, as without an identifier."""
    if doc_id is None or n == 0:
        return None
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """doc_id, runs (start, length, period; by start, then period) and collapsed: the words that are left when each run keeps its first period only.

    ``rewrite`` may give, for an identifier and a number of words, the places from which the words are taken before all else.
    """

    def step(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        codes, vocabulary, bounds = numbered_words(texts)
        sizes = np.diff(bounds)
        if rewrite:
            for doc, first, n in zip(ids.to_pylist(), bounds[:-1].tolist(), sizes.tolist(), strict=True):
                if (own := rewrite(doc, n)) is not None:
                    codes[first : first + n] = codes[first + own]
        text = owners(bounds)
        start, length, period = runs(text * len(vocabulary) + codes, int(sizes.max(initial=0)))
        drop = np.zeros(len(codes) + 1, np.int64)
        np.add.at(drop, start + period, 1)
        np.add.at(drop, start + length, -1)
        stay = np.cumsum(drop[:-1]) == 0
        own = text[start] if len(start) else np.zeros(0, np.int64)
        fields = [pa.array(x) for x in (start - bounds[own], length, period)]
        per_text = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(ids)))]).astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(per_text), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
        left = joined(codes[stay], vocabulary, np.concatenate([[0], np.cumsum(stay)])[bounds])
        return pa.RecordBatch.from_arrays([ids, listed, left], ["doc_id", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, behind in steps(pc.binary_length(batch.column(1))):
                yield step(batch.column(0).slice(first, behind - first), batch.column(1).slice(first, behind - first))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, f"doc_id long, runs {RUNS}, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """A row per text: number of runs, the longest one (ties: smallest start, then period), and SHA-256 of the list of runs and of the collapsed words."""
    by_length = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    best = F.array_max(by_length)
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines = F.transform("runs", lambda r: F.concat(line(r), F.lit("\n")))
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"), F.col("_best.length").alias("length"), (-F.col("_best.period")).alias("period"),
        F.expr("1000 * _best.length div -_best.period").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
