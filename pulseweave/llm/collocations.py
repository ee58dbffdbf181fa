"""Phrases whose words belong together, counted by prefix-free parsing.

Texts become words and breaks. A pair of neighbours whose hash is divisible by
``every`` is a trigger; texts are cut at triggers into chunks that overlap by the trigger,
so equal passages give equal chunks wherever they lie. Distinct chunks and how often the
parse has each form the dictionary, and n-grams are counted inside
of distinct chunks only, times the chunk's frequency. An n-gram (three words at most) that starts
within a chunk's closing trigger is the next chunk's: each occurrence counts once.

Counting goes by length. An n-gram that occurs ``least`` times has parts that
do, so pairs are counted only between frequent words and triples only where both pairs
are frequent. Tasks know what is frequent from a bit table of hashes of fixed
size (at most 2**MOST_BITS bits); a false positive costs a row that the
exact sum drops again, so counts are exact at every size.

Everything is per language. Defined cases: null languages are ``und``, null and
empty texts have no words; a break is any run of the separators, and none is
inside of a phrase; texts of any length are taken whole; equal scores and
frequencies go by the phrase's bytes; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_by_size, materialise, text_of
from .word_arrays import joined, numbered_words, owners, steps

#: A separator, as a word of its own: no word holds it.
BREAK, SEPARATORS = ".", r"[.,;:!?\x0A-\x0D]+"
#: Longest phrase in words; chunks overlap by one word less.
LONGEST = 3
#: Largest bit table, 32 MB; from 2**(MOST_BITS - 4) frequent n-grams on it lets more pass.
MOST_BITS = 28


def word_hashes(vocabulary: pa.Array) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in vocabulary.to_pylist()], np.uint64)


def mixed(*parts: np.ndarray) -> np.ndarray:
    """A hash of several hashes in order."""
    with np.errstate(over="ignore"):
        out = np.zeros(1, np.uint64)
        for part in parts:
            out = (out ^ part) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out


def chunks(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", every: int = 32) -> DataFrame:
    """The dictionary: lang, chunk (words and breaks, joined by spaces), last (nothing follows in its text) and how often the parse has it."""

    def step(langs: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        spaced = pc.replace_substring_regex(pc.ascii_lower(texts), SEPARATORS, f" {BREAK} ")
        codes, vocabulary, bounds = numbered_words(spaced)
        text, hashes = owners(bounds), word_hashes(vocabulary)[codes] if len(codes) else np.zeros(0, np.uint64)
        cut = np.zeros(len(codes), bool)
        cut[bounds[:-1][np.diff(bounds) > 0]] = True
        cut[:-1] |= (mixed(hashes[:-1], hashes[1:]) % np.uint64(every) == 0) & (text[:-1] == text[1:])
        first = np.flatnonzero(cut)
        own = text[first]
        last = np.append(own[1:] != own[:-1], True)[: len(own)]
        behind = np.where(last, bounds[own + 1], np.append(first[1:], 0)[: len(own)] + LONGEST - 1)
        sizes = behind - first
        ends = np.concatenate([[0], np.cumsum(sizes)])
        made = joined(codes[np.repeat(first - ends[:-1], sizes) + np.arange(ends[-1])], vocabulary, ends)
        return pa.RecordBatch.from_arrays([langs.take(pa.array(own)), made, pa.array(last)], ["lang", "chunk", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, behind in steps(pc.binary_length(batch.column(1))):
                yield step(batch.column(0).slice(first, behind - first), batch.column(1).slice(first, behind - first))

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "lang string, chunk string, last boolean").groupBy("lang", "chunk", "last").agg(F.count(F.lit(1)).alias("times"))


def bit_table(frequent: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """Number of bits and the table with the bit of every row of ``frequent`` (lang, phrase) set: 16 bits a row, up to 2**MOST_BITS."""
    bits = int(np.clip(np.ceil(np.log2(max(16 * n, 1))), 10, MOST_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = np.array([phrase_hash(*row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)], np.uint64) & np.uint64((1 << bits) - 1)
            yield pa.RecordBatch.from_arrays([pa.array((hashes >> np.uint64(6)).astype(np.int64)), pa.array(np.left_shift(np.uint64(1), hashes & np.uint64(63)).view(np.int64))], ["at", "bits"])

    table = np.zeros(max(1, (1 << bits) // 64), np.uint64)
    found = frequent.select("lang", "phrase").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    table[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return bits, table


def phrase_hash(lang: str, phrase: str) -> int:
    parts = [np.uint64(xxhash.xxh64_intdigest(w)) for w in (lang, *phrase.split(" "))]
    return int(mixed(*(np.array([p]) for p in parts))[0])


def counted(dictionary: DataFrame, size: int, frequent: DataFrame | None, least: int) -> DataFrame:
    """lang, phrase and times of all phrases of ``size`` words that occur ``least`` times; all words for a size of 1.

    ``frequent``: the phrases of one word less that do.
    """
    bits, table = bit_table(frequent, frequent.count()) if frequent is not None else (0, np.zeros(0, np.uint64))
    shared = dictionary.sparkSession.sparkContext.broadcast(table)

    def known(hashes: np.ndarray) -> np.ndarray:
        at = hashes & np.uint64((1 << bits) - 1)
        return (shared.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1

    def step(langs: pa.Array, texts: pa.Array, last: pa.Array, times: pa.Array) -> pa.RecordBatch:
        codes, vocabulary, bounds = numbered_words(texts)
        n, vocab, chunk = len(codes), len(vocabulary), owners(bounds)
        langs = langs.dictionary_encode()
        lang, weight = langs.indices.to_numpy().astype(np.int64), times.to_numpy()
        to = np.where(last.to_numpy(zero_copy_only=False), bounds[1:], bounds[1:] - (LONGEST - 1))
        at = np.flatnonzero((np.arange(n) < to[chunk]) & (np.arange(n) + size <= bounds[1:][chunk]))
        stop = pc.index(vocabulary, BREAK).as_py()
        for k in range(size):
            at = at[codes[at + k] != stop]
        if size > 1 and len(at):
            own, hashes = word_hashes(langs.dictionary)[lang], word_hashes(vocabulary)
            for k in (0, 1):  # both parts of one word less
                at = at[known(mixed(own[chunk[at]], *(hashes[codes[at + k + i]] for i in range(size - 1))))]
        numbers = lang[chunk[at]]
        for k in range(size):
            numbers = np.unique(numbers, return_inverse=True)[1] * np.int64(vocab) + codes[at + k]
        _, one, inverse = np.unique(numbers, return_index=True, return_inverse=True)
        sums = np.zeros(len(one), np.int64)
        np.add.at(sums, inverse, weight[chunk[at]])
        words = [vocabulary.take(pa.array(codes[at[one] + k])) for k in range(size)]
        phrase = words[0] if size == 1 else pc.binary_join_element_wise(*words, " ")
        return pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang[chunk[at[one]]])), phrase, pa.array(sums)], ["lang", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size_ = [], 0  # several batches, so that more is added up before the exchange
        for batch in batches:
            for first, behind in steps(pc.binary_length(batch.column(1))):
                part = batch.slice(first, behind - first)
                held.append(part)
                size_ += part.nbytes
                if size_ >= 8 << 20:
                    yield step(*together(held))
                    held, size_ = [], 0
        if held:
            yield step(*together(held))

    def together(parts: list[pa.RecordBatch]) -> list[pa.Array]:
        return [c.combine_chunks() for c in pa.Table.from_batches(parts).columns]

    sums = dictionary.select("lang", "chunk", "last", "times").mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("times"))
    return sums if size == 1 else sums.filter(F.col("times") >= least)


def with_part(rows: DataFrame, part: str, known: DataFrame, name: str) -> DataFrame:
    """``rows`` with the frequency of ``part`` as ``name``. A part may begin a large part of all phrases, so rows are joined by its number of them."""
    sizes = rows.groupBy("lang", F.col(part).alias("phrase")).agg(F.count(F.lit(1)).alias("_with"))
    groups = materialise(sizes.join(known, ["lang", "phrase"]).select("lang", F.col("phrase").alias(part), F.col("times").alias(name), "_with"), "parts")
    return join_by_size(rows, groups, ["lang", part], "_with", rows.count()).drop("_with")


def cuts(found: dict[int, DataFrame]) -> DataFrame:
    """lang, phrase, a, l, r and score of every phrase of two words or more, by its lowest-scoring cut."""
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    scored = []
    for size in range(2, LONGEST + 1):
        for k in range(1, size):
            part = lambda a, b: F.array_join(F.slice(F.split("phrase", " "), a + 1, b - a), " ")  # noqa: B023, E731
            rows = found[size].select("lang", "phrase", F.col("times").alias("a"), part(0, k).alias("_left"), part(k, size).alias("_right"), F.lit(k).alias("k"))
            rows = with_part(materialise(rows, "cuts"), "_left", found[k], "l")
            scored.append(with_part(materialise(rows, "cuts"), "_right", found[size - k], "r").drop("_left", "_right"))
    all_ = reduce(DataFrame.unionByName, scored)
    score = F.call_function("div", wide("a") * wide("a") * F.lit(1_000_000).cast("decimal(38,0)"), wide("l") * wide("r"))
    best = F.min(F.struct("score", "k", "l", "r"))
    return all_.withColumn("score", score).groupBy("lang", "phrase", "a").agg(best.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def mine(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 10, covered: int = 50, most: int = 2000, slices: int = 32) -> DataFrame:
    """The first ``most`` phrases of each language: lang, rank, phrase, a, l, r, n and score.

    A phrase goes if one that is longer holds its words and has at least ``covered`` % of its occurrences.
    """
    dictionary = materialise(chunks(docs, lang_col, text_col), "chunks")
    found, frequent = {1: materialise(counted(dictionary, 1, None, least), "words")}, {}
    for size in range(2, LONGEST + 1):
        frequent[size - 1] = found[size - 1].filter(F.col("times") >= least)
        found[size] = materialise(counted(dictionary, size, frequent[size - 1], least), f"phrases{size}")
    scored = cuts({**found, 1: frequent[1]})
    longer = found[LONGEST].select("lang", "times", F.split("phrase", " ").alias("w"))
    longer = longer.select("lang", "times", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(2)), lambda k: F.array_join(F.slice("w", k, LONGEST - 1), " ")))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("times").alias("_longer"))
    left = scored.join(longer, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("_longer") < covered * F.col("a"), F.lit(True))).drop("_longer")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # first of slices, so that no task ranks a whole language
    sliced = left.withColumn("_slice", F.pmod(F.xxhash64("phrase"), F.lit(slices)))
    sliced = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_slice").orderBy(*order))).filter(F.col("rank") <= most)
    first = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= most)
    total = found[1].groupBy("lang").agg(F.sum("times").alias("n"))
    return first.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
