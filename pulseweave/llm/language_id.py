"""Language identification: known words first, then shorter and shorter character n-grams.

Training counts words and their character n-grams (1 to ``longest``, with word
ends marked) per language over labelled documents. It may use a sample of at most
about ``most_docs`` documents, shared evenly between languages: each takes up to
its share by a hash of the identifier, so a rare language is used whole. Counting is a Spark aggregation. Every word and n-gram that the
training texts have ``least`` times or more is known (by default all, so a language with one document has its words);
the sample bounds their number, and with it the model that the driver takes and sends to the tasks
(in documents, not in their length).

A whole text is scored by its distinct words: a known word gives its smoothed
log frequency in each language; an unseen word is cut into known n-grams of the
longest length that has any, and if none is left it says nothing. The score is
the share of the best language after normalising the mean log score per word.

A word is a run of letters with the combining marks behind them. Defined cases:
``und`` with score 0 for null texts and texts without a letter (digits and other
number characters are none); long texts are scored whole, by their distinct words;
without any labelled document every text is ``und``; ties go to the first
language by name; repeated rows get the same answer; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LETTERS, ASCII_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*"), re.compile(r"[a-z]+")
#: Weight of a word's evidence against a flat share.
SHARPNESS = 4.0
CACHED = 200_000


def held_out(id_col: str = "doc_id", of: int = 4, which: int = 2):
    """Whether a document is kept from training: crc32 of its identifier's text modulo ``of`` is ``which``."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(of)) == which


def words_of(text: str) -> Counter:
    text = text.lower()
    return Counter((ASCII_LETTERS if text.isascii() else LETTERS).findall(text))


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class Model:
    """Log frequencies per language (columns in order of ``langs``): rows of ``scores`` for known words and for n-grams by length."""

    langs: list[str]
    words: dict[str, int]
    by_length: list[dict[str, int]]  # longest first
    scores: np.ndarray
    seen: dict[str, int] = field(default_factory=dict)  # of unseen words, the row of ``memo``
    memo: np.ndarray | None = None

    def known_grams(self, word: str) -> list[int]:
        """Rows of a word's known n-grams of the longest length that has any."""
        longest = len(self.by_length)
        for at, table in enumerate(self.by_length):
            if found := [r for g in grams(word, longest - at) if (r := table.get(g)) is not None]:
                return found
        return []

    def unseen(self, words: list[str]) -> np.ndarray:
        """Evidence of words that are not known, a row each: the mean of their grams."""
        rows = [self.known_grams(w) for w in words]
        sizes = np.array([len(r) for r in rows])
        out = np.zeros((len(words), len(self.langs)))
        if (some := sizes > 0).any():
            starts = np.cumsum(sizes[some]) - sizes[some]
            out[some] = np.add.reduceat(self.scores[np.concatenate([r for r in rows if r])], starts, axis=0) / sizes[some, None]
        return out

    def remembered(self, words: list[str]) -> np.ndarray:
        """``unseen`` with a bounded memory of what this worker met."""
        if len(words) > CACHED:
            return self.unseen(words)
        if self.memo is None:
            self.memo = np.zeros((CACHED, len(self.langs)))
        new = [w for w in words if w not in self.seen]
        if len(self.seen) + len(new) > CACHED:
            self.seen.clear()
            new = words
        if new:
            first = len(self.seen)
            self.memo[first : first + len(new)] = self.unseen(new)
            self.seen.update(zip(new, range(first, first + len(new)), strict=True))
        return self.memo[[self.seen[w] for w in words]]

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text) if text else None
        if not words or not self.langs:
            return "und", 0.0
        rows = [self.words.get(w, -1) for w in words]
        counts, at = np.fromiter(words.values(), np.float64, len(words)), np.array(rows)
        known = at >= 0
        total = counts[known] @ self.scores[at[known]]
        if not known.all():
            total = total + counts[~known] @ self.remembered([w for w, r in zip(words, rows, strict=True) if r < 0])
        odds = np.exp(SHARPNESS * (total - total.max()) / counts.sum())
        best = int(total.argmax())
        return self.langs[best], float(odds[best] / odds.sum())


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", most_docs: int = 20_000, least: int = 1, longest: int = 5) -> Model:
    """Fit on labelled rows of ``docs``."""
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    langs = sorted(sizes)
    if sum(sizes.values()) > most_docs:
        share, odds = max(most_docs // len(langs), 1), 1 << 30
        most = labelled.sparkSession.createDataFrame([(lang, int(min(1.0, share / n) * odds)) for lang, n in sizes.items()], "lang string, most long")
        labelled = labelled.join(F.broadcast(most), "lang").filter(F.pmod(F.xxhash64("id"), F.lit(odds)) < F.col("most")).select("id", "text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                lang = lang.as_py()
                for word, count in words_of(text.as_py()).items():
                    found[lang, 0, word] += count
            for (lang, _, word), count in list(found.items()):
                for k in range(1, longest + 1):
                    for g in grams(word, k):
                        found[lang, k, g] += count
            langs, ks, keys = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(ks, pa.int32()), pa.array(keys, pa.string()), pa.array(found.values(), pa.int64())], ["lang", "k", "key", "n"])

    counts = labelled.select("text", "lang").mapInArrow(run, "lang string, k int, key string, n long")
    by_lang = F.array(*[F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("n"))), F.lit(0)) for lang in langs]) if langs else F.array().cast("array<long>")
    known = counts.groupBy("k", "key").agg(F.sum("n").alias("all"), by_lang.alias("n")).filter(F.col("all") >= least)
    return _model(known.select("k", "key", "n").toArrow(), langs, longest)


def _model(known: pa.Table, langs: list[str], longest: int) -> Model:
    ks = known["k"].to_numpy()
    keys = known["key"].to_pylist()
    counts = known["n"].combine_chunks().flatten().to_numpy().reshape(len(keys), len(langs)).astype(float)
    scores = np.zeros_like(counts)
    tables: list[dict[str, int]] = []
    for k in range(longest + 1):
        at = np.flatnonzero(ks == k)
        tables.append({keys[i]: i for i in at.tolist()})
        if len(at):
            logs = np.log((counts[at] + 0.5) / (counts[at].sum(0) + 0.5 * len(at)))
            # against the mean over languages, so that rare and frequent words weigh alike
            scores[at] = logs - logs.mean(1, keepdims=True)
    return Model(langs, tables[0], tables[:0:-1], scores)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = [known.predict(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
