"""Quality rules for documents and for the hosts they come from.

Each whole text is measured once, in Python tasks over Arrow batches. A
document fails by itself if it is too short or repeats itself. Failures of all
rules are then summed per host; a host's rate is shrunk towards the corpus by a
beta prior whose two parameters come from the hosts themselves (method of
moments on their rates, weighted by documents), so a host with three bad pages
is not judged like one with three million. Hosts whose shrunk rate exceeds
``most_failed`` are rejected whole. Sums are made before the exchange, and only
rejected hosts are joined back.

Defined cases: a null or empty text has no words and fails; a null host is a
host; ties and repeated rows are judged alike; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, join_small, materialise, text_of
from .words import SPACES, repeated_window_words

SYMBOLS = "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measure(text: str) -> tuple[int, int, int, int, int]:
    words = text.encode().split()
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_window_words(words),
    )


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host and the MEASURES of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(text.as_py()) for text in batch.column(2)]
            columns = [pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else [[]] * 5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "host", *MEASURES])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id long, host string, " + ", ".join(f"{m} long" for m in MEASURES))


def base_failed(least_words: int = 10, most_repeated: int = 20) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))


def rules(least_words: int = 10, most_repeated: int = 20) -> dict[str, Column]:
    """Failures that count against a host."""
    return {
        "base": base_failed(least_words, most_repeated),
        "symbols": 10 * F.col("n_symbols") > F.col("word_chars"),
        "word_length": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words")),
        "lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_words"),
    }


def host_rates(measured: DataFrame, least_words: int = 10, most_repeated: int = 20) -> DataFrame:
    """A row per host: docs, failures of each rule and of any, and the shrunk rate."""
    failed = rules(least_words, most_repeated)
    anyone = F.lit(False)
    for f in failed.values():
        anyone = anyone | f
    hosts = measured.groupBy(F.col("host").isNull().alias("host_null"), F.coalesce("host", F.lit("")).alias("host")).agg(
        F.count(F.lit(1)).alias("docs"), F.sum(anyone.cast("long")).alias("failed"), *[F.sum(f.cast("long")).alias(f"failed_{name}") for name, f in failed.items()]
    )
    mean = F.sum("failed") / F.sum("docs")
    square = F.sum(F.col("failed") * F.col("failed") / F.col("docs")) / F.sum("docs")
    prior = hosts.agg(mean.alias("mean"), (square - mean * mean).alias("spread"))
    strength = F.when(F.col("spread") > 0, F.least(F.greatest(F.col("mean") * (1 - F.col("mean")) / F.col("spread") - 1, F.lit(1.0)), F.lit(1e6))).otherwise(F.lit(1e6))
    known = prior.select("mean", strength.alias("strength")).first()  # two numbers
    mean, strength = (F.lit(known[c]).cast("double") for c in ("mean", "strength"))
    return hosts.withColumn("rate", (F.col("failed") + mean * strength) / (F.col("docs") + strength))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", least_words: int = 10, most_repeated: int = 20, most_failed: float = 0.5) -> DataFrame:
    """One row per document: doc_id, host, MEASURES, base_failed, host_failed and kept."""
    measured = materialise(measures(docs, id_col, text_col, host_col), "measures")
    rejected = materialise(host_rates(measured, least_words, most_repeated).filter(F.col("rate") > most_failed).select("host_null", F.col("host").alias("host_key"), F.lit(True).alias("host_failed")), "rejected_hosts")
    keyed = measured.withColumns({"host_null": F.col("host").isNull(), "host_key": F.coalesce("host", F.lit(""))})
    out = join_small(keyed, rejected, ["host_null", "host_key"], "left").withColumns({"base_failed": base_failed(least_words, most_repeated), "host_failed": F.coalesce("host_failed", F.lit(False))})
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed")).select("doc_id", "host", *MEASURES, "base_failed", "host_failed", "kept")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", least_words: int = 10, most_repeated: int = 20, most_failed: float = 0.5) -> DataFrame:
    """``docs`` that are kept, columns unchanged. Texts are not shuffled: each is measured again where it lies, and rejected hosts are joined to it."""
    measured = materialise(measures(docs, id_col, text_col, host_col), "measures")
    null, host = fresh(docs, "_host_null", "_host")
    rejected = materialise(host_rates(measured, least_words, most_repeated).filter(F.col("rate") > most_failed).select(F.col("host_null").alias(null), F.col("host").alias(host)), "rejected_hosts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for text in batch.column(batch.schema.get_field_index(text_col)):
                n, _, _, _, repeated = measure(text.as_py() or "")
                keep.append(n >= least_words and 100 * repeated <= most_repeated * n)
            yield batch.filter(pa.array(keep, pa.bool_()))

    good = docs.mapInArrow(run, docs.schema).withColumns({null: F.col(host_col).isNull(), host: F.coalesce(F.col(host_col).cast("string"), F.lit(""))})
    return join_small(good, rejected, [null, host], "left_anti").select(*docs.columns)
