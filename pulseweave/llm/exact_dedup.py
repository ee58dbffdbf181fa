"""Exact duplicates by a tree of merges over sorted digest runs. DataFrame operations only.

Every input partition belongs to one of ``runs`` runs. A run first reduces its
own rows to one row per text: digest, byte length and a second hash, the
identifier to keep and the number of rows. It is written sorted by digest, in ranges of
the digest's first byte. Then ``fan_in`` neighbouring runs meet in every round (run 0..7 -> 0, 8..15 -> 1,
...): equal ranges of them are exchanged, merged in order of digest and reduced where keys are equal,
and the merged run is written sorted again, until a single run is left. A lost executor
costs the round that it was in. A group of copies that holds a third of the table is reduced
before the first exchange and reaches any other as a row per run, never as its members. Two rows count as equal only
if SHA-256, byte length and XXH64 of the text all agree, at every level.

Defined cases: a null text is the empty text; a null identifier loses to any
other and is kept only if the group has nothing else; of rows that repeat
identifier and text one is kept; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, join_by_size, materialise, text_of

KEY = ["digest", "check", "n_bytes"]


def digest_of(text_col: str = "text") -> Column:
    """SHA-256 of the text."""
    return F.unhex(F.sha2(text_of(text_col), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 64) -> DataFrame:
    """One row per document: identifier, row number, run and key."""
    text = text_of(text_col)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.pmod(F.spark_partition_id(), F.lit(runs)).alias("run"),
        digest_of(text_col).alias("digest"),
        F.xxhash64(text).alias("check"),
        F.octet_length(text).alias("n_bytes"),
    )


def merge_runs(rows: DataFrame, keep: str = "smallest", runs: int = 64, fan_in: int = 8) -> DataFrame:
    """Rounds of ``fan_in``-way merges of runs; a row per text with ``best`` and ``group_size``."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    # null is the lowest value of a struct's field
    order = F.struct(F.col("doc_id"), F.col("row")) if keep == "largest" else F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id"), F.col("row"))
    pick = F.max if keep == "largest" else F.min
    # before any exchange, each task reduces what it has of a run
    level = rows.groupBy("run", *KEY).agg(pick(order).alias("best"), F.count(F.lit(1)).alias("group_size"))
    level = _written_runs(level.withColumn("span", F.hex(F.substring("digest", 1, 1))), "runs")
    while runs > 1:
        runs = -(-runs // fan_in)
        met = level.withColumn("run", F.floor(F.col("run") / fan_in))
        # the exchange that brings ranges together is the one that the merge needs: no other follows
        met = met.repartition("run", "span").sortWithinPartitions("run", "span", *KEY)
        level = _written_runs(met.groupBy("run", "span", *KEY).agg(pick("best").alias("best"), F.sum("group_size").alias("group_size")), f"merged_{runs}", exchanged=True)
    return level.drop("run", "span")


def _written_runs(level: DataFrame, name: str, exchanged: bool = False) -> DataFrame:
    """Runs as files, each sorted by digest within its range."""
    dealt = level if exchanged else level.repartition("run", "span")
    return materialise(dealt.sortWithinPartitions("run", "span", *KEY), name)


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", runs: int = 64, fan_in: int = 8) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (and the key columns).

    The text is read once; what follows works on the written table of keys.
    """
    rows = materialise(digests(docs, id_col, text_col, runs), "digests")
    groups = merge_runs(rows, keep, runs, fan_in).select(*KEY, F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size")
    return join_by_size(rows, groups, KEY, "group_size", rows.count()).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), *KEY
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """``docs`` without all but one row of each text, columns unchanged."""
    found = find_copies(docs, id_col, text_col, keep)
    return keep_rows(docs, found.filter("kept").select("doc_id", "digest"), found.filter(~F.col("kept") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).isEmpty(), id_col, text_col)


def keep_rows(docs: DataFrame, kept: DataFrame, unique: bool, id_col: str, text_col: str) -> DataFrame:
    """Rows of ``docs`` whose identifier and SHA-256 of the text are in ``kept`` (doc_id, digest); one of each, where they are not ``unique``."""
    own, keep_id, keep_digest = fresh(docs, "_row_digest", "_keep_id", "_keep_digest")
    kept = kept.select(F.col("doc_id").alias(keep_id), F.col("digest").alias(keep_digest))
    keyed = docs.withColumn(own, digest_of(text_col))
    # one plan at every size: texts meet what is kept by a merge join, also where that would fit a broadcast
    out = keyed.join(kept.hint("merge"), F.col(id_col).cast("long").eqNullSafe(F.col(keep_id)) & (F.col(own) == F.col(keep_digest)), "left_semi")
    return (out if unique else out.dropDuplicates([id_col, own])).drop(own)


def keep_firsts(docs: DataFrame, rows: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The row ``first`` (doc_id, digest) of each of ``groups``; ``rows`` has both columns for every row of ``docs``."""
    kept = materialise(groups.select("first.doc_id", "first.digest"), "kept_documents")
    again = rows.select("doc_id", "digest").join(kept.select(F.col("doc_id").alias("k"), F.col("digest").alias("d")).hint("merge"), F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("digest") == F.col("d")), "left_semi")
    return keep_rows(docs, kept, again.count() == kept.count(), id_col, text_col)
