"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``points`` places on a ring of 64-bit hashes, and every row lies
on the ring by the hash of its identifier. A row goes to the shard of the next
point clockwise; if that shard is full, on to the next point whose shard is
not. A shard holds at most its share of all rows times 1 + ``slack``; with a
slack of 0 the shares are those of a division with remainder, so the numbers of
rows of two shards differ by one at most.

The rows of an arc (between two points) need not be moved one by one: counts per arc
say how many of an arc's rows, in order of hash, stay at each shard they come by.
So the driver sees one count per arc (shards x points, never rows) and
gives back stretches (arc, from, to, shard), one more than arcs for each shard
that fills up, and a row only needs its place within its arc. Arcs are
ranked in ``BUCKETS`` parts each, by windows that share the arc's rows.

Rows that repeat identifier, size and checksum are counted first and laid
out again at the end, in blocks, so a value that a third of all rows have is a single row
until then, and its rows fill several shards one after another.

Defined cases: a null text is empty; rows without an identifier share a place on the ring and
overflow like any others; more shards than rows leave shards empty; an empty
table gives an empty result; other columns are ignored. Equal texts are not kept
together: a row's place depends on its identifier and on which shards are full.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_of

#: Parts in which the rows of an arc are ranked.
BUCKETS = 4
#: Repeated rows are laid out in blocks of so many.
BLOCK = 100_000


def ring(shards: int, points: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Places on the ring, ascending, and the shard at each. A shard's places do not depend on the other shards."""
    at = {int.from_bytes(hashlib.md5(f"{s}|{k}".encode()).digest()[:8], "big", signed=True): s for s in range(shards) for k in range(points)}
    return np.array(sorted(at), np.int64), np.array([at[p] for p in sorted(at)])


def capacities(rows: int, shards: int, slack: float = 0.0) -> np.ndarray:
    """The most rows that each shard takes: with a slack of 0 the sum is ``rows``."""
    if slack:
        return np.full(shards, int(np.ceil((1 + slack) * rows / shards)))
    return rows // shards + (np.arange(shards) < rows % shards)


def stretches(counts: np.ndarray, shard_at: np.ndarray, most: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(arc, from, to, shard, slot of the first): where the rows of each arc go, by their place in the arc.

    All arcs begin at their own point; what a full shard does not take goes on to
    the next point of one that is not full, until all rows are placed. A shard that was
    passed by is full and stays so, which is all that the rule asks for.
    """
    if counts.sum() > most.sum():
        raise ValueError("the shards cannot hold all rows")
    held, out, n = np.zeros(len(most), np.int64), [], len(shard_at)
    waiting = [(arc, arc, 0) for arc in np.flatnonzero(counts).tolist()]  # arc, point, rows that are placed
    while waiting:
        further = []
        for arc, point, done in waiting:
            shard = int(shard_at[point])
            take = int(min(counts[arc] - done, most[shard] - held[shard]))
            if take:
                out.append((arc, done, done + take, shard, int(held[shard])))
                held[shard] += take
            if done + take < counts[arc]:
                further.append((arc, point, done + take))
        open_ = np.flatnonzero((held < most)[shard_at])  # points of shards that are not full
        waiting = [(arc, int(open_[np.searchsorted(open_, point + 1) % len(open_)]), done) for arc, point, done in further]
    return out


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (bytes of the text and 16), text_crc32 and copies, a row per distinct row."""
    text = text_of(text_col).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))


def assign(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", points: int = 256, slack: float = 0.0) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard)."""
    spark, (places, shard_at) = docs.sparkSession, ring(shards, points)

    @F.pandas_udf("int")
    def arc_of(h: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(places, h.to_numpy()) % len(places))

    # rows without an identifier have one hash
    rows = keyed(docs, id_col, text_col).withColumn("arc", arc_of(F.xxhash64("doc_id"))).withColumn("bucket", F.pmod(F.xxhash64("text_crc32", "size", "doc_id"), F.lit(BUCKETS)))
    rows = materialise(rows, "ring_keys")
    counted = materialise(rows.groupBy("arc", "bucket").agg(F.sum("copies").alias("rows")), "ring_counts")
    counts = np.zeros(len(places), np.int64)
    for row in counted.groupBy("arc").agg(F.sum("rows").alias("rows")).toLocalIterator():  # at most shards x points rows
        counts[row["arc"]] = row["rows"]
    planned = stretches(counts, shard_at, capacities(int(counts.sum()), shards, slack))
    plan = spark.createDataFrame(planned, "arc int, first long, behind long, shard int, slot_first long")
    within = Window.partitionBy("arc").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.withColumn("base", F.coalesce(F.sum("rows").over(within), F.lit(0))).select("arc", "bucket", "base")
    before = Window.partitionBy("arc", "bucket").orderBy(F.xxhash64("doc_id", "text_crc32", "size"), "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    # both tables are bounded by shards, points and BUCKETS
    ranked = rows.withColumn("place", F.coalesce(F.sum("copies").over(before), F.lit(0))).join(F.broadcast(bases), ["arc", "bucket"])
    ranked = ranked.withColumn("place", F.col("place") + F.col("base")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(BLOCK).cast("long"))))
    dealt = ranked.repartition("arc", "bucket", "block").withColumn("k", F.explode(F.sequence(F.col("block"), F.least(F.col("block") + BLOCK, "copies") - 1))).withColumn("place", F.col("place") + F.col("k"))
    placed = dealt.join(F.broadcast(plan), "arc").filter((F.col("first") <= F.col("place")) & (F.col("place") < F.col("behind")))
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("slot_first") + F.col("place") - F.col("first")).alias("slot"))
