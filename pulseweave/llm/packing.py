"""Best-fit decreasing packing of token sequences.

Which bin a piece goes to depends only on lengths, and there are at most
``capacity`` of them. So the plan is made from the histogram of lengths: a
segment tree over remaining capacities gives the tightest open bin that fits
in logarithmic time, and pieces of one length are placed in one step per run
of equal bins, exactly as one by one (a bin that took a piece is the tightest
for the next of that length as long as it fits). The plan maps the r-th piece
of a length to its sequence and offset; its size is bounded by capacity, not by
the number of documents.

Python tasks encode whole texts, cut what is longer than ``capacity`` and count
per length; the written pieces carry (part, length, rank in part). A prefix sum
of the counts makes the rank global, so nothing is sorted or gathered.

Defined cases: a null or empty text is the end id alone; repeated rows and
identifiers are packed one by one; a null identifier is kept; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_of
from .tokens import default_path, encoder

PIECES = "doc_id long, piece int, start long, length int, ids binary, part int, rank long"


class OpenBins:
    """Runs of bins by remaining capacity, with a segment tree that finds the smallest remaining capacity of at least a length."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.most = np.full(2 * self.size, -1)  # the largest open capacity below a node
        self.runs: dict[int, deque[tuple[int, int]]] = {}

    def _mark(self, left: int) -> None:
        at = left + self.size
        self.most[at] = left if self.runs.get(left) else -1
        while at > 1:
            at //= 2
            self.most[at] = max(self.most[2 * at], self.most[2 * at + 1])

    def tightest(self, length: int) -> int | None:
        """The smallest open remaining capacity that is at least ``length``."""
        at = length + self.size
        if self.most[at] >= 0:
            return length
        while at > 1:
            if at % 2 == 0 and self.most[at + 1] >= 0:
                at += 1
                break
            at //= 2
        else:
            return None
        while at < self.size:
            at = 2 * at if self.most[2 * at] >= 0 else 2 * at + 1
        return int(self.most[at])

    def put(self, left: int, first: int, count: int) -> None:
        if count and left:
            self.runs.setdefault(left, deque()).append((first, count))
            self._mark(left)

    def take(self, left: int) -> tuple[int, int]:
        run = self.runs[left].popleft()
        self._mark(left)
        return run


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces per sequence, offset), in order of length and rank."""
    bins, sequences, rows = OpenBins(capacity), 0, []
    for length in sorted(counts, reverse=True):
        rank, count = 0, counts[length]
        while rank < count:
            left = bins.tightest(length)
            if left is None:
                new = -(-(count - rank) // (capacity // length))
                bins.put(capacity, sequences, new)
                sequences += new
                continue
            first, many = bins.take(left)
            each = left // length
            full = min(many, (count - rank) // each)
            if full:
                rows.append((length, rank, first, each, capacity - left))
                rank += full * each
                bins.put(left - each * length, first, full)
            elif rank < count:  # the last few go to one bin
                rows.append((length, rank, first, each, capacity - left))
                bins.put(left - (count - rank) * length, first, 1)
                rank, full = count, 1
            bins.put(left, first + full, many - full)
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """Whole texts as ids with ``end_id`` at the end, cut at ``capacity``; written to the shared folder."""
    path, mark = tokenizer or default_path(), end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ranks, encode = TaskContext.get().partitionId(), Counter(), encoder(path).batch
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for low, high, found, ends in encode(batch.column(1)):
                out: list[list] = [[] for _ in range(6)]
                begin = 0
                for doc_id, end in zip(doc_ids[low:high], ends.tolist(), strict=True):
                    ids, begin = found[begin:end].tobytes() + mark, end
                    for k, start in enumerate(range(0, len(ids) // 4, capacity)):
                        cut = ids[4 * start : 4 * (start + capacity)]
                        length = len(cut) // 4
                        for column, value in zip(out, (doc_id, k, start, length, cut, ranks[length]), strict=True):
                            column.append(value)
                        ranks[length] += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
                doc, k, start, length, cut, rank = (pa.array(c, t) for c, t in zip(out, kinds, strict=True))
                yield pa.RecordBatch.from_arrays([doc, k, start, length, cut, pa.array([part] * len(doc), pa.int32()), rank], ["doc_id", "piece", "start", "length", "ids", "part", "rank"])

    return materialise(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, PIECES), "pieces", compression="zstd")


def place(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """``cut`` (with part, length and rank; other columns stay) with sequence_id and offset."""
    histogram = materialise(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("pieces")), "lengths")
    before = F.sum("pieces").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = histogram.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    counts = {r["length"]: r["pieces"] for r in histogram.groupBy("length").agg(F.sum("pieces").alias("pieces")).collect()}  # at most capacity rows
    table = plan(counts, capacity)
    keys = table[:, 0] << 44 | table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            rows = table[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            step = rank - rows[:, 1]
            found = [pa.array(rows[:, 2] + step // rows[:, 3]), pa.array(rows[:, 4] + step % rows[:, 3] * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*batch.schema.names, "sequence_id", "offset"])

    # no key is hot: it holds rows of one part and length only; Spark broadcasts by measured size or shuffles
    ranked = cut.join(bases, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. The ids themselves do not travel; ``sequences`` has them."""
    cut = pieces(docs, id_col, text_col, capacity, end_id, tokenizer)
    placed = place(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "part", "rank"), capacity)
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """The packed sequences: sequence_id, n_tokens and ids (unsigned 32-bit, little-endian). A sequence has at most ``capacity`` ids, so groups are bounded."""
    placed = place(pieces(docs, id_col, text_col, capacity, end_id, tokenizer).select("length", "ids", "part", "rank"), capacity)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])
    joined = F.aggregate(parts, F.lit(b""), lambda a, b: F.concat(a, b))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
