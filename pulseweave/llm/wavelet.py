"""Token ids on disk as wavelet matrices: succinct bit planes with rank and select.

A shard holds the ids of consecutive documents. Plane k has the k-th highest
bit of every id, the ids being stably sorted by the bits above it (zeros before
ones). With the number of ones before each block of 512 bits, an id is read,
counted before a position, or located by its n-th occurrence in one step per
plane, without decoding the shard. Shards are rows of zstd-compressed Parquet
files, one file per range of identifiers, written by Spark's own writer, so
that any store Spark can write will do.

Defined cases: a null or empty text is the end id alone; rows that repeat an
identifier follow each other in order of text; null identifiers come first; an
empty table gives no shard; other columns are ignored; an id that does not fit
into ``bits`` bits stops the job. A shard ends with the
document that fills it, so it holds ``shard_ids`` ids and one text more at
most.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_small, materialise, text_of
from .tokens import default_path, encoder

BLOCK = 512
SHARDS = "part int, shard int, first long, n_ids long, bits int, zeros array<long>, planes binary, ranks binary, doc_ids array<long>, doc_ids_null array<boolean>, doc_ends array<long>"


class WaveletMatrix:
    """A sequence of unsigned ids below 2**bits."""

    def __init__(self, n: int, bits: int, zeros: np.ndarray, planes: np.ndarray, ranks: np.ndarray):
        self.n, self.bits, self.zeros, self.planes, self.ranks = n, bits, zeros, planes, ranks

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        n, blocks = len(ids), len(ids) // BLOCK + 1
        planes, ranks, zeros = np.zeros((bits, blocks * BLOCK // 8), np.uint8), np.zeros((bits, blocks), np.uint32), np.zeros(bits, np.int64)
        for k in range(bits):
            ones = (ids & ids.dtype.type(1 << (bits - 1 - k))) != 0
            packed = np.packbits(ones, bitorder="little")
            planes[k, : len(packed)] = packed
            ranks[k, 1:] = np.cumsum(np.bitwise_count(planes[k].reshape(blocks, -1)).sum(1, dtype=np.uint32))[:-1]
            zeros[k] = n - int(ones.sum())
            ids = np.concatenate([np.compress(~ones, ids), np.compress(ones, ids)])
        return cls(n, bits, zeros, planes, ranks)

    @classmethod
    def read(cls, n: int, bits: int, zeros, planes: bytes, ranks: bytes) -> WaveletMatrix:
        return cls(n, bits, np.asarray(zeros, np.int64), np.frombuffer(planes, np.uint8).reshape(bits, -1), np.frombuffer(ranks, "<u4").reshape(bits, -1))

    def _bit(self, k: int, i: int) -> int:
        return int(self.planes[k, i >> 3]) >> (i & 7) & 1

    def _ones(self, k: int, i: int) -> int:
        """Ones of plane ``k`` before position ``i``."""
        block, byte = i // BLOCK, i >> 3
        inside = int(np.bitwise_count(self.planes[k, block * BLOCK // 8 : byte]).sum())
        return int(self.ranks[k, block]) + inside + (int(self.planes[k, byte]) & ((1 << (i & 7)) - 1)).bit_count()

    def access(self, i: int) -> int:
        value = 0
        for k in range(self.bits):
            bit, ones = self._bit(k, i), self._ones(k, i)
            value = value << 1 | bit
            i = int(self.zeros[k]) + ones if bit else i - ones
        return value

    def _range(self, value: int, i: int) -> tuple[int, int]:
        """Where the occurrences of ``value`` before position ``i`` lie after the last plane."""
        a, b = 0, i
        for k in range(self.bits):
            x, y = self._ones(k, a), self._ones(k, b)
            a, b = (int(self.zeros[k]) + x, int(self.zeros[k]) + y) if value >> (self.bits - 1 - k) & 1 else (a - x, b - y)
        return a, b

    def count(self, value: int, i: int | None = None) -> int:
        """Occurrences of ``value`` before position ``i``."""
        if value >> self.bits:
            return 0
        a, b = self._range(value, self.n if i is None else i)
        return b - a

    def _select(self, k: int, bit: int, nth: int) -> int:
        """Position of the ``nth`` (from 0) one or zero of plane ``k``: the block by binary search in the ranks, the rest inside it."""
        before = self.ranks[k].astype(np.int64)
        if not bit:
            before = np.arange(len(before)) * BLOCK - before
        block = int(np.searchsorted(before, nth, side="right")) - 1
        inside = np.unpackbits(self.planes[k, block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little") == bit
        return block * BLOCK + int(np.flatnonzero(inside)[nth - int(before[block])])

    def locate(self, value: int, nth: int) -> int:
        """Position of the ``nth`` (from 0) occurrence of ``value``."""
        at = self._range(value, self.n)[0] + nth
        for k in reversed(range(self.bits)):
            bit = value >> (self.bits - 1 - k) & 1
            at = self._select(k, bit, at - int(self.zeros[k]) if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids, plane by plane from the last."""
        ids = np.zeros(self.n, np.uint32)
        for k in reversed(range(self.bits)):
            ones = np.unpackbits(self.planes[k], count=self.n, bitorder="little").astype(bool)
            out = np.empty_like(ids)
            out[np.flatnonzero(~ones)] = ids[: int(self.zeros[k])]
            out[np.flatnonzero(ones)] = ids[int(self.zeros[k]) :] | np.uint32(1 << (self.bits - 1 - k))
            ids = out
        return ids


def _shard(part: int, shard: int, first: int, ids: list[np.ndarray], docs: list[int | None], bits: int, end_id: int) -> dict:
    """The shard of documents whose ids, without the end id behind each, are ``ids``."""
    ends = np.cumsum([len(x) + 1 for x in ids])
    whole = np.full(ends[-1], end_id, np.uint16 if bits <= 16 else np.uint32)
    own = np.ones(len(whole), bool)
    own[ends - 1] = False
    whole[own] = np.concatenate(ids)
    matrix = WaveletMatrix.build(whole, bits)
    return {
        "part": part, "shard": shard, "first": first, "n_ids": matrix.n, "bits": bits, "zeros": matrix.zeros.tolist(), "planes": matrix.planes.tobytes(), "ranks": matrix.ranks.astype("<u4").tobytes(),
        "doc_ids": [d or 0 for d in docs], "doc_ids_null": [d is None for d in docs], "doc_ends": ends.tolist(),
    }


SHARD_TYPES = pa.schema([
    ("part", pa.int32()), ("shard", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("bits", pa.int32()), ("zeros", pa.list_(pa.int64())), ("planes", pa.binary()), ("ranks", pa.binary()),
    ("doc_ids", pa.list_(pa.int64())), ("doc_ids_null", pa.list_(pa.bool_())), ("doc_ends", pa.list_(pa.int64())),
])


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, bits: int = 16, shard_ids: int = 1 << 21, tokenizer: str | None = None) -> DataFrame:
    """The shards of all documents in ascending order of identifier, each encoded whole with ``end_id`` behind it; ids of more than ``bits`` bits are an error."""
    path = tokenizer or default_path()
    if end_id >> bits:
        raise ValueError(f"id {end_id} needs more than {bits} bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, first, encode = TaskContext.get().partitionId(), 0, 0, encoder(path).batch
        held, docs_held, n = [], [], 0
        emit = lambda: pa.RecordBatch.from_pylist([_shard(part, shard, first, held, docs_held, bits, end_id)], schema=SHARD_TYPES)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for low, high, ids, ends in encode(batch.column(1)):
                if len(ids) and (top := int(ids.max())) >> bits:
                    raise ValueError(f"id {top} needs more than {bits} bits")
                ids, begin = ids.astype(np.uint16 if bits <= 16 else np.uint32), 0
                for doc_id, end in zip(doc_ids[low:high], ends.tolist(), strict=True):
                    held.append(ids[begin:end])
                    docs_held.append(doc_id)
                    n, begin = n + end - begin + 1, end
                    if n >= shard_ids:
                        yield emit()
                        shard, first, held, docs_held, n = shard + 1, first + n, [], [], 0
        if held:
            yield emit()

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    # rows that repeat an identifier, and even its text, need not fit one task: texts are told apart by their beginning and a hash, equal rows by where they come from
    order = ["doc_id", "_start", "_hash", "_spread"]
    keyed = texts.withColumns({"_start": F.substring("text", 1, 32), "_hash": F.xxhash64("text"), "_spread": F.pmod(F.monotonically_increasing_id(), F.lit(4096))})
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, SHARDS)


def write(docs: DataFrame, path: str, **options) -> None:
    shards(docs, **options).write.option("compression", "zstd").parquet(path)


def starts(files: DataFrame) -> DataFrame:
    """(part, base): ids in all parts before; a row per part."""
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    return parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))


def _matrix(row: dict) -> WaveletMatrix:
    return WaveletMatrix.read(row["n_ids"], row["bits"], row["zeros"], row["planes"], row["ranks"])


def documents(files: DataFrame) -> DataFrame:
    """One row per document, decoded from the shards: doc_id, start, n_tokens, ids (unsigned 32-bit, little-endian) and ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ids, ends = _matrix(row).decode().astype("<u4"), row["doc_ends"]
                begins = [0, *ends[:-1]]
                for at in range(0, len(ends), 512):
                    own = slice(at, at + 512)
                    cuts = [ids[a:b].tobytes() for a, b in zip(begins[own], ends[own], strict=True)]
                    doc_ids = [None if null else d for d, null in zip(row["doc_ids"][own], row["doc_ids_null"][own], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["part"]] * len(cuts), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array([row["first"] + a for a in begins[own]], pa.int64()), pa.array([len(c) // 4 for c in cuts], pa.int64()), pa.array([zlib.crc32(c) for c in cuts], pa.int64()), pa.array(cuts, pa.binary())],
                        ["part", "doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                    )

    found = files.mapInArrow(run, "part int, doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
    return join_small(found, starts(files), ["part"]).select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", "ids")


def occurrences(files: DataFrame, token: int, most: int | None = None) -> DataFrame:
    """(part, shard, n, positions): how often a shard has ``token``, and its first ``most`` (None: all) positions in all ids; by rank and select, without decoding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                matrix = _matrix(row)
                n = matrix.count(token)
                at = [row["first"] + matrix.locate(token, k) for k in range(n if most is None else min(n, most))]
                yield pa.RecordBatch.from_pylist([{"part": row["part"], "shard": row["shard"], "n": n, "at": at}], schema=pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n", pa.int64()), ("at", pa.list_(pa.int64()))]))

    found = files.mapInArrow(run, "part int, shard int, n long, at array<long>")
    return join_small(found, starts(files), ["part"]).select("part", "shard", "n", F.transform("at", lambda x: x + F.col("base")).alias("positions"))


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write the documents as shards into the shared folder and read them back."""
    return documents(materialise(shards(docs, **options), "wavelet_shards", compression="zstd"))


def open_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARDS).parquet(path)
