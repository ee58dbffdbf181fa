"""Seeded permutations of an entity's events, and adjacent statistics under them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import md5_int
from .events import by, steps
from .statistics import four_stats


def orders(valid: DataFrame, keys: Sequence[str], seeds: Sequence[int], identity: str) -> DataFrame:
    """Valid events once per seed, with vector_origin (their place) and valid_position (their new place); seed 0 changes nothing.

    All values of an event move together, and the order is one of hashes, so any engine can repeat it.
    """
    keys = list(keys)
    rows = valid.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds]))).withColumn("vector_origin", F.col("beat_index"))
    draw = F.when(F.col("seed") == 0, F.lit(0)).otherwise(md5_int(F.col("seed"), *[F.col(k) for k in keys], F.col(identity)))
    return rows.withColumn("valid_position", F.row_number().over(by([*keys, "seed"], draw, "beat_index")) - 1)


def seeded_permutations(sizes: DataFrame, key: str, size: str, seeds: Sequence[int], block: int = 100_000) -> DataFrame:
    """key, seed, valid_position, vector_origin: for each record the permutation that NumPy's default generator draws from SeedSequence([seed, key]); seed 0 changes nothing.

    A stream of random numbers is seeded per record and seed, so any task can draw it: the table of sizes, a row per record, is dealt out, and no record's rows are gathered.
    Keys are integers from 0; a permutation is one record's numbers at a time and is sent in blocks.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for seed in seeds:
                    order = np.arange(n) if seed == 0 else np.random.default_rng(np.random.SeedSequence([seed, own])).permutation(n)
                    for at in range(0, n, block):
                        part = order[at : at + block]
                        columns = [np.full(len(part), own), np.full(len(part), seed, np.int32), np.arange(at, at + len(part)), part]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "seed", "valid_position", "vector_origin"])

    rows = sizes.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(size).cast("long").alias("n"))
    return rows.mapInArrow(run, "key long, seed int, valid_position long, vector_origin long").withColumnRenamed("key", key)


def numpy_orders(valid: DataFrame, key: str, seeds: Sequence[int]) -> DataFrame:
    """``orders`` with the permutations of NumPy's generator instead of hashes: valid events once per seed with vector_origin and valid_position."""
    moved = seeded_permutations(valid.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), key, "_n", seeds)
    return valid.withColumn("vector_origin", F.col("beat_index").cast("long")).join(moved, [key, "vector_origin"])


def adjacent_stats(valid: DataFrame, keys: Sequence[str], values: Sequence[str], seeds: Sequence[int], identity: str) -> DataFrame:
    """Four statistics of the steps between neighbours for each seed: permuted values under the mask of the original places, whose number of pairs no seed changes."""
    keys = list(keys)
    return moved_stats(orders(valid, keys, seeds, identity), valid, keys, values)


def moved_stats(moved: DataFrame, valid: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``adjacent_stats`` of events that are permuted already."""
    keys, moved = list(keys), moved.drop("edge")
    mask = valid.select(*keys, F.col("beat_index").alias("valid_position"), "edge")
    rows = steps(moved.join(mask, [*keys, "valid_position"]), [*keys, "seed"], "valid_position", values)
    return four_stats(rows, [*keys, "seed"], values, 2, [F.sum(F.coalesce(F.col("edge"), F.lit(False)).cast("int")).alias("pairs")])


def neighbours(moved: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Original places i < j of the events that are neighbours after a permutation, at the original edges: (keys, seed, valid_position, i, j), a row per edge and seed."""
    keys = list(keys)
    nxt = F.lead("vector_origin").over(by([*keys, "seed"], "valid_position"))
    rows = moved.select(*keys, "seed", "valid_position", "vector_origin", nxt.alias("_next")).join(edges.filter("edge").select(*keys, F.col("beat_index").alias("valid_position")), [*keys, "valid_position"])
    return rows.select(*keys, "seed", "valid_position", F.least("vector_origin", "_next").alias("i"), F.greatest("vector_origin", "_next").alias("j"))


def neighbour_distances(moved: DataFrame, edges: DataFrame, pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distances between neighbours after a permutation, looked up in the table of pairs (keys, i < j, distance) of the original places."""
    return neighbours(moved, edges, keys).join(pairs, [*keys, "i", "j"])


def distance_stats(edges: DataFrame, pairs: DataFrame, keys: Sequence[str], seeds: Sequence[int], identity: str, distances: Sequence[str]) -> DataFrame:
    """Four statistics of the distances between neighbours for each seed, a row per record and seed (also without a pair), with the number of original edges as pairs.

    ``edges`` are the valid events with beat_index and edge (see ``events.adjacent``): only places whose successor was the next event before any
    permutation count, so gaps stay gaps in every order. ``pairs`` has every i < j of a record once.
    """
    keys = [*keys, "seed"]
    moved = orders(edges, keys[:-1], seeds, identity)
    found = four_stats(neighbour_distances(moved, edges, pairs, keys[:-1]), keys, distances, 2, [F.count(F.lit(1)).alias("pairs")])
    all_ = edges.select(*keys[:-1]).distinct().withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    return all_.join(found, keys, "left").withColumn("pairs", F.coalesce("pairs", F.lit(0)))


def unchanged(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Groups in which ``value`` is not the same for every seed; empty if all is well."""
    return rows.groupBy(*keys).agg(F.countDistinct(value).alias("values")).filter("values > 1")
