"""Rank metrics of scores, their spread over folds and seeds, and paired bootstrap intervals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import dense_index
from ..functions.scalar import md5_int
from ..functions.storage import written

#: Ranges of scores that are ranked in tasks of their own.
BUCKETS = 1024


def auroc(rows: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label", weight: str | None = None, threshold: float = 0.5) -> DataFrame:
    """A row per group with auroc (ties count half), positives, negatives and balanced_accuracy; null unless both classes are there.

    Rows are first summed per distinct score; running sums of negatives then go
    over ranges of scores (in [0, 1]) and inside each range, so a group of any
    size is shared by many tasks.
    """
    keys = list(keys)
    w = F.lit(1) if weight is None else F.col(weight)
    at = rows.filter(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("_s")).agg(F.sum(F.when(F.col(label) == 1, w).otherwise(0)).alias("_p"), F.sum(F.when(F.col(label) == 0, w).otherwise(0)).alias("_n"))
    return _by_score(at, keys, threshold)


def _by_score(at: DataFrame, keys: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """The metrics of ``auroc`` from a row per group and distinct score ``_s`` with its positives ``_p`` and negatives ``_n``."""
    at = at.withColumn("_b", F.least(F.greatest(F.floor(F.col("_s") * BUCKETS), F.lit(-1)), F.lit(BUCKETS)))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys, "_b").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hits = [F.sum(F.when(F.col("_s") >= threshold, F.col("_p")).otherwise(0)).alias("_hp"), F.sum(F.when(F.col("_s") < threshold, F.col("_n")).otherwise(0)).alias("_hn")]
    wins = at.withColumn("_w", F.col("_p") * (inside + F.col("_n") / 2)).groupBy(*keys, "_b").agg(F.sum("_w").alias("_w"), F.sum("_p").alias("_p"), F.sum("_n").alias("_n"), *hits)
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = wins.withColumn("_w", F.col("_w") + F.col("_p") * before)
    share = lambda hit, all_: F.sum(hit) / F.nullif(F.sum(all_), F.lit(0))
    return wins.groupBy(*keys).agg(F.sum("_p").alias("positives"), F.sum("_n").alias("negatives"), (F.sum("_w") / F.nullif(F.sum("_p") * F.sum("_n"), F.lit(0))).alias("auroc"), ((share("_hp", "_p") + share("_hn", "_n")) / 2).alias("balanced_accuracy"))


def balanced_accuracy(score: str = "score", label: str = "label", threshold: float = 0.5, weight: str | None = None) -> Column:
    """Mean of both classes' shares on their own side of the threshold; an aggregate."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    share = lambda c, hit: F.sum(F.when((F.col(label) == c) & F.col(score).isNotNull(), hit.cast("double") * w)) / F.sum(F.when((F.col(label) == c) & F.col(score).isNotNull(), w))
    return (share(1, F.col(score) >= threshold) + share(0, F.col(score) < threshold)) / 2


def oof_metrics(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group: expected and evaluated rows, missing, AUROC, balanced accuracy at 0.5 and coverage."""
    keys = list(keys)
    counts = predictions.groupBy(*keys).agg(F.count(F.lit(1)).alias("expected"), F.count("score").alias("evaluated"), balanced_accuracy().alias("balanced_accuracy"))
    out = counts.join(auroc(predictions, keys).select(*keys, "auroc"), keys, "left")
    return out.withColumns({"missing": F.col("expected") - F.col("evaluated"), "coverage": F.when(F.col("expected") == F.col("evaluated"), "complete").otherwise("partial_not_full_CV")})


def oof_metrics_levels(predictions: DataFrame, keys: Sequence[str], fold: str) -> DataFrame:
    """``oof_metrics`` per group and fold, and pooled over folds (``fold`` null, level ``pooled``), from one scan.

    Rows are counted per group, fold and score once; grouping sets add these counts up
    to both levels, and both metrics come from running sums per set.
    """
    keys = list(keys)
    counts = {"_p": F.col("label") == 1, "_n": F.col("label") == 0, "_rows": F.lit(True)}
    parts = predictions.groupBy(*keys, fold, F.col("score").alias("_s")).agg(*[F.sum(c.cast("long")).alias(n) for n, c in counts.items()])
    level = F.when(F.grouping(fold) == 1, "pooled").otherwise("fold")
    sets = parts.groupingSets([[*keys, fold, "_s"], [*keys, "_s"]], *keys, fold, "_s").agg(level.alias("level"), *[F.sum(F.coalesce(n, F.lit(0))).alias(n) for n in counts])
    by_level = [*keys, "level", fold]
    scored = F.col("_s").isNotNull()
    totals = sets.groupBy(*by_level).agg(F.sum("_rows").alias("expected"), F.sum(F.when(scored, F.col("_rows")).otherwise(0)).alias("evaluated"))
    ranks = _by_score(sets.filter(scored), by_level).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by_level)], "auroc", "balanced_accuracy")
    same = F.lit(True)
    for i, k in enumerate(by_level):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = totals.join(ranks, same, "left").select(*totals.columns, "auroc", "balanced_accuracy")
    return out.withColumns({"missing": F.col("expected") - F.col("evaluated"), "coverage": F.when(F.col("expected") == F.col("evaluated"), "complete").otherwise("partial_not_full_CV")})


def spread(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median and quartile range of a value per group."""
    q = lambda p: F.percentile(value, F.lit(p))
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), q(0.5).alias("median"), (q(0.75) - q(0.25)).alias("iqr"))


def shuffle_summary(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spread of model C over the seeds other than 0."""
    rows = metrics.filter((F.col("model") == "C") & (F.col("seed") != 0))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("seeds"), F.avg("auroc").alias("auroc_mean"), F.stddev_samp("auroc").alias("auroc_sd"), F.min("auroc").alias("auroc_min"), F.max("auroc").alias("auroc_max"), F.avg("balanced_accuracy").alias("ba_mean"),
        F.stddev_samp("balanced_accuracy").alias("ba_sd"), F.min("evaluated").alias("evaluated_min"),
    )


def wide(predictions: DataFrame, keys: Sequence[str], models: Sequence[str] = ("A", "B", "C")) -> DataFrame:
    """A row per record with a column of scores per model."""
    return predictions.groupBy(*keys).pivot("model", list(models)).agg(F.first("score", ignorenulls=True))


def draws_of(seed: int, replicate: int, label: int, size: int, first: int = 0, behind: int | None = None) -> np.ndarray:
    """Row numbers drawn by the draws first .. behind - 1 of a class in a replicate: 32 bits of md5(seed|replicate|class|k), modulo the class size."""
    start = hashlib.md5(f"{seed}|{replicate}|{label}|".encode())
    out = []
    for k in range(first, size if behind is None else behind):
        h = start.copy()
        h.update(b"%d" % k)
        out.append(h.digest()[:4])
    return (np.frombuffer(b"".join(out), ">u4").astype(np.int64) % size) if out else np.zeros(0, np.int64)


def weighted_metrics(scores: np.ndarray, place: np.ndarray, labels: np.ndarray, weights: np.ndarray, threshold: float = 0.5) -> tuple[float, float]:
    """AUROC (ties count half) and balanced accuracy of rows taken ``weights`` times; ``scores`` are the distinct ones, ascending, and ``place`` is each row's among them. NaN without both classes."""
    pos = np.bincount(place, np.where(labels == 1, weights, 0), len(scores))
    neg = np.bincount(place, np.where(labels == 0, weights, 0), len(scores))
    p, n = pos.sum(), neg.sum()
    if not p or not n:
        return np.nan, np.nan
    wins = (pos * (np.cumsum(neg) - neg + neg / 2)).sum()
    high = scores >= threshold
    return wins / (p * n), (pos[high].sum() / p + neg[~high].sum() / n) / 2


#: Up to so many rows (about 32 bytes each) a bootstrap's table is sent to its tasks.
MOST_SENT = 1_000_000


def paired_bootstrap(rows: DataFrame, first: str, second: str, identity: str, label: str = "label", replicates: int = 1000, seed: int = 5001, hash_buckets: int = 256, most_sent: int = MOST_SENT) -> DataFrame:
    """delta_auroc and delta_ba of ``second`` - ``first`` over all rows, with 2.5 and 97.5 percentiles over class-stratified resamples.

    Draw k of a class in a replicate is md5(seed|replicate|class|k) modulo the
    class size, the same for every comparison. The rows are counted: up to
    ``most_sent`` they go to all tasks once, and a task makes the draws of its replicates, counts how often each
    row was drawn and takes both metrics from these counts, so what is exchanged is a row per
    replicate. Larger tables are cut by draws instead: tasks count the draws of a block, and counts meet the rows by
    their number, after which both metrics come from sums per score. Both ways give the same numbers.
    """
    paired = rows.filter(F.col(first).isNotNull() & F.col(second).isNotNull()).select(F.col(identity).alias("id"), F.col(label).cast("int").alias("label"), F.col(first).cast("double").alias("first"), F.col(second).cast("double").alias("second"))
    paired = written(dense_index(paired, ["label"], md5_int(F.col("id")) % hash_buckets, ["id"], "k").select("label", "k", "first", "second"), "bootstrap")
    sizes = {r["label"]: r["n"] for r in paired.filter(F.col("label").isin(0, 1)).groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    paired = paired.filter(F.col("label").isin(0, 1))
    deltas = (_sent_deltas if sum(sizes.values()) <= most_sent else _dealt_deltas)(paired, sizes, replicates, seed)
    real, drawn_ones = F.col("replicate") == -1, F.col("replicate") >= 0
    return deltas.agg(
        *[
            c
            for m in ("auroc", "ba")
            for c in (F.max(F.when(real, F.col(m))).alias(f"delta_{m}"), F.percentile(F.when(drawn_ones, F.col(m)), F.lit(0.025)).alias(f"{m}_low"), F.percentile(F.when(drawn_ones, F.col(m)), F.lit(0.975)).alias(f"{m}_high"))
        ],
        F.sum(drawn_ones.cast("int")).alias("replicates"),
    )


def _sent_deltas(paired: DataFrame, sizes: dict[int, int], replicates: int, seed: int) -> DataFrame:
    """replicate (-1: all rows once), auroc and ba: a task per block of replicates."""
    spark = paired.sparkSession
    table = paired.orderBy("label", "k").toArrow()  # at most MOST_SENT rows
    labels = table["label"].to_numpy()
    ranked = [np.unique(table[c].to_numpy(), return_inverse=True) for c in ("first", "second")]
    starts = {c: int(np.searchsorted(labels, c)) for c in sizes}
    shared = spark.sparkContext.broadcast((labels, ranked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, ranked = shared.value
        for batch in batches:
            out = []
            for replicate in batch.column(0).to_pylist():
                weights = np.ones(len(labels), np.int64) if replicate < 0 else np.zeros(len(labels), np.int64)
                for c, n in sizes.items() if replicate >= 0 else ():
                    weights[starts[c] : starts[c] + n] = np.bincount(draws_of(seed, replicate, c, n), minlength=n)
                (a1, b1), (a2, b2) = (weighted_metrics(s, at, labels, weights) for s, at in ranked)
                out.append((replicate, a2 - a1, b2 - b1))
            ids, auroc, ba = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(auroc, pa.float64(), from_pandas=True), pa.array(ba, pa.float64(), from_pandas=True)], ["replicate", "auroc", "ba"])

    return spark.range(-1, replicates, numPartitions=min(replicates + 1, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(run, "replicate long, auroc double, ba double")


def _dealt_deltas(paired: DataFrame, sizes: dict[int, int], replicates: int, seed: int, block: int = 100_000) -> DataFrame:
    """The same for tables of any size: rows of (replicate, label, block of draws), each counted in its task before counts are exchanged."""
    spark = paired.sparkSession
    blocks = spark.createDataFrame([(int(c), int(n)) for c, n in sizes.items()], "label int, size long")
    blocks = blocks.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block).cast("long")))).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, size, start, replicate in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                k, times = np.unique(draws_of(seed, replicate, label, size, start, min(start + block, size)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), label, np.int32)), pa.array(k), pa.array(np.full(len(k), replicate, np.int32)), pa.array(times)], ["label", "k", "replicate", "times"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    drawn = blocks.select("label", "size", "from", "replicate").repartition(parts, "replicate", "label", "from").mapInArrow(run, "label int, k long, replicate int, times long")
    sampled = drawn.join(paired, ["label", "k"]).select("replicate", "label", "first", "second", "times").unionByName(paired.select(F.lit(-1).alias("replicate"), "label", "first", "second", F.lit(1).cast("long").alias("times")))
    found = auroc(sampled.unpivot(["replicate", "label", "times"], ["first", "second"], "which", "score"), ["replicate", "which"], weight="times").withColumnRenamed("balanced_accuracy", "ba")
    sign = F.when(F.col("which") == "second", 1.0).otherwise(-1.0)
    return found.groupBy(F.col("replicate").cast("long").alias("replicate")).agg(F.sum(sign * F.col("auroc")).alias("auroc"), F.sum(sign * F.col("ba")).alias("ba"))
