"""Representatives, fold templates, prototypes and statistics of arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import let


def vector(c: str) -> Column:
    return array_to_vector(F.col(c).cast("array<double>"))


def mean_wave(rows: DataFrame, keys: Sequence[str], wave: str) -> DataFrame:
    """Elementwise mean of a group's arrays, and their number; partial sums are made before the exchange."""
    return rows.groupBy(*keys).agg(vector_to_array(Summarizer.mean(vector(wave))).alias(wave), F.count(F.lit(1)).alias("n"))


def grid(spark, **values: Sequence) -> DataFrame:
    """All combinations of a few given values."""
    out = None
    for name, several in values.items():
        one = spark.createDataFrame([(v,) for v in several], [name])
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out


def fold_templates(rows: DataFrame, keys: Sequence[str], fold: str, label: str, wave: str, folds: Sequence[int], labels: Sequence, minimum: int = 1) -> DataFrame:
    """For each group, fold and label: mean over the records of all *other* folds, their number and a status.

    Sums per fold are made once and the held-out fold's is taken from the total,
    so no record is copied to the folds it trains. A fold is ``insufficient``, and
    its templates null, unless every label has ``minimum`` records.
    """
    keys = list(keys)
    sums = rows.groupBy(*keys, label, fold).agg(vector_to_array(Summarizer.sum(vector(wave))).alias("_own"), F.count(F.lit(1)).alias("_own_n"))
    add = lambda a, b: F.when(F.size(a) == 0, b).otherwise(F.zip_with(a, b, lambda x, y: x + y))
    total = sums.groupBy(*keys, label).agg(F.aggregate(F.collect_list("_own"), F.array().cast("array<double>"), add).alias("_sum"), F.sum("_own_n").alias("_n"))  # at most a row per fold
    cells = grid(rows.sparkSession, **{fold: list(folds), label: list(labels)})
    cells = cells.withColumns({c: F.col(c).cast(rows.schema[c].dataType) for c in (fold, label)})
    if keys:
        cells = rows.select(*keys).distinct().crossJoin(F.broadcast(cells))
    found = cells.join(total, [*keys, label], "left").join(sums, [*keys, label, fold], "left").withColumn("n", F.coalesce("_n", F.lit(0)) - F.coalesce("_own_n", F.lit(0)))
    enough = F.min(F.col("n")).over(Window.partitionBy(*keys, fold)) >= minimum
    mean = F.when(F.col("_own").isNull(), F.transform("_sum", lambda x: x / F.col("n"))).otherwise(F.zip_with("_sum", "_own", lambda x, y: (x - y) / F.col("n")))
    return found.withColumn("_ok", enough).select(*keys, fold, label, "n", F.when(F.col("_ok"), "ok").otherwise("insufficient").alias("status"), F.when(F.col("_ok"), mean).alias(wave))


def contributors(rows: DataFrame, identity: str, fold: str, label: str, folds: Sequence[int]) -> DataFrame:
    """The records behind each fold's templates."""
    return rows.select(identity, label, F.col(fold).alias("own_fold"), F.explode(F.array(*[F.lit(f) for f in folds])).alias("template_fold")).filter("own_fold <> template_fold")


def prototypes(rows: DataFrame, label: str, wave: str, minimum: int = 20) -> DataFrame:
    """Mean per label and status; null below ``minimum``."""
    found = mean_wave(rows, [label], wave)
    return found.select(label, "n", F.when(F.col("n") >= minimum, "ok").otherwise("insufficient_prototypes").alias("status"), F.when(F.col("n") >= minimum, F.col(wave)).alias(wave))


def sample_spread(beats: DataFrame, keys: Sequence[str], wave: str, least: int = 3, tiny: float = 1e-8) -> DataFrame:
    """v_h: mean over samples of the sd between beats, by the mean over beats of the sd within a beat (both n - 1); null for fewer than ``least`` beats or a flat group."""
    keys = list(keys)
    own = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)
    sd = lambda x: let(own(x), lambda m: F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / (F.size(x) - 1)))
    within = let(F.col(wave).cast("array<double>"), sd)
    found = beats.groupBy(*keys).agg(vector_to_array(Summarizer.std(vector(wave))).alias("_sd"), F.avg(within).alias("_within"), F.count(F.lit(1)).alias("n"))
    between = F.aggregate(F.col("_sd"), F.lit(0.0), lambda a, x: a + x) / F.size("_sd")
    return found.select(*keys, "n", F.when((F.col("n") >= least) & (F.col("_within") > tiny), between / F.col("_within")).alias("vh"))


def prototype_eligible(vh: DataFrame, keys: Sequence[str], ok: Column, limit: float = 0.3) -> DataFrame:
    """Groups whose every lead lies under the limit."""
    return vh.groupBy(*keys).agg((F.bool_and(ok) & F.coalesce(F.max("vh") < limit, F.lit(False)) & (F.count("vh") == F.count(F.lit(1)))).alias("eligible"))


def threshold_counts(rows: DataFrame, value: str, label: str, thresholds: Sequence[float], pool: Column | None = None) -> DataFrame:
    """How many rows of each label lie under each threshold, and with ``pool`` (a condition) also how many of those in it; the thresholds are columns of one pass, not copies of the rows. A null or NaN value lies under none."""
    under = lambda t: F.coalesce((F.col(value) < t) & ~F.isnan(value), F.lit(False))
    inside = F.coalesce(pool, F.lit(False)) if pool is not None else F.lit(False)
    counts = rows.groupBy(label).agg(*[F.sum((under(t) & c).cast("int")).alias(f"{n}{i}") for i, t in enumerate(thresholds) for n, c in (("all", F.lit(True)), ("pool", inside))])
    cells = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"all{i}").alias("eligible"), F.col(f"pool{i}").alias("eligible_pool")) for i, t in enumerate(thresholds)]))
    out = counts.select(label, cells.alias("p")).select("p.threshold", label, "p.eligible", "p.eligible_pool")
    return out if pool is not None else out.drop("eligible_pool")


def strict_templates(rows: DataFrame, keys: Sequence[str], fold: str, label: str, wave: str, folds: Sequence[int], labels: Sequence, pool: Column, spread_ok: Column, minimum: int = 20) -> DataFrame:
    """Templates from the prototype pool only, and of it only from records whose spread is small enough; a fold needs ``minimum`` such training records of every label."""
    return fold_templates(rows.filter(F.coalesce(pool & spread_ok, F.lit(False))), keys, fold, label, wave, folds, labels, minimum)


def array_quantile(sorted_array: Column, q: float) -> Column:
    """Linear quantile of a sorted array."""
    at = (F.size(sorted_array) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    a, b = F.element_at(sorted_array, low + 1), F.element_at(sorted_array, F.least(low + 2, F.size(sorted_array)))
    return a + (b - a) * (at - low)


def morphology(rows: DataFrame, wave: str) -> DataFrame:
    """Mean, sd (n), minimum, maximum and quartiles of each row's array; no explode."""
    total = lambda x, f: F.aggregate(x, F.lit(0.0), lambda a, v: a + f(v))

    def measured(v: Column) -> Column:
        return let(
            total(v, lambda e: e) / F.size(v),
            lambda mean: F.struct(
                mean.alias("wave_mean"), F.sqrt(total(v, lambda e: (e - mean) * (e - mean)) / F.size(v)).alias("wave_sd"), F.element_at(v, 1).alias("wave_min"), F.element_at(v, -1).alias("wave_max"),
                array_quantile(v, 0.25).alias("wave_q25"), array_quantile(v, 0.75).alias("wave_q75"),
            ),
        )

    return rows.withColumn("_m", let(F.array_sort(F.col(wave).cast("array<double>")), measured)).select(*rows.columns, "_m.*")
