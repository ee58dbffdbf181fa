"""Dense positions within few large groups, without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written


def dense_index(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str | Column], name: str = "index") -> DataFrame:
    """``df`` with the place (from 0) of each row in its group, by (bucket, order).

    Buckets (a few hundred values, chosen by the caller as a hash or a range of the order)
    are ranked in tasks of their own; their sizes are summed up before.
    """
    keys = list(keys)
    df = df.withColumn("_bucket", bucket)
    sizes = df.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*keys, "_bucket", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)) - 1
    return df.withColumn("_inside", inside).join(sizes, [*keys, "_bucket"]).withColumn(name, F.col("_inside") + F.col("_before")).drop("_bucket", "_inside", "_before")


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int, slices: int = 64) -> DataFrame:
    """The first ``n`` rows of each group: first of each slice, then of what is left, so that a group of any size is ranked by several tasks."""
    keys = list(keys)
    salted = df.withColumn("_slice", F.pmod(F.xxhash64(*df.columns), F.lit(slices)))
    some = salted.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*order))).filter(F.col("_r") <= n)
    return some.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= n).drop("_slice", "_r")


def prefix_sums(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str | Column], value: str, name: str = "before") -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of its group that come before, by (bucket, order); buckets as in ``dense_index``."""
    keys = list(keys)
    df = df.withColumn("_bucket", bucket)
    sums = df.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*keys, "_bucket", before.alias("_before"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("_inside", inside).join(sums, [*keys, "_bucket"]).withColumn(name, F.col("_inside") + F.col("_before")).drop("_bucket", "_inside", "_before")


def percentiles(df: DataFrame, keys: Sequence[str], value: str, points: Sequence[float], name: str = "percentiles", splits: int = 64) -> DataFrame:
    """A row per group with the exact percentiles (linear between ranks) of the values that are not null, as an array; for few groups of any size.

    Approximate quantiles, a sketch of fixed size, cut each group into ranges; ranges are
    counted, and only those that hold a wanted rank are looked at again, by distinct value.
    A null key is no group.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    cuts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", [k / splits for k in range(1, splits)], 20 * splits).alias("_cuts"))
    # written, so that Spark knows its size and broadcasts it if that is small
    cuts = written(cuts, "cuts")
    cut = rows.join(cuts, keys).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))))
    sizes = cut.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_size"), F.first("_n").alias("_n"))
    upto = F.sum("_size").over(Window.partitionBy(*keys).orderBy("_range"))
    places = F.array(*[F.struct(F.lit(k).alias("k"), (F.lit(float(p)) * (F.col("_n") - 1)).alias("at")) for k, p in enumerate(points)])
    wanted = sizes.withColumn("_upto", upto).select(*keys, "_range", (F.col("_upto") - F.col("_size")).alias("_before"), "_upto", F.explode(places).alias("_p"))
    wanted = wanted.select(*keys, "_range", "_before", "_upto", F.col("_p.k").alias("_k"), F.col("_p.at").alias("_at"), F.explode(F.array_distinct(F.array(F.floor("_p.at"), F.ceil("_p.at")))).alias("_rank"))
    wanted = wanted.filter((F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_upto"))).select(*keys, "_range", "_k", "_at", "_rank", (F.col("_rank") - F.col("_before")).alias("_inside"))
    wanted = written(wanted, "ranks")
    few = cut.join(wanted.select(*keys, "_range"), [*keys, "_range"], "left_semi").groupBy(*keys, "_range", "_v").agg(F.count(F.lit(1)).alias("_c"))
    few = few.withColumn("_to", F.sum("_c").over(Window.partitionBy(*keys, "_range").orderBy("_v")))
    found = few.join(wanted, [*keys, "_range"]).filter((F.col("_to") - F.col("_c") <= F.col("_inside")) & (F.col("_inside") < F.col("_to")))
    low, high = F.min_by("_v", "_rank"), F.max_by("_v", "_rank")
    each = found.groupBy(*keys, "_k").agg((low + (high - low) * (F.first("_at") - F.floor(F.first("_at")))).alias("_x"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_x"))), lambda e: e["_x"]).alias(name))
