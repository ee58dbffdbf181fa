"""Robust statistics per group: mean, sd, MAD and IQR, null for groups with too few values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import percentiles
from ..functions.scalar import finite

STATS = ("mean", "sd", "mad", "iqr")


def iqr(c: str | Column) -> Column:
    return F.percentile(c, F.lit(0.75)) - F.percentile(c, F.lit(0.25))


def four_stats(df: DataFrame, keys: Sequence[str], values: Sequence[str], minimum: int = 3, extra: Sequence[Column] = ()) -> DataFrame:
    """A row per group with ``<value>_mean``, ``_sd`` (n - 1), ``_mad`` (raw) and ``_iqr`` (linear percentiles) of the finite values.

    The median that the MAD needs is a window over the same keys as the
    aggregation, so the rows are exchanged once.
    """
    keys = list(keys)
    group = Window.partitionBy(*keys)
    df = df.withColumns({v: finite(v) for v in values})
    df = df.withColumns({f"_off_{v}": F.abs(F.col(v) - F.percentile(v, F.lit(0.5)).over(group)) for v in values})
    out = []
    for v in values:
        found = (F.avg(v), F.stddev_samp(v), F.percentile(f"_off_{v}", F.lit(0.5)), iqr(v))
        out += [F.when(F.count(v) >= minimum, f).alias(f"{v}_{name}") for name, f in zip(STATS, found, strict=True)]
    return df.groupBy(*keys).agg(*extra, *out)


def descriptives(df: DataFrame, label: str, values: Sequence[str], labels: Sequence) -> DataFrame:
    """Count, mean, median and sd of each value by label: a row per metric, the labels side by side."""
    long = df.unpivot([label], list(values), "metric", "value").withColumn("value", finite("value"))
    each = long.groupBy("metric", label).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    each = each.join(percentiles(long, ["metric", label], "value", (0.5,)), ["metric", label], "left").withColumn("median", F.col("percentiles")[0])
    return each.groupBy("metric").pivot(label, list(labels)).agg(*[F.first(c).alias(c) for c in ("n", "mean", "median", "sd")])
