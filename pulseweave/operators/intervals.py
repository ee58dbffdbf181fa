"""Joins of points with intervals, and lengths that intervals cover, by bins.

The number line is cut into bins of a fixed width; an interval is a row in each
bin that it meets. Merging, counting and joining then go by (entity, bin), so an
entity with any number of points and intervals spreads over many tasks, and
each point meets the intervals of its own bin only.

Ends are both inside (start <= x <= end). Defined cases: intervals whose end is before their start and those with a
null end are none; points that are null lie in no interval; repeated and nested intervals count once;
null keys are keys; no intervals leave every point outside.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def binned(intervals: DataFrame, keys: Sequence[str], start: str, end: str, width: int) -> DataFrame:
    """A row per interval and bin that it meets, clipped to the bin: keys, bin, start, end (long)."""
    rows = intervals.select(*keys, F.col(start).cast("long").alias("start"), F.col(end).cast("long").alias("end")).filter(F.col("start") <= F.col("end"))
    rows = rows.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    return rows.select(*keys, "bin", F.greatest("start", F.col("bin") * width).alias("start"), F.least("end", F.col("bin") * width + (width - 1)).alias("end"))


def merged(intervals: DataFrame, keys: Sequence[str], start: str, end: str, width: int) -> DataFrame:
    """The integers that any interval covers as disjoint intervals, cut at the edges of bins: keys, bin, start, end."""
    keys = [*keys, "bin"]
    rows = binned(intervals, keys[:-1], start, end, width).distinct()
    before = F.max("end").over(Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.coalesce(F.col("start") > before + 1, F.lit(True)).cast("int"))
    rows = rows.withColumn("_island", F.sum("_new").over(Window.partitionBy(*keys).orderBy("start", "end")))
    return rows.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def covered(intervals: DataFrame, keys: Sequence[str], start: str, end: str, width: int, low: int | None = None, high: int | None = None) -> DataFrame:
    """How many integers (within low to high) each entity's intervals cover, overlaps counted once."""
    rows = merged(intervals, keys, start, end, width)
    first = F.col("start") if low is None else F.greatest("start", F.lit(low))
    last = F.col("end") if high is None else F.least("end", F.lit(high))
    return rows.groupBy(*keys).agg(F.sum(F.greatest(last - first + 1, F.lit(0))).alias("covered"))


def with_inside(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, start: str, end: str, width: int, name: str = "inside") -> DataFrame:
    """``points`` with whether each lies in any interval of its entity. Intervals are merged before, so no point is met twice."""
    keys = list(keys)
    ranges = merged(intervals, keys, start, end, width).groupBy(*keys, "bin").agg(F.collect_list(F.struct("start", "end")).alias("_ranges"))  # disjoint: at most width / 2 in a bin
    rows = points.withColumn("bin_", F.floor(F.col(at) / width))
    ranges = ranges.withColumnRenamed("bin", "_bin").withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = F.col("bin_") == F.col("_bin")
    for k in keys:
        on = on & rows[k].eqNullSafe(ranges[f"_k_{k}"])
    hit = F.exists("_ranges", lambda x: (x["start"] <= F.col(at)) & (F.col(at) <= x["end"]))
    return rows.join(ranges, on, "left").withColumn(name, F.coalesce(hit, F.lit(False))).select(*points.columns, name)
