"""What several operators of this package share: tables in the cluster's shared folder and joins that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: No more than about twice this many keys can hold over a 1/HOT_SHARE part of all rows each.
HOT_SHARE = 1024
#: Rows of a table that may be broadcast after it was counted.
BROADCAST_ROWS = 50_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    named = tempfile.mkdtemp(prefix="pulseweave-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there, and a lost executor costs nothing behind it.

    The files lie in ``<spark.checkpoint.dir>/pulseweave/<application>`` and may be deleted once the results that read them are stored.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/pulseweave/{spark.conf.get('spark.app.id', 'app')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """A column name for each of ``names`` that no column of ``docs`` has."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(column: str | Column = "text") -> Column:
    """The text, null as the empty one."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def join_by_size(rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one row per key, where ``size`` counts the rows of a key and ``total`` all rows.

    Keys with over 1/HOT_SHARE of all rows are at most about 2 * HOT_SHARE by
    count, so they are broadcast and their rows stay where they are; all other
    keys are small enough for a shuffle.
    """
    keys, limit = list(keys), max(total // HOT_SHARE, 1)
    hot = F.broadcast(groups.filter(F.col(size) > limit))
    rest = rows.join(F.broadcast(groups.filter(F.col(size) > limit).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(groups.filter(F.col(size) <= limit), keys))


def ranked(df: DataFrame, order: Sequence[str], name: str = "place") -> DataFrame:
    """``df``, written, with the place (from 0) of each row by ``order``: ranges of it are ranked in tasks of their own, and only their sizes are summed up."""
    (part,) = fresh(df, "_part")
    rows = materialise(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias("rows"))
    bases = sizes.select(part, F.coalesce(F.sum("rows").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(name))
    inside = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    return rows.withColumn("_inside", inside).join(F.broadcast(bases), part).withColumn(name, F.col(name) + F.col("_inside")).drop(part, "_inside")


def join_small(rows: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner", slices: int = 64, most: int | None = None) -> DataFrame:
    """Join with a table of one row per key that is usually small: it is counted (unless ``most`` says how many rows it has at most), broadcast up to BROADCAST_ROWS, and beyond that joined on salted keys, so that a hot key is dealt over ``slices`` tasks."""
    keys = list(keys)
    if (small.count() if most is None else most) <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), keys, how)
    others = [c for c in rows.columns if c not in keys] or keys
    (slice_,) = fresh(rows, "_slice")
    salted = rows.withColumn(slice_, F.pmod(F.xxhash64(*others), F.lit(slices)))
    copies = small.withColumn(slice_, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    return salted.join(copies.hint("merge"), [*keys, slice_], how).drop(slice_)
