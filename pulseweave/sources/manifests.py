"""Content manifests and their drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, size, modified and sha256 of files, read where Spark can read them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def content_manifest(rows: DataFrame, key: str, content: str) -> DataFrame:
    """The same for a table's texts; null counts as empty."""
    text = F.coalesce(F.col(content).cast("string"), F.lit(""))
    return rows.select(F.col(key).alias("path"), F.octet_length(text).cast("long").alias("size"), F.sha2(text, 256).alias("sha256"))


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """What was added, removed, changed or, where both manifests have times, touched (the same content written again) between them; no rows if nothing was."""
    timed = "modified" in before.columns and "modified" in after.columns
    side = lambda m, name: m.select("path", F.struct("size", "sha256").alias(name), (F.col("modified") if timed else F.lit(None)).alias(f"{name}_at"), F.lit(True).alias(f"{name}_is"))
    both = side(before, "_a").join(side(after, "_b"), "path", "full_outer")
    what = F.when(F.col("_a_is").isNull(), "added").when(F.col("_b_is").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed").when(~F.col("_a_at").eqNullSafe(F.col("_b_at")), "touched")
    return both.withColumn("what", what).filter("what IS NOT NULL").select("path", "what")
