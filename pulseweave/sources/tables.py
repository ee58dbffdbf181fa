"""Metadata and result tables, and how results are written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..functions.ranking import prefix_sums
from ..functions.storage import tasks_for, written

METADATA = "ecg_id bigint, patient_id double, age string, sex string, scp_codes string, strat_fold double, filename_hr string, device string, site string, baseline_drift string, static_noise string, burst_noise string, electrodes_problems string, extra_beats string, pacemaker string"


def read_metadata(spark: SparkSession, path: str, schema: str = METADATA) -> DataFrame:
    """The metadata CSV; columns are found by name, what the file lacks is null, other columns are not read."""
    head = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    wanted = spark.createDataFrame([], schema).schema
    return head.select(*[(F.col(f"`{f.name}`") if f.name in head.columns else F.lit(None)).try_cast(f.dataType).alias(f.name) for f in wanted])


def read_code_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """code (the first column, whatever its name) and diagnostic."""
    table = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return table.select(F.col(f"`{table.columns[0]}`").alias("code"), F.col("diagnostic").try_cast("double").alias("diagnostic"))


def read_results(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """An earlier result table; Spark drops a byte-order mark from the first header."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def versioned(df: DataFrame, version: int = 1) -> DataFrame:
    """schema_version first, and null for what is not finite."""
    fixed = [F.when(~F.isnan(f.name) & (F.abs(F.col(f.name)) != float("inf")), F.col(f.name)).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name) for f in df.schema if f.name != "schema_version"]
    return df.select(F.lit(version).alias("schema_version"), *fixed)


def write_results(df: DataFrame, path: str, form: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """Write once: an existing run is never overwritten."""
    writer = versioned(df).write.mode("errorifexists").partitionBy(*partition_by)
    (writer.option("header", True) if form == "csv" else writer).format(form).save(path)


def beat_offsets(counts: DataFrame, groups: Sequence[str], record: str, n: str, bucket: Column) -> DataFrame:
    """Where each record's beats begin in a ragged store of its group (or of all): running sums of the counts. ``bucket``, a range of records in their order, is summed in a task of its own."""
    return prefix_sums(counts, groups, bucket, [record], n, "first").withColumn("end", F.col("first") + F.col(n))


def write_ragged(rows: DataFrame, path: str, groups: Sequence[str], record: str, index: str, bucket: Column, row_group_bytes: int = 8 << 20) -> None:
    """A ragged store: the rows of all records one behind the other, per group by record and index, and where each record begins and ends.

    ``index`` numbers a record's rows from 0 without gaps. ``path/rows`` has the rows, sorted by their place ``row`` in the
    group, a folder per group; ``path/offsets`` has first and end (behind the last) of each record. As places are sorted in files, the
    statistics of a row group tell which places it has, and a reader of one record skips all others.
    """
    rows = written(rows, "ragged_rows")  # read twice
    tasks = tasks_for(rows.sparkSession, rows.count())
    counts = rows.groupBy(*groups, record).agg(F.count(F.lit(1)).alias("n"))
    offsets = written(beat_offsets(counts, groups, record, "n", bucket).select(*groups, record, "first", "end"), "offsets")
    placed = rows.repartition(tasks, *groups, record).join(offsets.drop("end"), [*groups, record]).withColumn("row", F.col("first") + F.col(index)).drop("first")
    sorted_ = placed.repartitionByRange(tasks, *groups, "row").sortWithinPartitions(*groups, "row")
    sorted_.write.mode("errorifexists").option("parquet.block.size", row_group_bytes).partitionBy(*groups).parquet(f"{path}/rows")
    offsets.write.mode("errorifexists").parquet(f"{path}/offsets")


def read_ragged(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, offsets) of a ragged store."""
    return spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/offsets")


def read_record(spark: SparkSession, path: str, record: str, value, **group) -> DataFrame:
    """One record's rows by its offsets, in order; only the row groups that hold its places are read. Empty if there is no such record."""
    rows, offsets = read_ragged(spark, path)
    own = F.lit(True)
    for k, v in group.items():
        own = own & (F.col(k) == F.lit(v))
    at = offsets.filter(own & (F.col(record) == F.lit(value))).first()  # one row
    first, end = (at["first"], at["end"]) if at else (0, 0)
    return rows.filter(own & (F.col("row") >= first) & (F.col("row") < end)).orderBy("row")
