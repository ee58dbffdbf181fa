"""A ragged store that is read by offset, and tables that are checked as they are written."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pulseweave.functions import storage
from pulseweave.operators import checks
from pulseweave.plans import event_queries
from pulseweave.sources import tables


def scanned(df):
    """Rows that the scan gave to the plan, after row groups were skipped."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()


def test_one_record_by_offset(spark, tmp_path):
    path, width = str(tmp_path / "store"), 300
    sizes = {k: (k * 7) % 23 + (k == 5) * 3000 for k in range(200)}
    table = [(s, k, i) for s in ("a", "b") for k, n in sizes.items() for i in range(n if s == "a" else n // 2)]
    wave = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda j: F.sin(F.col("k") * 1.0 + F.col("i") * j))
    rows = spark.createDataFrame(table, "stage string, k int, i int").repartition(7).withColumn("wave", wave)
    tables.write_ragged(rows, path, ["stage"], "k", "i", F.floor(F.col("k") / 16), row_group_bytes=1 << 19)
    for stage, k in (("a", 9), ("b", 9), ("a", 5), ("a", 0), ("a", 999)):
        n = sizes.get(k, 0) // (1 if stage == "a" else 2)
        found = tables.read_record(spark, path, "k", k, stage=stage)
        got = found.collect()
        assert [(x.stage, x.k, x.i) for x in got] == [(stage, k, i) for i in range(n)]
        if n:
            plain = tables.read_ragged(spark, path)[0].filter((F.col("stage") == stage) & (F.col("row") >= got[0].row) & (F.col("row") <= got[-1].row))
            groups = [pq.ParquetFile(f).metadata for f in glob.glob(f"{path}/rows/stage={stage}/*.parquet")]
            sizes_of = [m.row_group(g).num_rows for m in groups for g in range(m.num_row_groups)]
            assert len(sizes_of) > 4 and n <= scanned(plain) <= n + 2 * max(sizes_of) < sum(sizes_of) + (k == 5) * 10**9
    offsets = {(x.stage, x.k): (x.first, x.end) for x in tables.read_ragged(spark, path)[1].collect()}
    at = 0
    for k in sorted(k for k, n in sizes.items() if n):
        assert offsets["a", k] == (at, at + sizes[k])
        at += sizes[k]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        tables.write_ragged(rows, path, ["stage"], "k", "i", F.lit(0))


def test_a_task_has_a_bounded_number_of_rows(spark, tmp_path):
    """The number of tasks grows with the table; it was that of shuffle partitions before, coalesced."""
    assert storage.tasks_for(spark, 10) == 4 and storage.tasks_for(spark, 10**8) * (1 << 17) >= 10**8
    made = spark.range(400).selectExpr("id AS event_id", "id % 40 AS user_id", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, id) AS ts", "'view' AS event_type", "id + 0.5D AS value")
    made.write.parquet(str(tmp_path / "events.parquet"))
    assert event_queries.timed(spark, str(tmp_path)).select(F.spark_partition_id()).distinct().count() > 2
    rows = made.selectExpr("user_id AS k", "cast(event_id div 40 AS int) AS i", "value")
    tables.write_ragged(rows, str(tmp_path / "store"), [], "k", "i", F.lit(0))
    assert len(glob.glob(f"{tmp_path}/store/rows/*.parquet")) == 4


@pytest.fixture
def rules(spark):
    return {"x below 0": F.col("x") < 0, "y missing": F.col("y").isNull()}


def test_a_table_without_faults_is_published(spark, tmp_path, rules):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    for stop in (False, True):
        path = str(tmp_path / f"good{stop}")
        assert checks.write_checked(df, path, rules, {"more than 5": F.greatest(F.count(F.lit(1)) - 5, F.lit(0))}, stop) == {"rows": 2, "x below 0": 0, "y missing": 0, "more than 5": 0}
        assert sorted(map(tuple, checks.read_checked(spark, path).collect())) == [(1, "a"), (2, "b")]
    checks.write_checked(df.limit(0), str(tmp_path / "empty"), rules)
    assert checks.read_checked(spark, str(tmp_path / "empty")).count() == 0


def test_a_planted_fault_is_named_and_not_published(spark, tmp_path, rules):
    df = spark.createDataFrame([(1, "a"), (-2, "b"), (None, "c"), (3, None)], "x int, y string")
    with pytest.raises(checks.FaultsFound, match="x below 0: 2, y missing: 1") as e:
        checks.write_checked(df, str(tmp_path / "bad"), rules)
    assert e.value.faults == {"x below 0": 2, "y missing": 1}
    with pytest.raises(checks.FaultsFound, match="not checked"):
        checks.read_checked(spark, str(tmp_path / "bad"))
    with pytest.raises(checks.FaultsFound) as e:
        checks.write_checked(df.filter("x IS NOT NULL AND y IS NOT NULL"), str(tmp_path / "stopped"), rules, stop=True)
    assert e.value.faults == {"x below 0": 1} and not (tmp_path / "stopped" / "data" / "_SUCCESS").exists()
    with pytest.raises(checks.FaultsFound, match="more than 3: 1"):
        checks.write_checked(df, str(tmp_path / "total"), {}, {"more than 3": F.greatest(F.count(F.lit(1)) - 3, F.lit(0))})


def test_checks_do_not_scan_again(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame([(k,) for k in range(10)], "x int").mapInArrow(run, "x int")
    checks.write_checked(df, str(tmp_path / "once"), {"below 0": F.col("x") < 0})
    assert seen.value == 10
