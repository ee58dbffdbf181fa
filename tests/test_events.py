import pytest
from pyspark.sql import functions as F

from pulseweave.functions.scalar import finite, let, md5_int
from pulseweave.operators import checks, events, shuffles
from pulseweave.operators.statistics import four_stats

KEYS = ["rec"]


def valid_beats(spark, source, values=None):
    values = values or [float(i) for i in range(len(source))]
    return spark.createDataFrame([("r", i, s, v) for i, (s, v) in enumerate(zip(source, values, strict=True))], "rec string, beat_index int, source_index int, value double").withColumn("valid", F.lit(True))


def test_gaps_are_skipped(spark):
    rows = events.adjacent(valid_beats(spark, [0, 1, 3, 4], [0.1, 0.2, 0.9, 0.4]), KEYS)
    assert events.steps(rows, KEYS, "beat_index", ["value"]).agg(F.avg("value")).first()[0] == pytest.approx(0.3)


def test_edges_before_and_after_a_shuffle(spark):
    rows = events.adjacent(valid_beats(spark, [11, 12, 14, 15]), KEYS)
    assert rows.filter("edge").count() == 2 and rows.filter("edge IS NOT NULL").count() == 3
    found = shuffles.adjacent_stats(rows, KEYS, ["value"], [0, 1, 2, 3], "source_index").collect()
    assert len(found) == 4 and {x.pairs for x in found} == {2}
    assert events.gaps(valid_beats(spark, [11, 12, 14, 15]), KEYS).first()[1:] == (12, 14, 1)


def test_too_few_values_have_no_statistics(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", float("nan")), ("b", float("inf")), ("c", 1.0), ("c", 2.0), ("c", 6.0), ("c", None)], "rec string, v double")
    found = {x.rec: x for x in four_stats(rows, KEYS, ["v"], 3).collect()}
    assert found["a"].v_mean is None and found["b"].v_iqr is None
    assert (found["c"].v_mean, found["c"].v_mad, found["c"].v_iqr) == (3.0, 1.0, 2.5)


def keep(spark, peaks):
    rows = spark.createDataFrame([("r", p, a, s) for p, a, s in peaks] + [("s", p + 10, a, s) for p, a, s in peaks], "rec string, at long, amp double, slope double").repartition(2, "at")
    found = sorted((x.rec, x.at) for x in events.repair(rows, KEYS, ["at"], "at", "amp", "slope").collect())
    assert [at + 10 for rec, at in found if rec == "r"] == [at for rec, at in found if rec == "s"]
    return [at for rec, at in found if rec == "r"]


def test_repair(spark):
    assert keep(spark, [(p, 1.0, 1.0) for p in (200, 340, 700, 1100)]) == [200, 340, 700, 1100]
    assert keep(spark, [(200, 4.0, 1.0), (345, 0.7, 0.05), (700, 4.0, 1.0)]) == [200, 700]
    # the second weak one is held against the last kept one, not against the dropped one
    assert keep(spark, [(200, 4.0, 1.0), (300, 1.0, 0.1), (390, 0.3, 0.02)]) == [200]
    assert keep(spark, []) == []


def test_validity_reasons(spark):
    at = [0, 400, 800, 1200, 1250, 1650, 2050, 2450]
    rows = spark.createDataFrame([("r", i, a, 30.0 if a == 2050 else 1.0) for i, a in enumerate(at)] + [("s", 0, 0, 1.0), ("s", 1, 400, 1.0)], "rec string, n int, pos long, v double")
    timed = events.intervals(rows, KEYS, ["pos"], "pos", 0.5)
    gates = events.record_gate(timed, KEYS, 300, 2000)
    assert {x.rec: x.gate for x in gates.collect()} == {"r": "", "s": "insufficient_peaks"}
    found = {(x.rec, x.pos): (x.failure_reason, x.beat_index) for x in events.validity(timed, KEYS, 300, 2000, F.col("v") > 20, 2).collect()}
    assert [found["r", p] for p in at] == [(events.EDGE, -1), ("", 0), ("", 1), (events.NEIGHBOUR, -1), (events.NEIGHBOUR, -1), ("", 2), (events.ARTIFACT, -1), (events.EDGE, -1)]
    assert found["s", 400] == (events.EDGE, -1)
    few = events.validity(timed, KEYS, 300, 2000, F.col("v") > 20, 9).filter("valid")
    assert few.count() == 0


def test_runs_and_plateaus(spark):
    rows = spark.createDataFrame([("r", i, v) for i, v in enumerate([1, 1, 1, 5, 9, 9, 1, 9, 9, 9])] + [("q", 0, 3)], "rec string, i int, v int")
    assert sorted(x.length for x in events.runs(rows, KEYS, ["i"], F.col("v") == 9).collect()) == [2, 3]
    assert {x.rec: x.longest for x in events.longest_run(rows, KEYS, ["i"], F.col("v") == 9).collect()} == {"r": 3, "q": 0}
    assert {x.rec: x.share for x in events.plateau_share(rows, KEYS, ["i"], "v", 3).collect()} == {"r": 0.6, "q": 0.0}


def test_checks(spark):
    a = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0]), (3, [1.0])], "k int, w array<double>")
    b = spark.createDataFrame([(1, [1.0, 2.0 + 1e-13]), (2, [3.1]), (4, [1.0])], "k int, w array<double>")
    assert {x.k: x.what for x in checks.compared(a, b, ["k"], "w").collect()} == {1: "", 2: "differs", 3: "only_first", 4: "only_second"}
    assert checks.same_rows(a, a).isEmpty() and checks.same_rows(a, b).count() == 6
    assert checks.not_once(a, ["k"]).isEmpty() and checks.outside(a, "k", [1, 2]).count() == 1
    assert checks.overlap(a, b, ["k"]).count() == 2 and checks.not_in(a, b, ["k"]).first().k == 3


def test_scalars(spark):
    row = spark.createDataFrame([(float("nan"), " x ", True, None)], "v double, s string, b boolean, n string")
    got = row.select(finite("v").alias("v"), md5_int(F.lit("a"), 1).alias("m"), let(F.lit(2), lambda x: x * x).alias("l")).first()
    assert got.v is None and got.l == 4 and got.m == int(__import__("hashlib").md5(b"a|1").hexdigest()[:8], 16)
