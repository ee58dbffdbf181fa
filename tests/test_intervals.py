"""Intervals in bins against sets of integers."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pulseweave.operators import intervals, quality

ROWS = "k string, n int, a int, b int"


def table():
    r = random.Random(5)
    rows = [(r.choice(["hot", "hot", "x", None]), r.choice([1, 2]), s := r.randint(-50, 400), s + r.randint(-2, 30)) for _ in range(400)]
    return [*rows, ("x", 1, None, 5), ("x", 1, 5, None), ("x", 1, 3, 3), ("x", 1, 3, 3), ("wide", 1, -1000, 1000)]


def sets():
    inside = defaultdict(set)
    for k, n, a, b in table():
        if a is not None and b is not None:
            inside[k, n] |= set(range(a, b + 1))
    return inside


@pytest.mark.parametrize("width", [1, 7, 64, 5000])
def test_covered_and_inside(spark, width):
    rows = spark.createDataFrame(table(), ROWS).repartition(5)
    inside = sets()
    merged = intervals.merged(rows, ["k", "n"], "a", "b", width).collect()
    found = [x for m in merged for x in [(m.k, m.n, v) for v in range(m.start, m.end + 1)]]
    assert len(found) == len(set(found)) and set(found) == {(*key, v) for key, own in inside.items() for v in own}
    assert {(x.k, x.n): x.covered for x in intervals.covered(rows, ["k", "n"], "a", "b", width, 0, 99).collect()} == {key: len(own & set(range(100))) for key, own in inside.items() if own}
    points = [(k, n, v) for k in ("hot", "x", None, "none", "wide") for n in (1, 2) for v in (*range(-60, 440, 3), None)]
    got = intervals.with_inside(spark.createDataFrame(points, "k string, n int, at int"), rows, ["k", "n"], "at", "a", "b", width).collect()
    assert len(got) == len(points) and all(x.inside == (x.at in inside[x.k, x.n]) for x in got)


def test_without_intervals(spark):
    none, points = spark.createDataFrame([], ROWS), spark.createDataFrame([("x", 1, 5)], "k string, n int, at int")
    assert [x.inside for x in intervals.with_inside(points, none, ["k", "n"], "at", "a", "b", 8).collect()] == [False]
    assert intervals.with_inside(points.limit(0), none, ["k", "n"], "at", "a", "b", 8).collect() == [] == intervals.covered(none, ["k"], "a", "b", 8).collect()


def test_grid_with_peaks(spark):
    leads = spark.createDataFrame([(1, 0, [0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 2.0, 0.0]), (1, 1, [0.0] * 8), (2, 0, [0.0] * 8), (3, 0, [1.0])], "rec int, lead int, w array<double>")
    peaks = leads.filter("lead = 0").select("rec", F.explode(quality.tops("w", 0.5)).alias("p"))
    assert {(x.rec, x.p) for x in peaks.collect()} == {(1, 1), (1, 6)}
    peaks = peaks.unionByName(peaks).unionByName(spark.createDataFrame([(1, None)], "rec int, p int"))
    found = {(x.rec, x.lead): x.inside for x in quality.with_peaks(leads, peaks, ["rec"], "p", 1, "w").collect()}
    near = [1, 1, 1, 0, 0, 1, 1]  # steps 0 to 2 and 5 to 7
    assert found == {(1, 0): near, (1, 1): near, (2, 0): [0] * 7, (3, 0): []}
    grid = quality.threshold_grid(quality.with_peaks(leads, peaks, ["rec"], "p", 1, "w"), "w", (0.5,), 1.0, F.col("inside"))
    assert {(x.rec, x.lead): x.outside_share for x in grid.collect()}[1, 0] == 1.0
