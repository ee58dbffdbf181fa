"""Repair of unbounded records against a fold over each whole record."""

import random

import pytest
from pyspark.sql import functions as F

from pulseweave.operators import events

ROWS = "rec string, at double, n int, amp double, slope double, piece string"


def plain(rows, low=0.2, high=0.4, rate=500.0):
    out, last = [], {}
    for r in sorted(rows, key=lambda r: (r[0] or "", r[1] is None, r[1] or 0, r[2])):
        rec, at, n, amp, slope = r[:5]
        b = last.get(rec)
        weak = b is not None and None not in (at, amp, slope, *b) and low <= (at - b[0]) / rate <= high and amp < 0.45 * b[1] and slope < 0.5 * b[2]
        if not weak:
            last[rec] = (at, amp, slope)
            out.append((rec, n))
    return sorted(out, key=str)


def table(seed):
    r, rows, n = random.Random(seed), [], 0
    for rec, size in (("hot", 3000), ("b", 50), (None, 40), ("one", 1)):
        at = 0.0
        for _ in range(size):
            at += r.choice([0, 40, 100, 120, 150, 190, 200, 201, 260, 900]) if seed % 2 else r.choice([100, 130, 160, 190])  # even: no gap over 0.4 s at all
            n += 1
            rows.append((rec, at, n, None if r.random() < 0.02 else r.choice([1.0, 0.44, 0.3, 0.1]), r.choice([1.0, 0.49, 0.2, 0.05]), "x"))
    return [*rows, ("b", None, n + 1, 0.1, 0.1, "x"), ("late", None, n + 2, 1.0, 1.0, "x")]


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("buckets", [1, 3, 64])
def test_equals_the_fold(spark, seed, buckets):
    rows = table(seed)
    df = spark.createDataFrame(rows, ROWS).repartition(6)
    kept = events.repair(df, ["rec"], [F.col("at").asc_nulls_last(), "n"], "at", "amp", "slope", buckets=buckets)
    assert kept.columns == df.columns
    expected = plain(rows)
    assert sorted(((x.rec, x.n) for x in kept.collect()), key=str) == expected and len(expected) < len(rows)


def test_a_hot_record_is_in_many_pieces(spark):
    df = spark.createDataFrame(table(1), ROWS)
    sizes = events.pieces(df.drop("piece"), ["rec"], ["at", "n"], "at", 200.0, 800.0).filter("rec = 'hot'").groupBy("piece").count().collect()
    assert sum(x["count"] for x in sizes) == 3000 and max(x["count"] for x in sizes) < 100


def test_given_candidates(spark):
    """Equal ones stay, also fast ones; a low and broad one shortly after a high one goes."""
    rows = [("equal", 200.0 + 140 * k, k, 2.0, 2.0, "") for k in range(4)] + [("t", 200.0, 0, 4.0, 1.2, ""), ("t", 345.0, 1, 0.7, 0.05, ""), ("t", 700.0, 2, 4.0, 1.2, "")]
    kept = events.repair(spark.createDataFrame(rows, ROWS), ["rec"], ["at"], "at", "amp", "slope").collect()
    assert {(x.rec, x.at) for x in kept} == {(r[0], r[1]) for r in rows} - {("t", 345.0)}


def test_empty(spark):
    assert events.repair(spark.createDataFrame([], ROWS), ["rec"], ["at"], "at", "amp", "slope").collect() == []
