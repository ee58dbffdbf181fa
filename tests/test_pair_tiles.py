"""All pairs of long records in tiles, and statistics of neighbours with gaps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseweave.functions.scalar import md5_int
from pulseweave.operators import distances, events, shuffles


def gap(a, b):
    return np.abs(a - b).sum(1)


def test_every_pair_once(spark):
    sizes = {("a", 1): 700, ("a", 2): 32, ("b", None): 33, ("c", 1): 1}
    rows = [(k[0], k[1], i, [float(i), 1.0], [2.0 * i] if i % 5 else None) for k, n in sizes.items() for i in range(n)]
    beats = spark.createDataFrame(rows, "k string, n int, i int, v array<double>, w array<double>").filter("n IS NOT NULL")
    found = distances.pair_tiles(beats.repartition(7), ["k", "n"], "i", ["v", "w"], tile=16, kernel=gap, names=["v", "w"], most=100).collect()
    expected = {(k, n, i, j): (float(j - i), 2.0 * (j - i) if i % 5 and j % 5 else None) for (k, n), size in sizes.items() if n for i in range(size) for j in range(i + 1, size)}
    assert len(found) == len(expected) and {(x.k, x.n, x.i, x.j): (x.v, x.w) for x in found} == expected


def test_a_long_record_spreads(spark):
    beats = spark.range(2000).select(F.lit(1).alias("k"), F.col("id").alias("i"), F.array(F.col("id").cast("double")).alias("w"))
    pairs = distances.pair_tiles(beats, ["k"], "i", ["w"], kernel=gap, names=["d"])
    tasks = pairs.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("d")).collect()
    assert sum(t.n for t in tasks) == 1999 * 1000 and sum(t.d for t in tasks) == sum(k * (2000 - k) for k in range(2000))
    assert max(t.n for t in tasks) < 0.7 * 1999 * 1000  # two partitions in tests


def test_shapes_and_empty(spark):
    beats = spark.createDataFrame([(1, 0, [1.0]), (1, 1, [1.0, 2.0]), (1, 2, None), (1, 3, [3.0])], "k int, i int, w array<double>")
    found = {(x.i, x.j): x.d for x in distances.pair_tiles(beats, ["k"], "i", ["w"], kernel=gap, names=["d"]).collect()}
    assert found == {(0, 1): None, (0, 2): None, (0, 3): 2.0, (1, 2): None, (1, 3): None, (2, 3): None}
    assert distances.pair_tiles(beats.limit(0), ["k"], "i", ["w"]).collect() == []
    assert all(x[-1] is None for x in distances.pair_tiles(beats, ["k"], "i", ["w"]).collect())  # the elastic distance needs whole waves


def stats(x):
    x = np.asarray(x, float)
    if len(x) < 2:
        return [None] * 4
    return [x.mean(), x.std(ddof=1), np.median(np.abs(x - np.median(x))), np.percentile(x, 75) - np.percentile(x, 25)]


def test_neighbours_with_gaps(spark):
    r = np.random.default_rng(4)
    seeds, rows, expected = [0, 1, 2], [], {}
    for rec, valid in {1: [0, 1, 2, 4, 5, 9, 10, 11], 2: [0, 2, 4], 3: [3], 4: list(range(40))}.items():
        waves = r.normal(size=(len(valid), 2, 3))
        rows += [(rec, s, k, waves[k, 0].tolist(), waves[k, 1].tolist(), True) for k, s in enumerate(valid)]
        edge = np.diff(valid) == 1
        draws = {row.seed: row.d for row in spark.createDataFrame([(s,) for s in seeds], "seed int").select("seed", F.array(*[md5_int(F.col("seed"), F.lit(rec), F.lit(s)) for s in valid]).alias("d")).collect()}
        for seed in seeds:
            order = np.arange(len(valid)) if seed == 0 else np.lexsort((np.arange(len(valid)), draws[seed]))
            for w in (0, 1):
                d = [np.abs(waves[order[k], w] - waves[order[k + 1], w]).sum() for k in range(len(valid) - 1) if edge[k]]
                expected[rec, seed, w] = (int(edge.sum()), stats(d))
    table = spark.createDataFrame(rows, "rec int, source_index int, beat_index int, v array<double>, w array<double>, valid boolean")
    pairs = distances.pair_tiles(table, ["rec"], "beat_index", ["v", "w"], tile=4, kernel=gap, names=["v", "w"])
    found = shuffles.distance_stats(events.adjacent(table.drop("v", "w"), ["rec"]), pairs, ["rec"], seeds, "source_index", ["v", "w"]).collect()
    assert len(found) == 12
    for x in found:
        for k, w in enumerate(("v", "w")):
            n, own = expected[x.rec, x.seed, k]
            assert x.pairs == n
            got = [x[f"{w}_{s}"] for s in ("mean", "sd", "mad", "iqr")]
            assert got == own if own[0] is None else got == pytest.approx(own)


def test_an_index_may_begin_anywhere(spark):
    """Records of twelve beats in a table's numbering: as many rows are dealt as there are beats and blocks, whatever the numbers are."""
    beats = spark.range(10**9, 10**9 + 24).select(F.floor(F.col("id") / 12).alias("k"), F.col("id").alias("i"), F.array(F.col("id").cast("double")).alias("w"))
    beats = beats.unionByName(spark.createDataFrame([(-1, 5, [5.0]), (-1, 10**12, [7.0])], "k long, i long, w array<double>"))
    found = {(x.k, x.i, x.j): x.d for x in distances.pair_tiles(beats, ["k"], "i", ["w"], kernel=gap, names=["d"]).collect()}
    ids = [*range(10**9, 10**9 + 24)]
    expected = {(i // 12, i, j): float(j - i) for i in ids for j in ids if i < j and i // 12 == j // 12}
    assert found == expected | {(-1, 5, 10**12): 2.0}


def test_waves_are_stretched_in_the_tasks(spark):
    r = np.random.default_rng(9)
    rows = [(k, r.normal(size=64).cumsum().tolist(), r.normal(size=64).cumsum().tolist()) for k in range(5)] + [(5, None, [1.0] * 64), (6, [1.0, 2.0], [1.0] * 64), (7, [1.0], [2.0])]
    df = spark.createDataFrame(rows, "k int, a array<double>, b array<double>")
    whole = distances.with_distance(df.select("k", distances.stretched("a").alias("a"), distances.stretched("b").alias("b")).filter("k < 5"))
    found = {x.k: x.distance for x in distances.with_distance(df, kernel=distances.stretched_distance).collect()}
    assert {x.k: found[x.k] for x in whole.collect()} == {x.k: pytest.approx(x.distance, abs=1e-9) for x in whole.collect()}
    assert [found[k] for k in (5, 6, 7)] == [None] * 3
    assert distances.dealt(df.coalesce(1), "k").select(F.spark_partition_id()).distinct().count() == 2


def test_probe_grid_of_short_waves(spark):
    r = np.random.default_rng(10)
    wave = lambda: r.normal(size=64).cumsum().tolist()
    probes = spark.createDataFrame([(p, k, wave()) for p in range(4) for k in range(2) if (p, k) != (3, 1)], "p int, lead int, w array<double>")
    made = spark.createDataFrame([(k, c, wave() if c else None, "ok" if c else "insufficient_prototypes") for k in range(2) for c in range(2)], "lead int, label int, w array<double>, status string")
    long = lambda df: df.withColumn("w", F.when(F.col("w").isNotNull(), distances.stretched("w")))
    expected = {(x.p, x.lead, x.label): (x.status, x.distance) for x in distances.probe_grid(long(probes), long(made), "p", "lead", "label", "w", [0, 1], [0, 1]).collect()}
    grid = distances.probe_grid(probes.coalesce(1), made, "p", "lead", "label", "w", [0, 1], [0, 1], None, distances.stretched_distance, 64)
    found = {(x.p, x.lead, x.label): (x.status, x.distance) for x in grid.collect()}
    assert found == {key: (status, d if d is None else pytest.approx(d, abs=1e-9)) for key, (status, d) in expected.items()} and len(found) == 16
    assert found[3, 1, 1] == ("probe_beat_unavailable", None) and found[0, 0, 1][0] == "ok"
