"""Digests of tables against sorted rows, and a leak that must be found."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseweave.operators import checks
from pulseweave.plans import wave_queries


def test_digests_are_of_multisets(spark):
    rows = [("a", 1, 0.1 + 0.2, [1.0, None]), ("a", 1, 0.1 + 0.2, [1.0, None]), ("a", 2, None, []), ("b", 1, float("nan"), None), (None, None, -0.0, [float("nan")])]
    schema = "k string, i int, x double, w array<double>"
    df = spark.createDataFrame(rows, schema)
    moved = spark.createDataFrame([("a", 1, 0.3, [1.0, None]) if r[:2] == ("a", 1) else r for r in reversed(rows)], schema).repartition(4)
    same = lambda a, b: {x.k: x.unchanged for x in checks.unchanged_groups(a, b, ["k"], ["i", "x", "w"]).collect()}
    assert same(df, moved) == {"a": True, "b": True, None: True}
    for changed in ([rows[0], *rows[2:]], [*rows, rows[0]], [rows[0], ("a", 1, 0.3, [None, 1.0]), *rows[2:]], [*rows[:2], ("a", 2, None, None), *rows[3:]], [*rows[:2], ("a", None, 2.0, []), *rows[3:]]):
        assert same(df, spark.createDataFrame(changed, schema)) == {"a": False, "b": True, None: True}
    assert same(df, df.filter("k = 'a'")) == {"a": True, "b": False, None: False}
    assert same(df.limit(0), df.limit(0)) == {}


def test_random_tables(spark):
    r = np.random.default_rng(0)
    a = [(int(g), int(v)) for g, v in r.integers(0, 6, (300, 2))]
    b = [(g, v + (g == 3 and k % 7 == 0)) for k, (g, v) in enumerate(a)]
    found = {x.g: x.unchanged for x in checks.unchanged_groups(spark.createDataFrame(a, "g int, v int"), spark.createDataFrame(b, "g int, v int").repartition(3), ["g"], ["v"]).collect()}
    assert found == {g: Counter(v for h, v in a if h == g) == Counter(v for h, v in b if h == g) for g in range(6)} and not found[3]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("study")
    r = np.random.default_rng(6)
    vectors = [(i, (r.normal(size=64) + (i % 2) * np.sin(np.arange(64) / 9)).cumsum().tolist(), i % 10) for i in range(64)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(str(path / "embeddings.parquet"))
    return str(path)


def test_a_study_without_a_leak(spark, sf_dir):
    found = wave_queries.study_invariance(spark, sf_dir).collect()
    assert {(x.table, x.held_fold) for x in found} == {(t, f) for t in wave_queries.STUDY for f in range(1, 9)}
    assert all(x.unchanged and x.rows_first == x.rows_second for x in found)
    assert all(x.rows_first == {"templates": 2, "features": 64}.get(x.table, x.rows_first) for x in found)


def test_a_planted_leak_is_found(spark, sf_dir):
    rows = wave_queries.classes(spark, sf_dir)
    found = checks.label_invariance(lambda x: wave_queries.study(x, leak=True), rows, "y", "fold", [1, 2], wave_queries.STUDY, 5).collect()
    used = {x.fold for x in rows.select("fold").distinct().collect()}
    assert len(found) == 6 and {1, 2} <= used
    assert not any(x.unchanged for x in found if x.table in ("templates", "features"))
    assert not all(x.unchanged for x in found if x.table == "predictions")


def test_sums_on_the_grid_are_exact(spark):
    x = np.random.default_rng(1).normal(size=2000) * 100
    got = spark.createDataFrame([(x.tolist(),)], "w array<double>").select(checks.on_grid("w").alias("w")).first().w
    assert sum(got) == sum(reversed(got)) == sum(sorted(got)) and np.abs(np.array(got) - x).max() <= 2.0**-21
    assert spark.range(1).select(checks.on_grid(F.lit(None).cast("array<double>")).alias("w")).first().w is None


def test_a_wave_is_described_once(spark, sf_dir, monkeypatch):
    """Not once per held-out fold: the study has each wave eight times."""
    described, plain = [], wave_queries.templates.morphology
    monkeypatch.setattr(wave_queries.templates, "morphology", lambda rows, wave: described.append(rows) or plain(rows, wave))
    rows = checks.flipped(wave_queries.classes(spark, sf_dir), "y", "fold", [1, 2, 3], False)
    features = wave_queries.study(rows)["features"]
    assert [df.count() for df in described] == [64] and features.count() == 3 * 64
