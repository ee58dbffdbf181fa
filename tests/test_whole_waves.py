"""Wave queries use all events, pairs and probes."""

from math import comb

import numpy as np
import pytest

from pulseweave.operators import distances
from pulseweave.plans import wave_queries

from .test_waves import plain_distance


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("waves")
    r = np.random.default_rng(2)
    vectors = [(i, r.normal(size=64).cumsum().tolist(), i % 10) for i in range(61)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(str(path / "embeddings.parquet"))
    # users of 30 and of 3 events
    rows = [(u * 100 + k, u, f"2024-01-01 00:{k:02d}:00", "view", float(37 * k % 90) + 0.5) for u, n in ((1, 30), (2, 3)) for k in range(n)]
    made = spark.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string, value double").selectExpr("event_id", "user_id", "cast(ts AS timestamp_ntz) AS ts", "event_type", "value")
    made.write.parquet(str(path / "events.parquet"))
    return str(path)


def test_signals_use_all_events(spark, sf_dir):
    records = {(x.user_id, x.record) for x in wave_queries.signals(spark, sf_dir).select("user_id", "record").collect()}
    assert records == {(1, 0), (1, 1), (1, 2), (2, 0)}
    found = {(x.user_id, x.record) for x in wave_queries.waveform_peaks(spark, sf_dir).select("user_id", "record").collect()}
    assert {(1, 0), (1, 1), (1, 2)} <= found
    assert wave_queries.lead_spectra(spark, sf_dir).count() == 12 * len(records)
    assert wave_queries.detector_grid(spark, sf_dir).count() == 9
    assert {(1, 0), (1, 1)} <= {(x.user_id, x.record) for x in wave_queries.waveform_beats(spark, sf_dir).collect()}


def test_all_pairs_of_a_record(spark, sf_dir):
    found = {(x.i, x.j): x.distance for x in wave_queries.pairwise_distance(spark, sf_dir).collect()}
    assert set(found) == {(i, j) for j in range(61) for i in range(j) if i // 12 == j // 12} and len(found) == 5 * comb(12, 2)
    wave = {x.vec_id: np.array(x.w) for x in wave_queries.waves(spark, sf_dir).select("vec_id", distances.stretched("embedding").alias("w")).collect()}
    assert found[0, 11] == pytest.approx(plain_distance(wave[0], wave[11]), abs=1e-5)


def test_all_probes_and_classes(spark, sf_dir):
    grid = {(x.probe, x.lead, x.label): x for x in wave_queries.probe_grid(spark, sf_dir).collect()}
    assert set(grid) == {(p, k, c) for p in range(21) for k in range(3) for c in range(10)}
    vectors = {x.vec_id: x for x in wave_queries.waves(spark, sf_dir).select("vec_id", "label", distances.stretched("embedding").alias("w")).collect()}
    fold = {x.vec_id: x.fold for x in wave_queries.waves(spark, sf_dir).select("vec_id", "fold").collect()}  # a probe's number is hashed as a vector's
    for p, k, c in ((4, 0, 3), (7, 2, 5), (19, 1, 8)):
        pool = [np.array(v.w) for i, v in vectors.items() if i % 3 == k and v.label == c and fold[i // 3] != fold[p]]
        if pool and grid[p, k, c].distance is not None:
            assert grid[p, k, c].distance == pytest.approx(plain_distance(np.array(vectors[3 * p + k].w), np.mean(pool, 0)), abs=1e-5)
    assert {(x.vec_id, x.template_label) for x in wave_queries.template_distance(spark, sf_dir).collect()} == {(i, c) for i in range(61) for c in range(10)}


def test_neighbours_of_shuffled_waves(spark, sf_dir):
    found = {(x.record, x.seed): x for x in wave_queries.shuffled_wave_distance(spark, sf_dir).collect()}
    assert set(found) == {(k, s) for k in range(6) for s in range(6) if k < 5}  # the last record has one vector
    wave = {x.vec_id: np.array(x.w) for x in wave_queries.waves(spark, sf_dir).select("vec_id", distances.stretched("embedding").alias("w")).collect()}
    steps = [plain_distance(wave[i], wave[i + 1]) for i in range(11)]
    assert found[0, 0].pairs == 11 and found[0, 0].distance_mean == pytest.approx(np.mean(steps), abs=1e-5)
    assert {found[1, s].pairs for s in range(6)} == {11} and len({found[1, s].distance_mean for s in range(6)}) > 3
