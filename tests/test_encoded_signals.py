"""Signals that travel as a few values and are made where they are needed: the same results, dealt over all tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseweave.operators import waveforms
from pulseweave.plans import wave_queries


@pytest.fixture(scope="module")
def given(spark):
    """(encoded, decoded) records: of twelve values, of fewer, with a missing one and with negative ones."""
    r = np.random.default_rng(8)
    values = [[float(v) for v in r.uniform(-50, 250, n)] for n in (12, 12, 12, 5, 1)] + [[3.5, None, 77.25, 12.0, None, 99.99, 100.01, 0.0]]
    encoded = spark.createDataFrame([(k, v, True) for k, v in enumerate(values)], "rec int, signal array<double>, ok boolean")
    made = lambda v: wave_queries.pulses(type("Values", (), {"as_py": lambda self: v})()).T.tolist()
    decoded = spark.createDataFrame([(k, made(v), True) for k, v in enumerate(values)], "rec int, signal array<array<double>>, ok boolean")
    return encoded, decoded


def rows(df):
    """Sorted; sums of records that are filtered together differ in the last bits."""
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in x) for x in df.collect()), key=str)


def test_pulses():
    values = [3.5, None, 250.25, -7.75]
    x = wave_queries.pulses(type("Values", (), {"as_py": lambda self: values})())
    t = np.arange(5000)
    base = 0.05 * np.sin(t / 400.0)
    for at, height, first in ((153, 1.5, 90), (1000, 1.25, 890), (1342, 0.25, 1290)):
        base += np.where((np.abs(t - at) < 60) & (t >= first), height * np.exp(-((t - at) ** 2) / 50.0), 0.0)
    assert x.shape == (5000, 12) and np.allclose(x[:, 0], 0.4 * base) and np.allclose(x[:, 3], -0.5 * base)


def test_signals_travel_as_values(spark, tmp_path):
    made = spark.range(60).selectExpr("id AS event_id", "id % 2 AS user_id", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, id) AS ts", "'view' AS event_type", "id + 0.5D AS value")
    made.write.parquet(str(tmp_path / "events.parquet"))
    records = wave_queries.signals(spark, str(tmp_path))
    assert records.schema["signal"].dataType.simpleString() == "array<double>"  # 480,000 bytes a record before
    assert sorted(len(x.signal) for x in records.collect()) == [6, 6, 12, 12, 12, 12]


def test_peaks_of_encoded_signals(given):
    encoded, decoded = given
    found = waveforms.detect(encoded.coalesce(1), ["rec"], decode=wave_queries.pulses)
    assert rows(found) == rows(waveforms.detect(decoded, ["rec"])) and found.count() > 20
    assert found.select(F.spark_partition_id()).distinct().count() == 2  # all shuffle partitions of the tests, in spite of their few bytes


def test_grid_of_encoded_signals(given):
    encoded, decoded = given
    found = rows(waveforms.detector_grid(encoded, ["rec"], decode=wave_queries.pulses))
    assert found == rows(waveforms.detector_grid(decoded, ["rec"])) and len(found) == 9 * 6


def test_spectra_of_encoded_signals(given):
    encoded, decoded = given
    found = rows(waveforms.spectra(encoded, ["rec"], decode=wave_queries.pulses))
    assert found == rows(waveforms.spectra(decoded, ["rec"])) and len(found) == 12 * 6


def test_mean_beats_are_those_of_beats(spark, given):
    encoded, decoded = given
    events = spark.createDataFrame([(rec, k, 150.5 + 400 * k, 350 + 400 * k, 549.5 + 400 * k) for rec in range(5) for k in range(4)] + [(5, 0, 5.0, 10, 6000.0), (5, 1, None, 10, 20.0)], "rec int, source_index int, left_at double, r_peak_sample long, right_at double")
    beats = waveforms.beat_waves(events, decoded, ["rec"]).collect()
    heights = waveforms.beat_waves(events, encoded, ["rec"], decode=wave_queries.pulses, waves=False)
    assert "beat" not in heights.columns
    assert rows(heights) == sorted(((x.rec, x.source_index, x.max_abs and round(x.max_abs, 9), x.failure_code) for x in beats), key=str)
    means = waveforms.mean_beats(events, encoded, ["rec"], decode=wave_queries.pulses).collect()
    assert [(x.rec, x.lead, x.failure_code) for x in means if x.rec == 5] == [(5, None, "event_outside_signal")]
    for x in means:
        if x.rec < 5:
            own = [b.beat[waveforms.LEADS.index(x.lead)] for b in beats if b.rec == x.rec]
            assert x.n == len(own) == 4 and np.allclose(x.wave, np.mean(own, 0))
    assert len(means) == 5 * 12 + 1


def test_grid_outcomes_are_counted(spark, tmp_path, monkeypatch):
    """Outcomes of all records are counted where they are found: nothing with a row per record is stored."""
    made = spark.range(90).selectExpr("id AS event_id", "id % 3 AS user_id", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, id) AS ts", "'view' AS event_type", "(id * 37 % 90) + 0.5D AS value")
    made.write.parquet(str(tmp_path / "events.parquet"))
    stored = []
    monkeypatch.setattr(wave_queries.storage, "written", lambda df, name: stored.append(name) or df)
    found = {(x.min_peak_distance_ms, x.mad_multiplier): x for x in wave_queries.detector_grid(spark, str(tmp_path)).collect()}
    assert stored == [] and len(found) == 9
    each = waveforms.detector_grid(wave_queries.signals(spark, str(tmp_path)), wave_queries.RECORD, decode=wave_queries.pulses).collect()
    for key, x in found.items():
        own = [e for e in each if (e.min_peak_distance_ms, e.mad_multiplier) == key]
        assert len(own) == 9 and x.failed == 0 and x.pass_rate == np.mean([e.beat_gate_pass for e in own])
        assert x.peak_median == np.median([e.peak_count for e in own]) and abs(x.rr_median - np.median([e.rr_in_range_fraction for e in own])) < 1e-6


def test_leads_of_a_made_signal_lie_together():
    """Spectra read a lead at a time, so a signal is not turned over before."""
    assert wave_queries.pulses(type("Values", (), {"as_py": lambda self: [3.5, 77.25]})()).T.flags.c_contiguous


def test_heights_are_asked_where_beats_are_cut(spark, given):
    """Beats that are too high are left out as validity leaves them out, without cutting them before."""
    encoded, decoded = given
    cuts = spark.createDataFrame([(rec, k, 150.5 + 400 * k, 350 + 400 * k, 549.5 + 400 * k) for rec in range(5) for k in range(10)], "rec int, source_index int, left_at double, r_peak_sample long, right_at double")
    beats = [x for x in waveforms.beat_waves(cuts, decoded, ["rec"]).collect()]
    largest = float(np.median([x.max_abs for x in beats]))
    means = {(x.rec, x.lead): x for x in waveforms.mean_beats(cuts, encoded, ["rec"], decode=wave_queries.pulses, largest=largest, least=3).collect()}
    kept = {rec: [x.beat for x in beats if x.rec == rec and x.max_abs <= largest + 1e-12] for rec in range(5)}
    assert {rec for rec, _ in means} == {rec for rec, own in kept.items() if len(own) >= 3} and any(0 < len(own) < 10 for own in kept.values())
    for (rec, lead), x in means.items():
        assert x.n == len(kept[rec]) and np.allclose(x.wave, np.mean([b[waveforms.LEADS.index(lead)] for b in kept[rec]], 0))


def test_signals_are_filtered_once_for_beats(spark, tmp_path, monkeypatch):
    made = spark.range(24).selectExpr("id AS event_id", "0L AS user_id", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, id) AS ts", "'view' AS event_type", "id + 0.5D AS value")
    made.write.parquet(str(tmp_path / "events.parquet"))
    twice = []
    monkeypatch.setattr(waveforms, "beat_waves", lambda *a, **k: twice.append(a))
    found = wave_queries.waveform_beats(spark, str(tmp_path)).collect()
    assert not twice and {(x.user_id, x.record) for x in found} == {(0, 0), (0, 1)} and len(found) == 24
