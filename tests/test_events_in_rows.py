"""Repair, validity and beats of bounded records in the row that has their signal: the same as by windows, and nothing sent or stored for it."""

import random

import pytest
from pyspark.sql import functions as F

from pulseweave.functions.scalar import let
from pulseweave.operators import events, waveforms
from pulseweave.plans import wave_queries

PEAKS = "rec int, peaks array<struct<r_peak_sample: long, amp: double, slope: double>>"


@pytest.fixture(scope="module")
def records(spark):
    r, rows = random.Random(4), [(0, []), (1, [(700, 1.0, 1.0)])]
    for rec in range(2, 80):
        at, own = 0, []
        for _ in range(r.choice([3, 5, 6, 12, 30])):
            at += r.choice([125, 140, 149, 150, 160, 199, 200, 201, 390] + [1000, 1001] * (rec % 3 == 0))
            own.append((at, None if r.random() < 0.02 else r.choice([1.0, 0.45, 0.44, 0.1]), r.choice([1.0, 0.5, 0.49, 0.05])))
        rows.append((rec, own))
    return spark.createDataFrame(rows, PEAKS).cache()


def test_repair_and_validity_of_a_row(records):
    rows = records.select("rec", F.inline("peaks"))
    kept = events.repair(rows, ["rec"], ["r_peak_sample"], "r_peak_sample", "amp", "slope")
    in_rows = records.select("rec", events.repaired(F.col("peaks"), "r_peak_sample", "amp", "slope").alias("kept"))
    assert sorted(map(str, in_rows.select("rec", F.inline("kept")).collect())) == sorted(map(str, kept.collect()))
    assert 0 < kept.count() < rows.count()
    timed = events.intervals(kept, ["rec"], ["r_peak_sample"], "r_peak_sample", 0.5)
    valid = events.validity(timed, ["rec"], 300, 2000, F.lit(False)).filter("valid").select("rec", "source_index", "left_at", "r_peak_sample", "right_at")
    found = in_rows.select("rec", events.valid_events(F.col("kept"), "r_peak_sample", 0.5, 300, 2000).alias("own"))
    assert sorted(map(str, found.select("rec", F.inline("own")).collect())) == sorted(map(str, valid.collect()))
    sizes = {x.rec: len(x.own) for x in found.collect()}
    assert len(sizes) == 80 and sizes[0] == sizes[1] == 0 and len({n > 0 for n in sizes.values()}) == 2


def made(spark, path, n=130):
    rows = spark.range(n).selectExpr("id AS event_id", "id % 3 AS user_id", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, id) AS ts", "'view' AS event_type", "(id * 37 % 250) + 0.25D AS value")
    rows.write.parquet(f"{path}/events.parquet")
    return str(path)


def test_beats_of_rows_are_those_of_windows(spark, tmp_path):
    sf_dir, keys = made(spark, tmp_path), wave_queries.RECORD
    records = wave_queries.signals(spark, sf_dir)
    kept = events.repair(waveforms.detect(records, keys, decode=wave_queries.pulses), keys, ["r_peak_sample"], "r_peak_sample", "amp", "slope")
    valid = events.validity(events.intervals(kept, keys, ["r_peak_sample"], "r_peak_sample", 0.5), keys, 300, 2000, F.lit(False)).filter("valid")
    expected = waveforms.mean_beats(valid, records, keys, decode=wave_queries.pulses, digits=6, largest=20.0, least=3)
    key = lambda x: (x.user_id, x.record, x.lead)
    found = {key(x): x for x in wave_queries.waveform_beats(spark, sf_dir).collect()}
    assert set(found) == {key(x) for x in expected.collect()} and len(found) >= 12 * 9
    for x in expected.collect():
        assert found[key(x)].n == x.n and found[key(x)].wave == pytest.approx(x.wave, abs=2e-6)


def test_beats_are_found_where_the_signal_is(spark, tmp_path, monkeypatch):
    """Only events and the values of signals are sent: no peak is stored, and no exchange follows the first search."""
    stored = []
    monkeypatch.setattr(wave_queries.storage, "written", lambda df, name: stored.append(name) or df)
    found = wave_queries.waveform_beats(spark, made(spark, tmp_path))
    plan = found._jdf.queryExecution().sparkPlan().toString()
    executed = found._jdf.queryExecution().executedPlan().toString()
    assert stored == [] and plan.count("MapInArrow") == 2 and "Join" not in plan
    assert executed.split("== Initial Plan ==")[-1].count("Exchange ") == 2


def test_failed_records_of_rows(spark):
    """A record that cannot be searched has its code; one without valid events has no beats."""
    rows = spark.createDataFrame([(1, [[0.0] * 20] * 12, True), (2, [[0.0] * 600] * 12, True), (3, [[0.0] * 600] * 12, False)], "rec int, signal array<array<double>>, ok boolean")
    found = {x.rec: x for x in waveforms.detect_whole(rows, ["rec"]).collect()}
    assert {k: (x.peaks, x.failure_code) for k, x in found.items()} == {1: (None, "signal_too_short"), 2: ([], None)} and found[2].signal == [[0.0] * 600] * 12
    cuts = waveforms.detect_whole(rows, ["rec"]).filter("failure_code IS NULL").withColumn("cuts", let(F.col("peaks"), lambda p: events.valid_events(p, "r_peak_sample", 0.5, 300, 2000)))
    assert waveforms.mean_beats_whole(cuts, ["rec"], "cuts").collect() == []


def test_events_without_a_user_are_a_record_too(spark, tmp_path):
    """As in ``waveform_peaks``; a join by the keys lost them."""
    rows = spark.range(24).selectExpr("id AS event_id", "cast(null AS long) AS user_id", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, id) AS ts", "'view' AS event_type", "id + 0.5D AS value")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    found = wave_queries.waveform_beats(spark, str(tmp_path)).collect()
    assert {(x.user_id, x.record) for x in found} == {(None, 0), (None, 1)} and len(found) == 24
