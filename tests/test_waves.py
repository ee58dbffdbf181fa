import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseweave.operators import distances, quality, templates, waveforms
from pulseweave.sources import manifests, records, tables


def plain_distance(a, b):
    """The rules, cell by cell."""
    m = distances.reduction()

    def one(a, b):
        scaled = []
        for x in (a, b):
            s = m @ x
            q1, q2, q3 = np.percentile(s, (25, 50, 75))
            scaled.append((s - q2) / max(q3 - q1, 1e-8))
        f, g = scaled
        cost, move = np.full((101, 101), np.inf), {}
        cost[0, 0] = 0
        for i in range(100):
            for j in range(max(0, i - 20), min(100, i + 21)):
                options = [cost[i, j], cost[i, j + 1] if i else np.inf, cost[i + 1, j] if j else np.inf]
                move[i, j] = int(np.argmin(options))
                cost[i + 1, j + 1] = options[move[i, j]] + (f[i] - g[j]) ** 2
        hits = [[] for _ in range(100)]
        i = j = 99
        while True:
            hits[i].append(j)
            if i == j == 0:
                break
            step = move[i, j]
            i, j = i - (step != 2), j - (step != 1)
        at = np.arange(500.0)
        shift = np.clip(np.interp(at, np.linspace(0, 499, 100), [np.mean(h) * 499 / 99 for h in hits]) - at, -100, 100)
        w, own = np.interp(at + shift, at, b), a - a.mean()
        e = own @ own
        amp = np.clip(own @ (w - w.mean()) / (e + 1e-6 * max(e, 1)), 0, 5)
        return 10 * abs(amp - 1) + (abs(shift).max() + shift.std(ddof=1)) / 500

    return (one(a, b) + one(b, a)) / 2


def test_distance(spark):
    r = np.random.default_rng(0)
    a = r.normal(size=(4, 500)).cumsum(1)
    b = np.roll(a, 15, axis=1) * 1.2
    expected = [plain_distance(x, y) for x, y in zip(a, b, strict=True)]
    assert np.allclose(distances.distance(a, b), expected, atol=1e-10)
    rows = [(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b, strict=True))] + [(8, None, a[0].tolist()), (9, [0.0] * 500, a[0].tolist()), (10, [1.0], [1.0])]
    found = {x.i: x.distance for x in distances.with_distance(spark.createDataFrame(rows, "i int, a array<double>, b array<double>")).collect()}
    assert [found[i] for i in range(4)] == pytest.approx(expected) and found[8] is None and found[9] is None and found[10] is None


def test_stretch(spark):
    got = spark.createDataFrame([([1.0, 0.0],)], "w array<double>").select(distances.stretched("w", 3).alias("s")).first().s
    assert got == [1.0, 0.5, 0.0]


def test_fold_templates(spark):
    rows = spark.createDataFrame([(i, i, i % 2, [float(i), 1.0]) for i in range(1, 8)], "id int, fold int, label int, w array<double>")
    pool = rows.filter("id <= 4")
    found = {(x.fold, x.label): x for x in templates.fold_templates(pool, [], "fold", "label", "w", [1, 7], [0, 1], 1).collect()}
    assert found[7, 0].w == [3.0, 1.0] and found[7, 1].w == [2.0, 1.0] and found[1, 1].w == [3.0, 1.0]
    strict = templates.fold_templates(pool, [], "fold", "label", "w", [1, 7], [0, 1], 2).collect()
    assert {(x.fold, x.label): (x.n, x.status, x.w is None) for x in strict} == {(1, 0): (2, "insufficient", True), (1, 1): (1, "insufficient", True), (7, 0): (2, "ok", False), (7, 1): (2, "ok", False)}
    assert templates.contributors(pool, "id", "fold", "label", [1, 7]).filter("own_fold = template_fold").isEmpty()


def test_spread_and_morphology(spark):
    r = np.random.default_rng(1)
    beats = r.normal(size=(5, 30))
    rows = spark.createDataFrame([("r", x.tolist()) for x in beats] + [("few", [1.0, 2.0])], "rec string, w array<double>")
    found = {x.rec: x.vh for x in templates.sample_spread(rows, ["rec"], "w").collect()}
    assert found["r"] == pytest.approx(beats.std(0, ddof=1).mean() / beats.std(1, ddof=1).mean()) and found["few"] is None
    got = templates.morphology(rows.limit(1), "w").first()
    x = np.array(rows.first().w)
    assert [got.wave_mean, got.wave_sd, got.wave_q25, got.wave_q75] == pytest.approx([x.mean(), x.std(), *np.percentile(x, (25, 75))])


def test_filters_pass_and_stop():
    for sections, gains in ((waveforms.butterworth(4, 0.5, None), {0.5: 0.5**0.5, 10.0: 1.0}), (waveforms.butterworth(4, 5.0, 20.0), {5.0: 0.5**0.5, 10.0: 1.0, 20.0: 0.5**0.5})):
        for f, gain in gains.items():
            z = np.exp(2j * np.pi * f / 500)
            h = np.prod([(s[0] + s[1] / z + s[2] / z**2) / (s[3] + s[4] / z + s[5] / z**2) for s in sections])
            assert abs(h) == pytest.approx(gain, abs=1e-3)
    x = np.full((400, 2), 3.0)
    assert np.abs(waveforms.highpassed(x)).max() < 1e-9
    wave = np.sin(2 * np.pi * 10 * np.arange(5000) / 500)[:, None]
    assert np.abs(waveforms.zero_phase(waveforms.butterworth(4, 5.0, 20.0), wave)[1000:4000] - wave[1000:4000]).max() < 1e-3


def test_local_peaks():
    x = np.array([0, 1, 0, 3, 3, 3, 0, 2, 0, 5, 4.0])
    assert waveforms.local_peaks(x, 0.5, 1).tolist() == [1, 4, 7, 9]
    assert waveforms.local_peaks(x, 0.5, 4).tolist() == [4, 9]
    assert waveforms.local_peaks(x, 2.5, 1).tolist() == [4, 9]


def signal(at, seed=0):
    t = np.arange(5000)
    pulse = sum(np.exp(-((t - p) ** 2) / 50) for p in at) + 0.1 * np.sin(t / 300)
    return np.stack([pulse * (0.5 if n != "aVR" else -0.5) for n in waveforms.LEADS])


def test_detection_and_beats(spark):
    at = [300, 750, 1180, 1600, 2050, 2500, 2960, 3400, 3900, 4400]
    rows = spark.createDataFrame([(1, signal(at).tolist(), True), (2, None, False)], "rec int, signal array<array<double>>, ok boolean")
    peaks = [x.r_peak_sample for x in waveforms.detect(rows, ["rec"]).orderBy("r_peak_sample").collect()]
    assert len(peaks) == len(at) and max(abs(p - q) for p, q in zip(peaks, at, strict=True)) <= 3
    grid = waveforms.detector_grid(rows, ["rec"]).collect()
    assert len(grid) == 9 and all(x.beat_gate_pass for x in grid if x.mad_multiplier == 3.0)
    events = spark.createDataFrame([(1, 0, None, 300, 525.0), (1, 1, 525.0, 750, 965.0)], "rec int, source_index int, left_at double, r_peak_sample long, right_at double")
    beat = waveforms.beat_waves(events, rows, ["rec"]).first()
    wave = np.array(beat.beat)
    assert wave.shape == (12, 500) and abs(int(np.abs(wave[0]).argmax()) - 250) <= 3 and beat.max_abs == pytest.approx(np.abs(wave).max())


def test_band_powers():
    t = np.arange(5000) / 500
    total, (wander, mains, high) = waveforms.band_powers(np.sin(2 * np.pi * 50 * t))
    assert total == pytest.approx(0.5, rel=1e-6) and mains == pytest.approx(1) and high == pytest.approx(1) and wander < 1e-9
    assert waveforms.band_powers(np.ones(100)) == (0.0, [0.0, 0.0, 0.0])


def test_quality(spark):
    x = [0.0] * 8 + [1.0, 2.0, 1.0, 9.0]
    rows = spark.createDataFrame([("r", 0, x), ("r", 1, [-v for v in x]), ("r", 2, [1.0] * 12)], "rec string, lead int, w array<double>")
    q = {r.lead: r for r in quality.lead_quality(rows, "w").collect()}
    assert q[0].plateau_share == pytest.approx(8 / 12) and q[0].longest_flat == 7 and q[0].mode_share == pytest.approx(8 / 12) and q[0].flat_flag
    assert q[2].plateau_share == 1.0 and q[2].amplitude_range == 0
    assert [(p.lead, p.other_lead, round(p["corr"], 6)) for p in quality.correlated_pairs(rows, ["rec"], "lead", "w").collect()] == [(0, 1, -1.0)]
    grid = quality.threshold_grid(rows, "w", (0.5, 1.5), 10.0, quality.excluded(F.size("w") - 1, F.array(F.lit(0)), 3))
    g = {(r.lead, r.threshold_mv): r for r in grid.collect()}
    assert g[0, 0.5].low_share == pytest.approx(7 / 11) and g[0, 0.5].longest_low_s == 0.7 and g[0, 0.5].outside_share == pytest.approx(3 / 7)
    status = quality.quality_status(spark.createDataFrame([(True, "", True), (False, "x", False), (True, None, False), (False, " ".strip(), False)], "read_ok boolean, failure_code string, has_signal boolean"))
    assert [(r.quality_ok, r.quality_code, r.quality_flags) for r in status.collect()] == [(True, "", []), (False, "x", ["read_failure", "x"]), (False, "reader_result_invalid", ["read_failure", "reader_result_invalid"]), (False, "read_failure", ["read_failure"])]


HEADER = "{name} 12 500 {n}\n" + "".join("{name}.dat {fmt} 1000(0)/{unit} 16 0 0 0 0 " + lead + "\n" for lead in waveforms.LEADS[::-1])


def test_records(spark, tmp_path):
    r = np.random.default_rng(5)
    digital = r.integers(-900, 900, (50, 12)).astype("<i2")

    def put(name, fmt="16", unit="mV", data=digital, n=50):
        (tmp_path / f"{name}.hea").write_text(HEADER.format(name=name, fmt=fmt, unit=unit, n=n))
        if data is not None:
            (tmp_path / f"{name}.dat").write_bytes(data.tobytes())

    put("good")
    put("short", data=digital[:-1])
    put("format", fmt="212")
    put("unit", unit="foo")
    put("gone", data=None)
    bad = digital.copy()
    bad[3, 3] = -32768
    put("sentinel", data=bad)
    (tmp_path / "alone.dat").write_bytes(b"\0\0")
    found = {x.record.rsplit("/", 1)[1]: x for x in records.read_records(spark, str(tmp_path)).collect()}
    assert {k: v.failure_code for k, v in found.items()} == {"good": None, "short": "data_size_mismatch", "format": "unsupported_format", "unit": "unsupported_unit", "gone": "missing_data", "sentinel": "invalid_digital_sentinel", "alone": "missing_header"}
    assert found["good"].lead_names == list(waveforms.LEADS)
    assert np.allclose(found["good"].signal, (digital[:, ::-1] / 1000).T, atol=1e-6)
    # a header names its data file, in a folder below too; units and leads in any case
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "other.dat").write_bytes(digital.tobytes())
    text = HEADER.format(name="named", fmt="16+0", unit="UV", n=50).replace("named.dat", "sub/other.dat").replace("aVR", "AVR")
    (tmp_path / "named.hea").write_text(text)
    for name, line in {"empty": "# nothing\n", "neg": "x 1 500 5\nx.dat 16 -3/mV 0 0 0 0 0 I\n", "huge": "x 1 500 600000000\nnamed.dat 16 1/mV 0 0 0 0 0 I\n", "abs": "x 1 500 5\n/x.dat 16 1/mV 0 0 0 0 0 I\n", "up": "x 1 500 5\na/../x.dat 16 1/mV 0 0 0 0 0 I\n"}.items():
        (tmp_path / f"{name}.hea").write_text(line)
    (tmp_path / "named.dat").write_bytes(b"\0\0")
    found = {x.record.rsplit("/", 1)[1]: x for x in records.read_records(spark, str(tmp_path)).collect()}
    codes = {"named": None, "empty": "malformed_header", "neg": "malformed_header", "huge": "data_size_limit", "abs": "malformed_header", "up": "unsafe_path"}
    assert {k: found[k].failure_code for k in codes} == codes and len(found) == 13
    assert np.allclose(found["named"].signal, (digital[:, ::-1] / 1e6).T, atol=1e-6) and found["named"].lead_names == list(waveforms.LEADS)
    gated = records.shape_gate(records.read_records(spark, str(tmp_path)), samples=51)
    assert {x.failure_code for x in gated.filter("record LIKE '%good'").collect()} == {"shape_mismatch"}


def test_tables_and_manifests(spark, tmp_path):
    path = str(tmp_path / "m.csv")
    with open(path, "w", encoding="utf-8-sig") as f:
        f.write("ecg_id,patient_id,age,scp_codes,strat_fold,filename_hr\n1,14469.0,300,\"{'NORM': 100.0}\",3,a/1\n")
    row = tables.read_metadata(spark, path).first()
    assert (row.ecg_id, row.patient_id, row.scp_codes, row.pacemaker) == (1, 14469.0, "{'NORM': 100.0}", None)
    out = str(tmp_path / "out")
    tables.write_results(spark.createDataFrame([(1, float("nan"))], "a int, b double"), out)
    assert tuple(spark.read.parquet(out).first()) == (1, 1, None)
    with pytest.raises(Exception, match="exist"):
        tables.write_results(spark.createDataFrame([(1,)], "a int"), out)
    before = manifests.file_manifest(spark, str(tmp_path), "*.csv")
    assert before.count() == 1 and manifests.drift(before, before).isEmpty()
    texts = spark.createDataFrame([(1, "a"), (2, None)], "k int, t string")
    moved = texts.filter("k = 2").withColumn("t", F.lit("b")).unionByName(spark.createDataFrame([(3, "c")], "k int, t string"))
    got = {x.path: x.what for x in manifests.drift(manifests.content_manifest(texts, "k", "t"), manifests.content_manifest(moved, "k", "t")).collect()}
    assert got == {1: "removed", 2: "changed", 3: "added"}


def test_records_that_cannot_be_searched(spark):
    at = [300, 750, 1180, 1600, 2050, 2500, 2960, 3400, 3900, 4400]
    good = signal(at)
    bad = good.copy()
    bad[2, 7] = np.nan
    rows = [(1, good.tolist()), (2, good[:, :20].tolist()), (3, bad.tolist()), (4, good[:5].tolist()), (5, [[1.0], [1.0, 2.0]]), (6, [])]
    records_ = spark.createDataFrame([(i, s, True) for i, s in rows], "rec int, signal array<array<double>>, ok boolean")
    found = waveforms.detect(records_, ["rec"]).collect()
    assert {x.rec: x.failure_code for x in found} == {1: None, 2: "signal_too_short", 3: "nonfinite_values", 4: "required_leads_missing", 5: "invalid_shape", 6: "invalid_shape"}
    assert sum(x.rec == 1 for x in found) == len(at) and all(x.r_peak_sample is None for x in found if x.rec > 1)


def test_refine():
    composite = np.zeros(1000)
    composite[[100, 180, 400, 700]] = [1.0, -2.0, 3.0, 1.0]
    assert waveforms.refine(np.array([90, 170, 395, 700]), composite) == [180, 400, 700]
    assert waveforms.refine(np.array([], int), composite) == []
    assert waveforms.refine(np.array([5, 999]), np.ones(1000)) == [0, 949]


def test_alignment_failures(spark):
    wave = [float(k % 7) for k in range(500)]
    rows = [(1, wave, wave), (2, wave[:3], wave), (3, wave, None), (4, [float("nan")] * 500, wave), (5, wave, [1.0] * 500)]
    found = spark.createDataFrame(rows, "i int, a array<double>, b array<double>").select("i", distances.alignment_failure("a", "b").alias("c")).collect()
    assert {x.i: x.c for x in found} == {1: None, 2: "invalid_shape", 3: "invalid_shape", 4: "nonfinite_signal", 5: "source_low_energy"}


def test_excluded(spark):
    r = np.random.default_rng(3)
    for _ in range(8):
        size, peaks, radius = int(r.integers(1, 60)), r.integers(-5, 65, r.integers(0, 7)).tolist(), int(r.integers(0, 9))
        got = spark.range(1).select(quality.excluded(F.lit(size), F.lit(peaks).cast("array<int>"), radius).alias("m")).first().m
        assert got == [int(any(abs(d - p) <= radius for p in peaks)) for d in range(size)]


def test_strict_templates_and_thresholds_of_a_pool(spark):
    """Labels i % 2, pool i <= 4, one record whose spread is too large, and a validation label that does not matter."""
    nan = float("nan")
    rows = spark.createDataFrame([(i, 2 if i == 7 else 1, i % 2, "pool" if i <= 4 else "probe", 0.1 if i != 3 else nan, [float(i), 1.0]) for i in range(1, 8)], "id int, fold int, label int, role string, vh double, w array<double>")
    made = lambda least, limit: {x.label: (x.n, x.status, x.w) for x in templates.strict_templates(rows, [], "fold", "label", "w", [2], [0, 1], F.col("role") == "pool", F.col("vh") < limit, least).collect()}
    assert made(1, 0.3) == {0: (2, "ok", [3.0, 1.0]), 1: (1, "ok", [1.0, 1.0])}
    assert made(2, 0.3) == {0: (2, "insufficient", None), 1: (1, "insufficient", None)}
    assert made(1, 0.05) == {0: (0, "insufficient", None), 1: (0, "insufficient", None)}
    counts = templates.threshold_counts(rows, "vh", "label", (0.05, 0.3), F.col("role") == "pool").collect()
    assert {(x.threshold, x.label): (x.eligible, x.eligible_pool) for x in counts} == {(0.05, 0): (0, 0), (0.05, 1): (0, 0), (0.3, 0): (3, 2), (0.3, 1): (3, 1)}
