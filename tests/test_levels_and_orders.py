"""Metrics of both levels, rows that were never scored, and orders of NumPy's generator."""

import os

import numpy as np
import pytest

from pulseweave.operators import checks, events, logistic, metrics, shuffles
from pulseweave.sources import manifests


def test_levels_equal_two_passes(spark):
    r = np.random.default_rng(1)
    rows = [("ab"[int(k % 2)] if k % 11 else None, int(r.integers(1, 4)) if k % 13 else None, int(r.integers(0, 2)) if k % 2 or k % 4 else 1, None if k % 9 == 0 else round(float(r.random()), 1)) for k in range(300)]
    df = spark.createDataFrame(rows, "cfg string, fold int, label int, score double").repartition(4)
    found = {(x.level, x.cfg, x.fold): x for x in metrics.oof_metrics_levels(df, ["cfg"], "fold").collect()}
    names = ("expected", "evaluated", "missing", "auroc", "balanced_accuracy", "coverage")
    groups = {("fold", c, f) for c, f, *_ in rows} | {("pooled", c, None) for c, *_ in rows}
    assert set(found) == groups
    for level, cfg, fold in groups:
        own = [x for x in rows if x[0] == cfg and (level == "pooled" or x[1] == fold)]
        y, s = np.array([x[2] for x in own if x[3] is not None]), np.array([x[3] for x in own if x[3] is not None])
        pos, neg = s[y == 1], s[y == 0]
        auroc = np.mean((pos[:, None] > neg) + (pos[:, None] == neg) / 2) if len(pos) and len(neg) else None
        ba = (np.mean(pos >= 0.5) + np.mean(neg < 0.5)) / 2 if len(pos) and len(neg) else None
        got = tuple(found[level, cfg, fold][n] for n in names)
        assert got[:3] == (len(own), len(s), len(own) - len(s)) and got[3:5] == (pytest.approx(auroc), pytest.approx(ba)) and got[5] == ("complete" if len(s) == len(own) else "partial_not_full_CV")
    assert metrics.oof_metrics_levels(df.limit(0), ["cfg"], "fold").collect() == []


def test_levels_scan_once(spark, tmp_path):
    spark.createDataFrame([("a", 1, 1, 0.5)], "cfg string, fold int, label int, score double").write.parquet(str(tmp_path / "p"))
    plan = metrics.oof_metrics_levels(spark.read.parquet(str(tmp_path / "p")), ["cfg"], "fold")
    assert sorted((x.level, x.expected) for x in plan.collect()) == [("fold", 1), ("pooled", 1)]
    executed = plan._jdf.queryExecution().executedPlan().toString()
    assert executed.split("Initial Plan")[0].count("Scan parquet") - executed.split("Initial Plan")[0].count("ReusedExchange") <= 2


def test_rows_that_were_never_scored(spark):
    records = spark.createDataFrame([("s", 1, 10, 0), ("s", 2, 20, 1), ("s", 2, 21, 0), ("t", 2, 20, 1), ("t", 2, None, 1)], "stage string, fold int, id int, label int")
    status = spark.createDataFrame([("s", 1, "ok"), ("s", 2, "insufficient"), ("s", 2, "insufficient"), ("t", 2, "insufficient")], "stage string, fold int, status string")
    rows = [("s", 1, 10, 0, k, m, 0.5) for k in (0, 1) for m in "AB"] + [("s", 2, 20, 1, 0, "A", 0.7)]
    scored = spark.createDataFrame(rows, "stage string, fold int, id int, label int, seed int, model string, score double")
    found = [tuple(x) for x in logistic.completed(scored, records, status, ["stage"], "fold", "id", [0, 1], ["A", "B"]).select("stage", "fold", "id", "label", "seed", "model", "score", "score_status").collect()]
    expected = [(*x[:6], 0.5, "ok") for x in rows[:4]]
    expected += [(st, f, i, y, k, m, None, "insufficient_train_prototypes") for st, f, i, y in (("s", 2, 20, 1), ("s", 2, 21, 0), ("t", 2, 20, 1), ("t", 2, None, 1)) for k in (0, 1) for m in "AB"]
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_orders_equal_numpy(spark):
    sizes = {3: 1, 14469: 12, 0: 40}
    rows = [(k, 100 * k + i, i, float(i * i % 7), True) for k, n in sizes.items() for i in range(n)]
    valid = events.adjacent(spark.createDataFrame(rows, "id long, source_index int, beat_index int, v double, valid boolean").repartition(3), ["id"])
    found = {}
    for x in shuffles.numpy_orders(valid, "id", [0, 7001, 7005]).collect():
        assert x.v == float(x.vector_origin**2 % 7)
        found.setdefault((x.id, x.seed), {})[x.valid_position] = x.vector_origin
    for (k, seed), order in found.items():
        expected = np.arange(sizes[k]) if seed == 0 else np.random.default_rng(np.random.SeedSequence([seed, k])).permutation(sizes[k])
        assert [order[p] for p in range(sizes[k])] == expected.tolist()
    assert len(found) == 9
    stats = {(x.id, x.seed): x for x in shuffles.moved_stats(shuffles.numpy_orders(valid, "id", [0, 7001]), valid, ["id"], ["v"]).collect()}
    order = np.random.default_rng(np.random.SeedSequence([7001, 14469])).permutation(12)
    steps = np.abs(np.diff((order**2 % 7).astype(float)))
    assert stats[14469, 7001].v_mean == pytest.approx(steps.mean()) and stats[14469, 7001].pairs == 11 and stats[3, 7001].v_mean is None


def test_blocks_of_a_long_record(spark):
    found = shuffles.seeded_permutations(spark.createDataFrame([(5, 1000)], "id long, n long"), "id", "n", [9], block=64).collect()
    assert [x.vector_origin for x in sorted(found, key=lambda x: x.valid_position)] == np.random.default_rng(np.random.SeedSequence([9, 5])).permutation(1000).tolist()


def test_stored_metrics(spark):
    schema = "k string, evaluated long, auroc double, balanced_accuracy double"
    new = [("same", 5, 0.5, 0.5), ("close", 5, 0.5, 0.5), ("n", 5, 0.5, 0.5), ("a", 5, 0.5, 0.5), ("b", 5, 0.5, None), ("null", 0, None, None), ("lost", 1, 0.1, 0.1), (None, 2, 0.2, 0.2)]
    old = [("same", 5, 0.5, 0.5), ("close", 5, 0.500004, 0.5), ("n", 4, 0.9, 0.5), ("a", 5, 0.51, 0.5), ("b", 5, 0.5, 0.5), ("null", 0, None, None), ("extra", 1, 0.1, 0.1), (None, 2, 0.2, 0.2)]
    found = {x.k: x.what for x in checks.differing_metrics(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), ["k"]).collect()}
    assert found == {"same": "", "close": "", "n": "evaluated", "a": "auroc", "b": "balanced_accuracy", "null": "", "lost": "not_stored", "extra": "not_recomputed", None: ""}


def test_files_that_were_touched(spark, tmp_path):
    for name in "abc":
        (tmp_path / name).write_text(name)
    before = spark.createDataFrame(manifests.file_manifest(spark, str(tmp_path)).collect(), "path string, size long, modified timestamp, sha256 string")
    (tmp_path / "b").write_text("other")
    os.utime(tmp_path / "c", (1, 1))
    (tmp_path / "a").unlink()
    (tmp_path / "d").write_text("d")
    found = {x.path.rsplit("/", 1)[1]: x.what for x in manifests.drift(before, manifests.file_manifest(spark, str(tmp_path))).collect()}
    assert found == {"a": "removed", "b": "changed", "c": "touched", "d": "added"}
