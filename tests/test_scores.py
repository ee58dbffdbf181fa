import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseweave.functions import ranking
from pulseweave.functions.ranking import dense_index, first_per_group
from pulseweave.operators import logistic, metrics


def plain_auroc(scores, labels):
    wins = [(p > n) + (p == n) / 2 for p, a in zip(scores, labels, strict=True) if a for n, b in zip(scores, labels, strict=True) if not b]
    return np.mean(wins) if wins else None


def test_auroc_known(spark):
    rows = spark.createDataFrame([(0.1, 0), (0.9, 1), (0.2, 0), (0.8, 1)], "score double, label int")
    assert metrics.auroc(rows, []).first().auroc == 1.0


def test_metrics_against_pairs(spark):
    r = np.random.default_rng(1)
    data = [(m, float(round(s, 1)) if s > 0.05 else None, int(y)) for m in "ABC" for s, y in zip(r.random(80), r.integers(0, 2, 80), strict=True)]
    found = {x.model: x for x in metrics.oof_metrics(spark.createDataFrame(data, "model string, score double, label int"), ["model"]).collect()}
    for m, row in found.items():
        known = [(s, y) for k, s, y in data if k == m and s is not None]
        assert row.auroc == pytest.approx(plain_auroc(*zip(*known, strict=True)))
        assert row.expected == 80 and row.evaluated == len(known) and row.coverage == ("complete" if len(known) == 80 else "partial_not_full_CV")
        own = [np.mean([(s >= 0.5) == bool(c) for s, y in known if y == c]) for c in (0, 1)]
        assert row.balanced_accuracy == pytest.approx(np.mean(own))


def test_one_class_has_no_auroc(spark):
    assert metrics.auroc(spark.createDataFrame([(0.3, 1), (None, 0)], "score double, label int"), []).first().auroc is None


def test_shuffle_summary_of_published_values(spark):
    """Five published (AUROC, balanced accuracy) pairs and their published summary: fixed values."""
    seeds = [(7001, 0.845, 0.7933333333333333), (7002, 0.8502444444444445, 0.8066666666666666), (7003, 0.8514888888888889, 0.7933333333333333), (7004, 0.8457555555555556, 0.7966666666666666), (7005, 0.8483777777777778, 0.8033333333333333)]
    rows = spark.createDataFrame([("C", s, a, b, 300) for s, a, b in seeds] + [("C", 0, 0.8484222222222222, 0.81, 300), ("A", 7001, 0.1, 0.1, 300)], "model string, seed int, auroc double, balanced_accuracy double, evaluated long")
    x = metrics.shuffle_summary(rows, []).first()
    assert (x.seeds, x.evaluated_min, x.auroc_min, x.auroc_max) == (5, 300, 0.845, 0.8514888888888889)
    assert [x.auroc_mean, x.auroc_sd, x.ba_mean, x.ba_sd] == pytest.approx([0.8481733333333332, 0.0027946333048616233, 0.7986666666666666, 0.006055300708194978], abs=1e-12)


def test_bootstrap_is_centred_and_repeatable(spark):
    r = np.random.default_rng(2)
    y = r.integers(0, 2, 60)
    rows = spark.createDataFrame([(i, int(c), float(r.random() + 0.1 * c) / 1.2, float(r.random() + 0.5 * c) / 1.6) for i, c in enumerate(y)], "id long, label int, a double, b double")
    one = metrics.paired_bootstrap(rows, "a", "b", "id", replicates=30).first()
    two = metrics.paired_bootstrap(rows.repartition(3), "a", "b", "id", replicates=30).first()
    assert one == two and one.replicates == 30 and one.auroc_low <= one.auroc_high
    table = rows.collect()
    assert one.delta_auroc == pytest.approx(plain_auroc([x.b for x in table], [x.label for x in table]) - plain_auroc([x.a for x in table], [x.label for x in table]))


@pytest.mark.parametrize("most_sent", [1000, 0])
def test_bootstrap_against_drawing_rows(spark, most_sent):
    """Rows sent to the tasks, and rows that meet counts of draws: both as drawing row by row."""
    r = np.random.default_rng(3)
    table = [(i, int(r.integers(0, 2)), round(float(r.random()), 1), round(float(r.random()), 1)) for i in range(70)] + [(100, 1, None, 0.5), (101, 2, 0.1, 0.2)]
    rows = spark.createDataFrame(table, "id long, label int, a double, b double")
    got = metrics.paired_bootstrap(rows, "a", "b", "id", replicates=40, most_sent=most_sent).first()
    number = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:8], 16)
    classes = {c: sorted((x for x in table if x[1] == c and x[2] is not None), key=lambda x: (number(str(x[0])) % 256, x[0])) for c in (0, 1)}

    def deltas(sample):
        y = [x[1] for x in sample]
        ba = lambda k: (np.mean([x[k] >= 0.5 for x in sample if x[1] == 1]) + np.mean([x[k] < 0.5 for x in sample if x[1] == 0])) / 2
        return plain_auroc([x[3] for x in sample], y) - plain_auroc([x[2] for x in sample], y), ba(3) - ba(2)

    drawn = [deltas([own[number(f"5001|{k}|{c}|{d}") % len(own)] for c, own in classes.items() for d in range(len(own))]) for k in range(40)]
    whole = deltas(classes[0] + classes[1])
    expected = [v for m in (0, 1) for v in (whole[m], *np.percentile([d[m] for d in drawn], (2.5, 97.5)))]
    assert [got.delta_auroc, got.auroc_low, got.auroc_high, got.delta_ba, got.ba_low, got.ba_high] == pytest.approx(expected, abs=1e-12) and got.replicates == 40


def test_bootstrap_of_one_class_and_of_nothing(spark):
    rows = spark.createDataFrame([(1, 1, 0.5, 0.6)], "id long, label int, a double, b double")
    for table in (rows, rows.limit(0)):
        assert metrics.paired_bootstrap(table, "a", "b", "id", replicates=5).first().delta_auroc is None


def newton(x, y):
    a = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(a.shape[1]), np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve((a.T * (p * (1 - p))) @ a / len(a) + ridge, a.T @ (p - y) / len(a) + ridge @ w)
    return w


def test_fold_logistic_uses_training_rows_only(spark):
    r = np.random.default_rng(3)
    data = []
    for i in range(90):
        y = int(r.random() < 0.5)
        data.append((i, i % 3 + 1, y, float(r.normal(y)), None if i % 7 == 0 else float(r.normal(-y, 2)), 3.0))
    rows = spark.createDataFrame(data, "id int, fold int, label int, x1 double, x2 double, flat double").repartition(4)
    found = {x.id: x.score for x in logistic.fold_scores(rows, [], "fold", "label", ["x1", "x2", "flat"], [1, 2, 3]).collect()}
    full = np.array([[np.nan if v is None else v for v in d[3:]] for d in data])
    fold, label = np.array([d[1] for d in data]), np.array([d[2] for d in data])
    for f in (1, 2, 3):
        train = fold != f
        med, sd = np.nanmedian(full[train], 0), np.nanstd(full[train], 0, ddof=1)
        sd[sd < 1e-8] = 1
        z = np.nan_to_num((full - med) / sd)
        w = newton(z[train], label[train])
        for i in np.flatnonzero(~train):
            assert found[i] == pytest.approx(1 / (1 + np.exp(-(w[0] + z[i] @ w[1:]))), abs=1e-8)


def test_labels_of_a_fold_do_not_reach_its_scores(spark):
    r = np.random.default_rng(8)
    data = [(i, i % 3 + 1, int(r.random() < 0.5), float(r.normal())) for i in range(60)]
    schema, flipped = "id int, fold int, label int, x double", [(i, f, 1 - y if f == 2 else y, x) for i, f, y, x in data]
    one, two = ({x.id: x.score for x in logistic.fold_scores(spark.createDataFrame(d, schema), [], "fold", "label", ["x"], [1, 2, 3]).filter("fold = 2").collect()} for d in (data, flipped))
    assert one == pytest.approx(two, abs=1e-12)


def test_several_configurations_at_once(spark):
    r = np.random.default_rng(9)
    data = [(c, i, i % 2 + 1, int(r.random() < 0.5), float(r.normal())) for c in "ab" for i in range(30)]
    schema = "cfg string, id int, fold int, label int, x double"
    both = {(x.cfg, x.id): x.score for x in logistic.fold_scores(spark.createDataFrame(data, schema), ["cfg"], "fold", "label", ["x"], [1, 2]).collect()}
    for c in "ab":
        alone = logistic.fold_scores(spark.createDataFrame([d for d in data if d[0] == c], schema), [], "fold", "label", ["x"], [1, 2]).collect()
        assert {x.id: x.score for x in alone} == pytest.approx({i: s for (k, i), s in both.items() if k == c}, abs=1e-9)


def test_unusable_folds_have_no_score(spark):
    scored = spark.createDataFrame([(1, 0.4), (2, 0.6)], "fold int, score double")
    status = spark.createDataFrame([(1, "ok"), (2, "insufficient")], "fold int, status string")
    got = {x.fold: (x.score, x.score_status) for x in logistic.with_unusable_folds(scored, status, "fold").collect()}
    assert got == {1: (0.4, "ok"), 2: (None, "insufficient_train_prototypes")}


def test_dense_index_and_first_per_group(spark):
    rows = spark.createDataFrame([(g, i * 7 % 50) for g in "ab" for i in range(50)], "g string, v int")
    found = dense_index(rows, ["g"], (F.col("v") / 10).cast("int"), ["v"]).collect()
    assert all(x["index"] == x.v for x in found)
    assert sorted(x.v for x in first_per_group(rows, ["g"], ["v"], 3).collect()) == [0, 0, 1, 1, 2, 2]


def test_percentiles(spark):
    r = np.random.default_rng(6)
    groups = {"a": r.normal(size=3000), "b": np.repeat([1.0, 2.0, 5.0], [700, 1, 299]), "c": np.array([4.0]), "d": np.array([1.0, 2.0])}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("a", None), ("e", None)]
    found = {x.g: x.p for x in ranking.percentiles(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v", (0.5, 0.0, 0.25, 1.0, 0.97), "p").collect()}
    assert set(found) == set(groups)
    for g, x in groups.items():
        assert found[g] == pytest.approx(np.percentile(x, (50, 0, 25, 100, 97)).tolist())


def test_prefix_sums(spark):
    rows = spark.createDataFrame([(i, i % 7) for i in range(500)], "i int, n int").repartition(4)
    found = {x.i: x.before for x in ranking.prefix_sums(rows, [], F.floor(F.col("i") / 64), ["i"], "n").collect()}
    assert found == {i: sum(k % 7 for k in range(i)) for i in range(500)}


def test_unusable_folds_of_a_configuration(spark):
    scored = spark.createDataFrame([(s, f, 0.5) for s in "ab" for f in (1, 2)], "stage string, fold int, score double")
    status = spark.createDataFrame([("a", 1, "insufficient"), ("a", 2, "ok"), ("b", 1, "ok")], "stage string, fold int, status string")
    found = {(x.stage, x.fold): (x.score, x.score_status) for x in logistic.with_unusable_folds(scored, status, "fold", ["stage"]).collect()}
    assert found == {("a", 1): (None, "insufficient_train_prototypes"), ("a", 2): (0.5, "ok"), ("b", 1): (0.5, "ok"), ("b", 2): (0.5, "ok")}
