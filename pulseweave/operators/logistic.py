"""L2-regularised logistic models of many (configuration, fold) cells at once, scored out of fold.

Cells are not groups of rows: a record trains every fold but its own, so a
cell's group would be nearly the whole table. Instead each Newton step is one
pass over the records, in which every task adds up its share of the gradients
and Hessians of all cells, whose size is fixed by the number of features.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import percentiles
from ..functions.scalar import finite
from ..functions.storage import written


def training_scales(rows: DataFrame, keys: Sequence[str], fold: str, features: Sequence[str], folds: Sequence[int]) -> DataFrame:
    """Median and sd of each feature over the training rows (all folds but one) of each cell; sd 1 where it is tiny, median 0 where all is missing."""
    keys = [*keys, "test_fold"]
    values = F.array(*[F.struct(F.lit(k).alias("k"), finite(f).alias("x")) for k, f in enumerate(features)])
    train = rows.withColumn("test_fold", F.explode(F.array(*[F.lit(f) for f in folds]))).filter(F.col(fold) != F.col("test_fold"))
    long = train.select(*keys, F.explode(values).alias("v")).select(*keys, "v.*")
    each = long.groupBy(*keys, "k").agg(F.stddev_samp("x").alias("sd")).join(percentiles(long, [*keys, "k"], "x", (0.5,)), [*keys, "k"], "left")
    sd, median = F.when(F.col("sd") >= 1e-8, F.col("sd")).otherwise(F.lit(1.0)), F.coalesce(F.col("percentiles")[0], F.lit(0.0))
    in_order = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", median.alias("median"), sd.alias("sd")))).alias("s"))
    return in_order.select(*keys, F.transform("s", lambda x: x["median"]).alias("medians"), F.transform("s", lambda x: x["sd"]).alias("sds"))


def missing_count(features: Sequence[str]) -> Column:
    """How many of the features are missing in a row."""
    return sum((finite(f).isNull().cast("int") for f in features), F.lit(0))


def _design(x: np.ndarray, medians: np.ndarray, sds: np.ndarray) -> np.ndarray:
    z = (x - medians) / sds
    return np.column_stack([np.ones(len(x)), np.where(np.isfinite(z), z, 0.0)])


def _odds(design: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))


def fold_scores(rows: DataFrame, keys: Sequence[str], fold: str, label: str, features: Sequence[str], folds: Sequence[int], most_steps: int = 25, tolerance: float = 1e-10) -> DataFrame:
    """``rows`` with score: the model of the row's own fold, which saw none of that fold's rows.

    Missing values become the training median (0 once scaled); the objective is
    mean log loss + 0.5 * |w|^2 without the intercept. Weights of all cells, a
    small table, stay on the driver between passes.
    """
    keys, d = list(keys), len(features) + 1
    scales = training_scales(rows, keys, fold, features, folds)
    cells = {tuple(r[k] for k in keys) + (r["test_fold"],): (np.array(r["medians"], float), np.array(r["sds"], float)) for r in scales.collect()}  # configurations x folds
    weights = {c: np.zeros(d) for c in cells}
    # read once for every step: what the rows come from is not computed again
    table = written(rows.select(*keys, F.col(fold).cast("int").alias("_fold"), F.col(label).cast("double").alias("_y"), F.array(*[finite(f) for f in features]).alias("_x")).filter(F.col("_y").isNotNull()), "design")
    tests = sorted(cells, key=str)

    def groups(batch: pa.RecordBatch):
        """(keys, folds, labels, features) of each configuration in a batch."""
        frame = [batch.column(k).to_pylist() for k in range(len(keys))]
        config = list(zip(*frame, strict=True)) if keys else [()] * batch.num_rows
        own, y = (batch.column(len(keys) + k).to_numpy(zero_copy_only=False) for k in (0, 1))
        x = np.array(batch.column(len(keys) + 2).to_pylist(), float).reshape(batch.num_rows, d - 1)
        for c in set(config):
            at = np.array([k == c for k in config])
            yield c, own[at], y[at], x[at]

    def sums(weights):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {c: np.zeros(1 + d + d * d) for c in tests}
            for batch in batches:
                for config, own, y, x in groups(batch):
                    for c in tests:
                        if c[:-1] == config and (train := own != c[-1]).any():
                            design = _design(x[train], *cells[c])
                            p = _odds(design, weights[c])
                            total[c] += np.concatenate([[train.sum()], design.T @ (p - y[train]), (design.T * (p * (1 - p)) @ design).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(tests))), pa.array([total[c].tolist() for c in tests], pa.list_(pa.float64()))], ["cell", "sums"])

        parts = table.mapInArrow(run, "cell long, sums array<double>").select("cell", F.posexplode("sums").alias("k", "v"))
        found = parts.groupBy("cell", "k").agg(F.sum("v").alias("v")).groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("s"))
        return {tests[r["cell"]]: np.array([x["v"] for x in r["s"]]) for r in found.collect()}  # a row per cell

    ridge = np.ones(d)
    ridge[0] = 0
    for _ in range(most_steps):
        largest = 0.0
        for c, s in sums(weights).items():
            if s[0] == 0:
                continue
            step = np.linalg.solve(s[1 + d :].reshape(d, d) / s[0] + np.diag(ridge) + 1e-12 * np.eye(d), s[1 : 1 + d] / s[0] + ridge * weights[c])
            weights[c] = weights[c] - step
            largest = max(largest, float(np.abs(step).max()))
        if largest < tolerance:
            break
    kept = list(rows.columns)
    scored = rows.withColumns({"_fold": F.col(fold).cast("int"), "_x": F.array(*[finite(f) for f in features])})
    config_at = [scored.columns.index(k) for k in keys]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            config = list(zip(*[batch.column(k).to_pylist() for k in config_at], strict=True)) if keys else [()] * batch.num_rows
            own = batch.column(len(kept)).to_pylist()
            x = np.array(batch.column(len(kept) + 1).to_pylist(), float).reshape(batch.num_rows, d - 1)
            out = np.full(batch.num_rows, np.nan)
            for c in tests:
                at = np.array([k == c[:-1] and f == c[-1] for k, f in zip(config, own, strict=True)], bool)
                if at.any():
                    out[at] = _odds(_design(x[at], *cells[c]), weights[c])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(out, from_pandas=True)], [*kept, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return scored.mapInArrow(score, f"{schema}, score double")


def with_unusable_folds(scored: DataFrame, template_status: DataFrame, fold: str, keys: Sequence[str] = ()) -> DataFrame:
    """Scores of folds whose templates are insufficient become null, with a status; ``keys`` name the configuration (stage, cohort, scheme) that a status is of."""
    on = [*keys, fold]
    bad = template_status.filter(F.col("status") != "ok").select(*on).distinct().withColumn("_bad", F.lit(True))
    out = scored.join(bad, on, "left")
    return out.select(*[c for c in scored.columns if c != "score"], F.when(F.col("_bad").isNull(), F.col("score")).alias("score"), F.when(F.col("_bad").isNull(), "ok").otherwise("insufficient_train_prototypes").alias("score_status"))


def completed(scored: DataFrame, records: DataFrame, template_status: DataFrame, keys: Sequence[str], fold: str, identity: str, seeds: Sequence[int], models: Sequence[str]) -> DataFrame:
    """``scored`` and, for folds without usable templates, a row with a null score for each record, seed and model that nobody scored.

    Such a fold may have been left out whole, so the expected rows come from ``records`` (the
    configuration's test records: ``keys``, identity, fold and whatever else a score carries) and the status; what is there already stays.
    A null identity is a record of its own. The status column says ``ok`` or ``insufficient_train_prototypes``.
    """
    on = [*keys, fold]
    marked = with_unusable_folds(scored, template_status, fold, keys)
    bad = template_status.filter(F.col("status") != "ok").select(*on).distinct()
    grid = records.join(bad, on).withColumn("seed", F.explode(F.array(*[F.lit(s).cast(scored.schema["seed"].dataType) for s in seeds]))).withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    have = [*on, identity, "seed", "model"]
    known = marked.select(*[F.col(c).alias(f"_{c}") for c in have])
    same = F.lit(True)
    for c in have:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    missing = grid.join(known, same, "left_anti").withColumns({"score": F.lit(None).cast("double"), "score_status": F.lit("insufficient_train_prototypes")})
    return marked.unionByName(missing.select(*[c for c in marked.columns if c in missing.columns]), allowMissingColumns=True)
