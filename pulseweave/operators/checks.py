"""Jobs that hold results against each other. Each returns the offending rows: none if all is well."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def compared(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, tolerance: float = 1e-12) -> DataFrame:
    """Rows by key with what differs: ``only_first``, ``only_second``, ``differs`` (numbers or arrays by largest difference) or nothing."""
    keys = list(keys)
    both = a.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_in_a")).join(b.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_in_b")), keys, "full_outer")
    if a.schema[value].dataType.typeName() == "array":
        gap = F.when(F.size("_a") == F.size("_b"), F.array_max(F.zip_with("_a", "_b", lambda x, y: F.abs(x - y)))).otherwise(F.lit(float("inf")))
    else:
        gap = F.abs(F.col("_a") - F.col("_b"))
    both = both.withColumn("difference", F.when(F.col("_a").eqNullSafe(F.col("_b")), F.lit(0.0)).otherwise(gap))
    what = F.when(F.col("_in_b").isNull(), "only_first").when(F.col("_in_a").isNull(), "only_second").when(F.coalesce(F.col("difference") > tolerance, F.lit(True)), "differs").otherwise("")
    return both.select(*keys, "difference", what.alias("what"))


def not_in(rows: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is unknown."""
    return rows.join(known.select(*keys), list(keys), "left_anti")


def own_fold_contributors(contributors: DataFrame, records: DataFrame, identity: str, fold: str, template_fold: str = "template_fold") -> DataFrame:
    """Contributors to the template of the very fold they belong to."""
    return contributors.join(records.select(identity, F.col(fold).alias("_fold")), identity).filter(F.col("_fold") == F.col(template_fold)).drop("_fold")


def overlap(train: DataFrame, test: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are in both."""
    return train.select(*keys).intersect(test.select(*keys))


def not_once(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that have other than one row."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows <> 1")


def uneven_sets(rows: DataFrame, keys: Sequence[str], variant: str, identity: str) -> DataFrame:
    """Records that some variant (model) of a group lacks, and how many variants have them."""
    variants = rows.groupBy(*keys).agg(F.countDistinct(variant).alias("variants"))
    have = rows.groupBy(*keys, identity).agg(F.countDistinct(variant).alias("have"))
    return have.join(variants, list(keys)).filter("have <> variants")


def outside(rows: DataFrame, column: str, allowed: Sequence) -> DataFrame:
    return rows.filter(~F.coalesce(F.col(column).isin(*allowed), F.lit(False)))


def seed_dependent(rows: DataFrame, keys: Sequence[str], value: str = "score") -> DataFrame:
    """Groups in which a value that should not depend on the seed does."""
    return rows.groupBy(*keys).agg(F.countDistinct(value).alias("values")).filter("values > 1")


def common_to_all(rows: DataFrame, ok: Column, identity: str, variant: str, variants: int) -> DataFrame:
    """Identifiers that succeeded in every variant (stage)."""
    return rows.filter(ok).groupBy(identity).agg(F.countDistinct(variant).alias("n")).filter(F.col("n") == variants).select(identity)


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one that the other lacks, repeats counted."""
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))


def union_all(*tables: DataFrame) -> DataFrame:
    """All rows, columns by name; what a table lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def distinct_ids(identity: str, *tables: DataFrame) -> DataFrame:
    return union_all(*[t.select(identity) for t in tables]).distinct()


def on_grid(wave: str | Column, bits: int = 20) -> Column:
    """An array's values rounded to multiples of 2**-bits: sums of such values are exact in any order, so results of two runs can be held to each other bit by bit."""
    x = (F.col(wave) if isinstance(wave, str) else wave).cast("array<double>")
    return F.transform(x, lambda v: F.round(v * float(1 << bits)) / float(1 << bits))


def digests(table: DataFrame, keys: Sequence[str], values: Sequence[str], digits: int = 9) -> DataFrame:
    """A row per group: rows, and two sums over hashes of its rows, which no order or partitioning changes. Repeated rows count; numbers are rounded to ``digits``; null, NaN and an empty array differ."""
    def plain(name: str) -> list[Column]:
        kind, c = table.schema[name].dataType.simpleString(), F.col(name)
        number = lambda v: F.round(v.cast("double"), digits) + 0.0
        if kind in ("float", "double"):
            return [c.isNull(), number(c)]
        if kind in ("array<float>", "array<double>"):
            return [c.isNull(), F.size(c), F.transform(c, lambda v: F.coalesce(number(v), F.lit(0.0))), F.transform(c, lambda v: v.isNull())]
        return [c.isNull(), c]

    parts = [p for v in values for p in plain(v)]
    wide = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(38,0)"))
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), wide(*parts).alias("digest_1"), wide(F.lit("second"), *reversed(parts)).alias("digest_2"))


def unchanged_groups(first: DataFrame, second: DataFrame, keys: Sequence[str], values: Sequence[str], digits: int = 9) -> DataFrame:
    """A row per group of either table: rows in both, and whether they are the same rows, repeats counted. Only digests meet, never the rows."""
    both = digests(first, keys, values, digits).withColumn("_side", F.lit(1)).unionByName(digests(second, keys, values, digits).withColumn("_side", F.lit(2)))
    side = lambda k: F.sum(F.when(F.col("_side") == k, F.col("rows")).otherwise(0))
    same = (F.count(F.lit(1)) == 2) & (F.min("rows") == F.max("rows"))
    for d in ("digest_1", "digest_2"):
        same = same & (F.min(d) == F.max(d))
    return both.groupBy(*keys).agg(side(1).alias("rows_first"), side(2).alias("rows_second"), same.alias("unchanged"))


def differing_metrics(stored: DataFrame, recomputed: DataFrame, keys: Sequence[str], exact: Sequence[str] = ("evaluated",), close: Sequence[str] = ("auroc", "balanced_accuracy"), relative: float = 1e-5, absolute: float = 1e-8) -> DataFrame:
    """A row per group of either table with what is wrong with the stored metrics, empty if nothing: ``not_stored``, ``not_recomputed``, or the first column that differs.

    ``exact`` columns must be equal, ``close`` ones within ``absolute`` + ``relative`` x the recomputed value; null equals null only. Tables of metrics are small: a row per group.
    """
    columns = [*exact, *close]
    side = lambda t, name: t.select(*[F.col(k).alias(f"{name}{i}") for i, k in enumerate(keys)], F.struct(*columns).alias(name))
    on = F.lit(True)
    for i in range(len(keys)):
        on = on & F.col(f"_s{i}").eqNullSafe(F.col(f"_r{i}"))
    both = side(stored, "_s").join(side(recomputed, "_r"), on, "full_outer")
    what = F.when(F.col("_s").isNull(), "not_stored").when(F.col("_r").isNull(), "not_recomputed")
    for c in columns:
        a, b = F.col(f"_s.{c}"), F.col(f"_r.{c}")
        off = ~a.eqNullSafe(b) if c in exact else (a.isNull() != b.isNull()) | F.coalesce(F.abs(a - b) > absolute + relative * F.abs(b), F.lit(False))
        what = what.when(off, c)
    return both.select(*[F.coalesce(f"_s{i}", f"_r{i}").alias(k) for i, k in enumerate(keys)], what.otherwise("").alias("what"))


def flipped(rows: DataFrame, label: str, fold: str, folds: Sequence[int], flip: bool = True, held: str = "held_fold") -> DataFrame:
    """``rows`` once per held-out fold; with ``flip``, the labels (0 or 1) of that fold's rows are the other way round."""
    out = rows.withColumn(held, F.explode(F.array(*[F.lit(f) for f in folds])))
    own = F.col(fold) == F.col(held)
    return out.withColumn(label, F.when(own & F.lit(flip), 1 - F.col(label)).otherwise(F.col(label)))


def label_invariance(run: Callable[[DataFrame], dict[str, DataFrame]], rows: DataFrame, label: str, fold: str, folds: Sequence[int], values: dict[str, Sequence[str]], digits: int = 9, held: str = "held_fold") -> DataFrame:
    """Whether what a run makes of each held-out fold stays the same when that fold's labels are turned round: a row per table and fold.

    ``run`` gets the rows once per held-out fold and returns named tables that have the column ``held``; ``values`` are the columns of each that must not change. A run that lets a
    fold's labels into its own templates, features or predictions shows up as unchanged = false.
    """
    keys = [held]
    before, after = run(flipped(rows, label, fold, folds, False, held)), run(flipped(rows, label, fold, folds, True, held))
    found = [unchanged_groups(before[t], after[t], keys, values[t], digits).select(F.lit(t).alias("table"), *keys, "rows_first", "rows_second", "unchanged") for t in before]
    return union_all(*found)


class FaultsFound(ValueError):
    """A table that was to be written breaks rules; ``faults`` says which and how often."""

    def __init__(self, faults: dict[str, int]):
        super().__init__(", ".join(f"{rule}: {n}" for rule, n in faults.items()))
        self.faults = faults


def write_checked(df: DataFrame, path: str, rules: dict[str, Column], totals: dict[str, Column] | None = None, stop: bool = False) -> dict[str, int]:
    """Write ``df`` to ``path/data`` and check it on the way, without another scan; returns rows and faults by rule.

    ``rules`` are columns that are true for a faulty row (null counts as faulty), ``totals`` aggregates that are above 0 if the whole table is at fault. All are
    observed as rows are written. With ``stop``, the first faulty row ends the job by the name of its rule instead.
    A table is published by ``path/checks``, which is written only if nothing was found; ``read_checked`` refuses any other.
    """
    bad = {name: F.coalesce(c, F.lit(True)) for name, c in rules.items()}
    if stop:
        fault = F.lit(None).cast("string")
        for name, c in bad.items():
            fault = F.when(fault.isNull() & c, F.lit(f"fault: {name}")).otherwise(fault)
        df = df.filter(F.when(fault.isNull(), True).otherwise(F.raise_error(fault).cast("boolean")))
    seen = Observation()
    sums = [F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name) for name, c in bad.items()] + [F.coalesce(c.cast("long"), F.lit(0)).alias(name) for name, c in (totals or {}).items()]
    try:
        df.observe(seen, F.count(F.lit(1)).alias("rows"), *sums).write.mode("errorifexists").parquet(f"{path}/data")
    except Exception as e:
        named = re.search(r"fault: ([^\n\"']+)", str(e))
        if not (stop and named):
            raise
        raise FaultsFound({named[1].split(" SQLSTATE")[0].rstrip(". "): 1}) from e
    found = seen.get
    if faults := {name: n for name, n in found.items() if name != "rows" and n}:
        raise FaultsFound(faults)
    df.sparkSession.createDataFrame([(name, int(n)) for name, n in found.items()], "rule string, n long").write.mode("errorifexists").parquet(f"{path}/checks")
    return dict(found)


def read_checked(spark: SparkSession, path: str) -> DataFrame:
    """A table that was written without a fault."""
    try:
        spark.read.parquet(f"{path}/checks")
    except AnalysisException as e:
        raise FaultsFound({"not checked": 1}) from e
    return spark.read.parquet(f"{path}/data")
