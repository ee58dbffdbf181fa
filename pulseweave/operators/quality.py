"""Signal quality of leads and records: amplitude, flat parts, jumps, lead consistency, threshold grids.

Arrays stay arrays: a lead's samples are folded in place by SQL's array
functions, and only runs are made rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import percentiles
from ..functions.scalar import let
from .templates import array_quantile

#: Limits of flags.
FLAT_MV, LOW_AMPLITUDE_MV, FLAT_SHARE = 0.001, 0.02, 0.20
GRID_MV = (0.0005, 0.001, 0.002, 0.005)


def differences(wave: str | Column) -> Column:
    """Absolute steps of an array."""
    x = F.col(wave) if isinstance(wave, str) else wave
    return F.zip_with(F.slice(x, 2, F.size(x) - 1), F.slice(x, 1, F.size(x) - 1), lambda a, b: F.abs(a - b))


def share(array: Column, hit) -> Column:
    return F.when(F.size(array) > 0, F.size(F.filter(array, hit)) / F.size(array)).otherwise(F.lit(0.0))


def longest(array: Column, hit) -> Column:
    """Length of the longest run of values for which ``hit`` holds."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(a, x):
        now = F.when(hit(x), a["now"] + 1).otherwise(F.lit(0))
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    return F.aggregate(array, start, step, lambda a: a["most"])


def plateau(array: Column, bound: Column, least: int = 5) -> Column:
    """Number of values equal to ``bound`` in runs of at least ``least``."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("held"))

    def step(a, x):
        now = F.when(x == bound, a["now"] + 1).otherwise(F.lit(0))
        more = F.when(now == least, F.lit(least)).when(now > least, F.lit(1)).otherwise(F.lit(0))
        return F.struct(now.alias("now"), (a["held"] + more).alias("held"))

    return F.aggregate(array, start, step, lambda a: a["held"])


def most_equal(ordered: Column) -> Column:
    """How often the most frequent value of a sorted array occurs."""
    start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(a, v):
        return let(F.when(v == a["last"], a["now"] + 1).otherwise(1), lambda now: F.struct(v.alias("last"), now.alias("now"), F.greatest(a["most"], now).alias("most")))

    return F.aggregate(ordered, start, step, lambda a: a["most"])


def lead_quality(leads: DataFrame, wave: str, flat: float = FLAT_MV) -> DataFrame:
    """Per lead: 1-99 % range, flat share, share in plateaus at the bounds, share of abrupt jumps (over median + 10 MAD), longest flat run, mode share, median and 95 % step, and the flat flag."""
    def measured(v: Column) -> Column:
        """Everything of one lead; v has the samples x, the steps d and both sorted."""
        x, d, xs, ds = (v[n] for n in ("x", "d", "xs", "ds"))
        low, high, size = F.element_at(xs, 1), F.element_at(xs, -1), F.size(x)
        return let(
            array_quantile(ds, 0.5),
            lambda median: let(
                array_quantile(F.array_sort(F.transform(d, lambda e: F.abs(e - median))), 0.5),
                lambda mad: F.struct(
                    (array_quantile(xs, 0.99) - array_quantile(xs, 0.01)).alias("amplitude_range"),
                    share(d, lambda e: e < flat).alias("flat_share"),
                    ((plateau(x, low) + F.when(high > low, plateau(x, high)).otherwise(0)) / size).alias("plateau_share"),
                    share(d, lambda e: e > median + 10 * mad).alias("jump_share"),
                    longest(d, lambda e: e < flat).alias("longest_flat"),
                    (most_equal(xs) / size).alias("mode_share"),
                    median.alias("median_step"),
                    array_quantile(ds, 0.95).alias("p95_step"),
                ),
            ),
        )

    def sorted_too(v: Column) -> Column:
        return F.struct(v["x"].alias("x"), v["d"].alias("d"), F.array_sort(v["x"]).alias("xs"), F.array_sort(v["d"]).alias("ds"))

    samples = let(F.col(wave).cast("array<double>"), lambda x: F.struct(x.alias("x"), differences(x).alias("d")))
    found = leads.withColumn("_q", let(let(samples, sorted_too), measured))
    return found.select(*[c for c in leads.columns if c != wave], "_q.*").withColumn("flat_flag", F.col("flat_share") > FLAT_SHARE)


def record_quality(leads: DataFrame, keys: Sequence[str], repeated: DataFrame | None = None, expected_leads: int | None = None) -> DataFrame:
    """Per record: flags, and medians and maxima over leads. ``repeated``: pairs of near-identical leads."""
    found = leads.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("leads"), F.bool_or(F.col("amplitude_range") < LOW_AMPLITUDE_MV).alias("low_amplitude"), F.bool_or("flat_flag").alias("flatline"), F.percentile("amplitude_range", F.lit(0.5)).alias("amplitude_median"), F.percentile("flat_share", F.lit(0.5)).alias("flat_median"), F.max("flat_share").alias("flat_max"), F.max("jump_share").alias("jump_max"),
    )
    if repeated is not None:
        pairs = repeated.groupBy(*keys).agg(F.count(F.lit(1)).alias("repeated_pairs"))
        found = found.join(pairs, list(keys), "left").withColumn("repeated_pairs", F.coalesce("repeated_pairs", F.lit(0)))
    return found if expected_leads is None else found.withColumn("complete", F.col("leads") == expected_leads)


def quality_status(records: DataFrame, read_ok: str = "read_ok", code: str = "failure_code", has_signal: str = "has_signal") -> DataFrame:
    """ok, code and flags of a record whose signal could not be read; a reader that claims success without a signal is at fault itself."""
    fault = F.when(~F.col(read_ok), F.coalesce(F.nullif(F.col(code), F.lit("")), F.lit("read_failure"))).when(~F.col(has_signal), "reader_result_invalid")
    return records.withColumns({"quality_ok": fault.isNull(), "quality_code": F.coalesce(fault, F.lit("")), "quality_flags": F.when(fault.isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(F.array(F.lit("read_failure"), fault)))})


def limb_residuals(records: DataFrame, keys: Sequence[str], lead: dict[str, str]) -> DataFrame:
    """Mean, RMSE and RMSE by median 1-99 % range of the four relations that limb leads obey; ``lead`` names the array column of each lead."""
    c = {name: F.col(column).cast("array<double>") for name, column in lead.items()}
    two = lambda a, b, f: F.zip_with(a, b, f)
    i, ii = c["I"], c["II"]
    rest = {
        "einthoven": two(two(ii, i, lambda a, b: a - b), c["III"], lambda d, e: d - e),
        "aVR": two(c["aVR"], two(i, ii, lambda a, b: (a + b) / 2), lambda x, y: x + y),
        "aVL": two(c["aVL"], two(i, ii, lambda a, b: a - b / 2), lambda x, y: x - y),
        "aVF": two(c["aVF"], two(i, ii, lambda a, b: b - a / 2), lambda x, y: x - y),
    }
    reach = lambda x: let(F.array_sort(x), lambda s: array_quantile(s, 0.99) - array_quantile(s, 0.01))
    scale = F.greatest(let(F.array_sort(F.array(*[reach(x) for x in c.values()])), lambda s: array_quantile(s, 0.5)), F.lit(1e-6))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    rows = records.select(*keys, scale.alias("_scale"), F.explode(F.array(*[F.struct(F.lit(n).alias("relation"), r.alias("r")) for n, r in rest.items()])).alias("_p")).select(*keys, "_scale", "_p.*")
    rmse = F.sqrt(total(F.transform("r", lambda v: v * v)) / F.size("r"))
    return rows.select(*keys, "relation", (total(F.col("r")) / F.size("r")).alias("residual_mean"), rmse.alias("rmse"), (rmse / F.col("_scale")).alias("relative_rmse"))


def correlation(a: str, b: str) -> Column:
    """Pearson correlation of two arrays in one pass; null if one is constant."""
    names = ("n", "x", "y", "xx", "yy", "xy")
    start = F.struct(*[F.lit(0.0).alias(n) for n in names])
    pairs = F.arrays_zip(F.col(a).cast("array<double>").alias("a"), F.col(b).cast("array<double>").alias("b"))

    def step(s, p):
        more = {"n": F.lit(1.0), "x": p["a"], "y": p["b"], "xx": p["a"] * p["a"], "yy": p["b"] * p["b"], "xy": p["a"] * p["b"]}
        return F.struct(*[(s[n] + more[n]).alias(n) for n in names])

    spread = lambda s: (s["n"] * s["xx"] - s["x"] * s["x"]) * (s["n"] * s["yy"] - s["y"] * s["y"])
    return F.aggregate(pairs, start, step, lambda s: F.when(spread(s) > 0, (s["n"] * s["xy"] - s["x"] * s["y"]) / F.sqrt(spread(s))))


def correlated_pairs(leads: DataFrame, keys: Sequence[str], lead: str, wave: str, least: float = 0.995) -> DataFrame:
    """Pairs of a record's leads with |corr| over ``least``. A record has a fixed number of leads (12), so the self-join is linear in records."""
    one, other = leads.select(*keys, lead, F.col(wave).alias("_u")), leads.select(*keys, F.col(lead).alias(f"other_{lead}"), F.col(wave).alias("_v"))
    found = one.join(other, list(keys)).filter(F.col(lead) < F.col(f"other_{lead}")).withColumn("corr", correlation("_u", "_v"))
    return found.filter(F.abs("corr") > least).drop("_u", "_v")


def excluded(size: Column, peaks: Column, radius: int = 50) -> Column:
    """Array of 0 and 1: whether index d of 0 .. size - 1 lies within ``radius`` of a peak. The interval join walks the sorted peaks once: each adds the zeros before its interval and the ones that no earlier interval has."""
    inside = lambda x: F.least(F.greatest(x, F.lit(0)), size)

    def filled(at: Column) -> Column:
        def part(p: Column, k: Column) -> Column:
            done = F.coalesce(inside(F.get(at, k - 1) + radius + 1), F.lit(0))
            start, end = F.greatest(inside(p - radius), done), F.greatest(inside(p + radius + 1), done)
            return F.concat(F.array_repeat(F.lit(0), start - done), F.array_repeat(F.lit(1), end - start))

        return let(F.flatten(F.transform(at, part)), lambda x: F.concat(x, F.array_repeat(F.lit(0), size - F.size(x))))

    return let(F.array_sort(F.array_compact(peaks)), filled)


def with_peaks(leads: DataFrame, peaks: DataFrame, keys: Sequence[str], at: str, radius: int, wave: str, name: str = "inside") -> DataFrame:
    """``leads`` with an array of 0 and 1 over the steps of their wave: whether a step lies within ``radius`` of a peak of its record. A record has at most as many peaks as samples, which its leads hold as an array anyway; records without peaks have zeros."""
    found = peaks.filter(F.col(at).isNotNull()).groupBy(*keys).agg(F.collect_set(F.col(at).cast("int")).alias("_peaks"))
    inside = excluded(F.size(wave) - 1, F.coalesce("_peaks", F.array().cast("array<int>")), radius)
    return leads.join(found, list(keys), "left").withColumn(name, inside).drop("_peaks")


def tops(wave: str | Column, least: float) -> Column:
    """Places (from 0) of samples over ``least`` that are higher than the one before and not lower than the one behind."""
    x = F.col(wave) if isinstance(wave, str) else wave
    top = lambda k: (F.get(x, k) > least) & (F.get(x, k) > F.get(x, k - 1)) & (F.get(x, k) >= F.get(x, k + 1))
    return F.when(F.size(x) >= 3, F.filter(F.sequence(F.lit(1), F.size(x) - 2), top)).otherwise(F.array().cast("array<int>"))


def threshold_grid(leads: DataFrame, wave: str, thresholds: Sequence[float] = GRID_MV, rate: float = 500.0, inside: Column | None = None) -> DataFrame:
    """A row per lead and threshold: low share, flag, longest low and longest exactly repeated run (s), exact share, and the low share outside of ``inside`` (array of 0 and 1). Steps are made once and crossed with the grid."""
    x = leads.withColumn("_d", differences(F.col(wave).cast("array<double>")))
    free = F.lit(None).cast("array<double>") if inside is None else F.filter(F.zip_with("_d", inside, lambda d, m: F.when(m == 0, d)), lambda d: d.isNotNull())
    x = x.withColumns({"_free": free, "longest_exact_s": longest(F.col("_d"), lambda d: d == 0) / F.lit(rate), "exact_share": share(F.col("_d"), lambda d: d == 0)})
    x = x.withColumn("threshold_mv", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    low = share(F.col("_d"), lambda d: d < F.col("threshold_mv"))
    outside = F.when(F.col("_free").isNotNull(), share(F.col("_free"), lambda d: d < F.col("threshold_mv")))
    return x.withColumns({"low_share": low, "longest_low_s": longest(F.col("_d"), lambda d: d < F.col("threshold_mv")) / F.lit(rate), "outside_share": outside}).withColumn("flag", F.col("low_share") > FLAT_SHARE).drop("_d", "_free", wave)


def saturation(grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of records with any flagged lead, per threshold."""
    per = grid.groupBy(*keys, "threshold_mv").agg(F.bool_or("flag").alias("any_flag"))
    return per.groupBy("threshold_mv").agg(F.count(F.lit(1)).alias("records"), F.avg(F.col("any_flag").cast("double")).alias("flag_rate"))


def lead_summary(grid: DataFrame, lead: str) -> DataFrame:
    """Flag rate, medians and maximum per lead and threshold."""
    keys = [lead, "threshold_mv"]
    out = grid.groupBy(*keys).agg(F.avg(F.col("flag").cast("double")).alias("flag_rate"), F.max("low_share").alias("low_max"))
    for value, name in (("low_share", "low_median"), ("longest_low_s", "longest_median")):
        out = out.join(percentiles(grid, keys, value, (0.5,)).select(*keys, F.col("percentiles")[0].alias(name)), keys, "left")
    return out


def flat_records(grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per record and threshold: any lead flagged, and the largest and median share over leads."""
    return grid.groupBy(*keys, "threshold_mv").agg(F.bool_or("flag").alias("any_flag"), F.max("low_share").alias("max_share"), F.percentile("low_share", F.lit(0.5)).alias("median_share"))


def flat_thresholds(records: DataFrame) -> DataFrame:
    """Per threshold: flag rate, and median and quartiles of the largest share."""
    rates = records.groupBy("threshold_mv").agg(F.avg(F.col("any_flag").cast("double")).alias("flag_rate"))
    found = percentiles(records, ["threshold_mv"], "max_share", (0.5, 0.25, 0.75))
    return rates.join(found, "threshold_mv", "left").select("threshold_mv", "flag_rate", *[F.col("percentiles")[k].alias(f"max_{n}") for k, n in enumerate(("median", "q25", "q75"))])
