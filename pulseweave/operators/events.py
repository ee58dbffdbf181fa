"""Ordered events of entities: intervals, validity, adjacent pairs, runs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import let
from .statistics import iqr


#: Reasons why an event is not valid, in the order in which they are looked for.
EDGE, NEIGHBOUR, ARTIFACT, FEW = "edge_no_two_neighbors", "neighbor_rr_out_of_range", "gross_artifact_gt20mV", "insufficient_internal_beats"


def by(keys: Sequence[str], *order) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def intervals(rows: DataFrame, keys: Sequence[str], order: Sequence[str], at: str, per_ms: float) -> DataFrame:
    """``rows`` with source_index (from 0), midpoints to the neighbours and intervals to them in ms; null at the edges."""
    w = by(keys, *order)
    before, after = F.lag(at).over(w), F.lead(at).over(w)
    return rows.withColumns(
        {
            "source_index": F.row_number().over(w) - 1,
            "left_at": (before + F.col(at)) / 2,
            "right_at": (F.col(at) + after) / 2,
            "rr_prev_ms": (F.col(at) - before) / F.lit(per_ms),
            "rr_next_ms": (after - F.col(at)) / F.lit(per_ms),
        }
    )


def record_gate(rows: DataFrame, keys: Sequence[str], low: float, high: float, least_peaks: int = 5, least_share: float = 0.75) -> DataFrame:
    """A row per record: peaks, share of intervals within [low, high] ms, and the code of what the record fails, empty if nothing."""
    inside = F.col("rr_next_ms").between(low, high).cast("double")
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("peaks"), F.avg(inside).alias("rr_share"))
    return found.withColumn("gate", gate_of(F.col("peaks"), F.col("rr_share"), least_peaks, least_share))


def gate_of(peaks: Column, share: Column, least_peaks: int = 5, least_share: float = 0.75) -> Column:
    return F.when(peaks < least_peaks, "insufficient_peaks").when(F.coalesce(share, F.lit(0.0)) < least_share, "rr_out_of_range").otherwise("")


def validity(rows: DataFrame, keys: Sequence[str], low: float, high: float, too_large: Column, least_valid: int = 3) -> DataFrame:
    """``rows`` (with intervals) with valid, failure_reason (the first that holds) and beat_index, dense over the valid ones and -1 elsewhere.

    A record with fewer than ``least_valid`` valid events fails as a whole: these carry the record's reason.
    The gate of ``record_gate`` is taken over a window, so that intervals, gate and index share one exchange.
    """
    out = ~F.col("rr_prev_ms").between(low, high) | ~F.col("rr_next_ms").between(low, high)
    own = (
        F.when(F.col("rr_prev_ms").isNull() | F.col("rr_next_ms").isNull(), EDGE)
        .when(F.col("gate") != "", F.col("gate"))
        .when(out, NEIGHBOUR)
        .when(too_large, ARTIFACT)
        .otherwise("")
    )
    record = Window.partitionBy(*keys)
    gate = gate_of(F.count(F.lit(1)).over(record), F.avg(F.col("rr_next_ms").between(low, high).cast("double")).over(record))
    rows = rows.withColumn("gate", gate).withColumn("failure_reason", own).drop("gate")
    few = F.sum((F.col("failure_reason") == "").cast("int")).over(Window.partitionBy(*keys)) < least_valid
    rows = rows.withColumn("failure_reason", F.when((F.col("failure_reason") == "") & few, FEW).otherwise(F.col("failure_reason")))
    rows = rows.withColumn("valid", F.col("failure_reason") == "")
    upto = by(keys, "source_index").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("beat_index", F.when(F.col("valid"), F.sum(F.col("valid").cast("int")).over(upto) - 1).otherwise(-1))


def adjacent(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The valid events with next_source and edge: whether the next valid one is the next event, null for the last."""
    nxt = F.lead("source_index").over(by(keys, "beat_index"))
    return events.filter("valid").withColumn("next_source", nxt).withColumn("edge", nxt - F.col("source_index") == 1)


def gaps(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Neighbouring valid events with invalid ones between them."""
    return adjacent(events, keys).filter(~F.col("edge")).select(*keys, F.col("source_index").alias("before"), F.col("next_source").alias("after"), (F.col("next_source") - F.col("source_index") - 1).alias("missing"))


def steps(rows: DataFrame, keys: Sequence[str], position: str, values: Sequence[str], edge: str = "edge") -> DataFrame:
    """Absolute differences to the next position, null where ``edge`` does not hold."""
    w = by(keys, position)
    return rows.withColumns({v: F.when(F.col(edge), F.abs(F.lead(v).over(w) - F.col(v))) for v in values})


def rr_summary(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count, median, cv (sd by median), RMSSD, MAD and IQR of the intervals; cv and RMSSD null for fewer than two."""
    keys = list(keys)
    rr = events.filter(F.col("rr_next_ms").isNotNull())
    rr = rr.withColumns({"_step": F.lead("rr_next_ms").over(by(keys, "source_index")) - F.col("rr_next_ms"), "_off": F.abs(F.col("rr_next_ms") - F.percentile("rr_next_ms", F.lit(0.5)).over(Window.partitionBy(*keys)))})
    n, median = F.count("rr_next_ms"), F.percentile("rr_next_ms", F.lit(0.5))
    return rr.groupBy(*keys).agg(
        n.alias("rr_count"), median.alias("rr_median_ms"), F.when(n >= 2, F.stddev_samp("rr_next_ms") / median).alias("rr_cv"), F.when(n >= 2, F.sqrt(F.avg(F.col("_step") * F.col("_step")))).alias("rmssd_ms"),
        F.percentile("_off", F.lit(0.5)).alias("rr_mad_ms"), iqr("rr_next_ms").alias("rr_iqr_ms"),
    )


def pieces(rows: DataFrame, keys: Sequence[str], order: Sequence[str], at: str, most_gap: float, width: float, name: str = "piece") -> DataFrame:
    """``rows`` with a number per stretch of time that is cut where the next row of its record comes more than ``most_gap`` later.

    Time goes into buckets of ``width`` (a multiple of ``most_gap``). Inside of a bucket rows only meet each
    other; between buckets only the last place of each is needed, a row per
    record and bucket. Rows before a bucket's first cut belong to the last bucket
    before that has one. No window or group holds a whole record: a piece is a bucket
    and what runs on from it without a gap. Rows without a place come last, in a piece of their own.
    """
    keys, spot = list(keys), F.col(at).cast("double")
    rows = rows.withColumn("_slot", F.floor(spot / width))
    slots = rows.groupBy(*keys, "_slot").agg(F.max(spot).alias("_last"))
    slots = slots.withColumn("_before", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_slot"))).drop("_last")
    inside = Window.partitionBy(*keys, "_slot").orderBy(*order)
    joined = rows.join(slots.withColumnsRenamed({k: f"_k_{k}" for k in keys}).withColumnRenamed("_slot", "_s"), _same(keys, "_slot", "_s"), "left").drop("_s", *[f"_k_{k}" for k in keys])
    cut = spot - F.coalesce(F.lag(spot).over(inside), F.col("_before")) > most_gap
    joined = joined.withColumn("_cut", F.coalesce(cut, F.lit(True)).cast("int"))
    joined = joined.withColumn("_cuts", F.sum("_cut").over(inside))
    # the last bucket with a cut, up to each bucket: again a row per record and bucket
    starts = joined.groupBy(*keys, "_slot").agg(F.max("_cut").alias("_any"))
    known = F.last(F.when(F.col("_any") == 1, F.col("_slot")), ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.withColumn("_from", known).drop("_any").withColumnsRenamed({k: f"_k_{k}" for k in keys}).withColumnRenamed("_slot", "_s")
    out = joined.join(starts, _same(keys, "_slot", "_s"), "left")
    return out.withColumn(name, F.when(F.col("_cuts") > 0, F.col("_slot")).otherwise(F.col("_from"))).select(*[c for c in rows.columns if c != "_slot"], name)


def _same(keys: Sequence[str], slot: str, other: str) -> Column:
    on = F.col(slot).eqNullSafe(F.col(other))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return on


def repair(rows: DataFrame, keys: Sequence[str], order: Sequence[str], at: str, amp: str, slope: str, low: float = 0.20, high: float = 0.40, least_amp: float = 0.45, least_slope: float = 0.50, rate: float = 500.0, buckets: int = 64) -> DataFrame:
    """The rows that are kept: one is dropped if it follows the last *kept* one of its record within [low, high] s and is weaker than given parts of it in both respects.

    ``order`` is ascending in ``at``. A lag over ``high`` forgets what was kept, so records are cut there (``pieces``, buckets of ``buckets`` x ``high``) and pieces are
    folded in any task, sorted, with the last kept row as the only state: a record of any length is shared by as many tasks as it has
    buckets. Only a stretch without any such lag stays together. Rows without a place, height or slope are kept; one without a place is nobody's last kept row.
    """
    keys = list(keys)
    (piece,) = [next(n for k in range(len(rows.columns) + 1) if (n := "piece" + "_" * k) not in rows.columns)]
    state = [*keys, piece, at, amp, slope]
    n = len(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record = last = None
        for batch in batches:
            keep = []
            for *own, place, height, steep in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in state), strict=True):
                weak = False
                if own == record and None not in (place, height, steep, *last):
                    weak = low <= (place - last[0]) / rate <= high and height < least_amp * last[1] and steep < least_slope * last[2]
                if not weak:
                    record, last = own, (place, height, steep)
                keep.append(not weak)
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns[:n], kept.schema.names[:n])

    cut = pieces(rows, keys, order, at, high * rate, high * rate * buckets, piece)
    return cut.repartition(*keys, piece).sortWithinPartitions(*keys, piece, *order).mapInArrow(run, rows.schema)


def repaired(peaks: Column, at: str, amp: str, slope: str, low: float = 0.20, high: float = 0.40, least_amp: float = 0.45, least_slope: float = 0.50, rate: float = 500.0) -> Column:
    """``repair`` of a record that is bounded and lies in one row, its events an array in order: the same fold without any exchange."""

    def step(kept: Column, new: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        weak = ((new[at] - last[at]) / F.lit(rate)).between(low, high) & (new[amp] < F.lit(least_amp) * last[amp]) & (new[slope] < F.lit(least_slope) * last[slope])
        return F.when(weak, kept).otherwise(F.concat(kept, F.array(new)))

    return F.aggregate(peaks, F.slice(peaks, 1, 0), step)


def valid_events(peaks: Column, at: str, per_ms: float, low: float, high: float, least_valid: int = 3) -> Column:
    """The valid events of such a record, as ``intervals`` and ``validity`` tell them where nothing is too large: an array of source_index, left_at, ``at`` and right_at, empty if the record fails as a whole."""

    def event(own: Column, k: Column, all_: Column) -> Column:
        place, before, after = own[at], F.get(all_, k - 1)[at], F.get(all_, k + 1)[at]
        return F.struct(k.alias("source_index"), ((before + place) / 2).alias("left_at"), place.alias(at), ((place + after) / 2).alias("right_at"), ((place - before) / F.lit(per_ms)).alias("rr_prev_ms"), ((after - place) / F.lit(per_ms)).alias("rr_next_ms"))

    def valid(found: Column) -> Column:
        next_in = F.size(F.filter(found, lambda e: e["rr_next_ms"].between(low, high)))
        share = next_in / F.nullif(F.size(F.filter(found, lambda e: e["rr_next_ms"].isNotNull())), F.lit(0))
        inside = F.filter(found, lambda e: e["rr_prev_ms"].between(low, high) & e["rr_next_ms"].between(low, high))
        passed = (gate_of(F.size(found), share) == "") & (F.size(inside) >= least_valid)
        return F.transform(F.filter(inside, lambda _: passed), lambda e: F.struct(*[e[c].alias(c) for c in ("source_index", "left_at", at, "right_at")]))

    return let(let(peaks, lambda p: F.transform(p, lambda own, k: event(own, k, p))), valid)


def runs(rows: DataFrame, keys: Sequence[str], order: Sequence[str], condition: Column) -> DataFrame:
    """A row per maximal run of rows for which ``condition`` holds: first and last place and length (gaps and islands)."""
    w = by(keys, *order)
    rows = rows.withColumns({"_at": F.row_number().over(w) - 1, "_on": F.coalesce(condition, F.lit(False))})
    rows = rows.filter("_on").withColumn("_island", F.col("_at") - F.row_number().over(by(keys, "_at")))
    return rows.groupBy(*keys, "_island").agg(F.min("_at").alias("first"), F.max("_at").alias("last"), F.count(F.lit(1)).alias("length")).drop("_island")


def longest_run(rows: DataFrame, keys: Sequence[str], order: Sequence[str], condition: Column) -> DataFrame:
    """A row per group, also for those without a run."""
    found = runs(rows, keys, order, condition).groupBy(*keys).agg(F.max("length").alias("longest"), F.count(F.lit(1)).alias("runs"))
    return rows.select(*keys).distinct().join(found, list(keys), "left").fillna(0, ["longest", "runs"])


def plateau_share(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, least: int = 5) -> DataFrame:
    """Share of rows at the exact minimum or maximum of their group in runs of at least ``least`` equal values."""
    group = Window.partitionBy(*keys)
    rows = rows.withColumns({"_low": F.min(value).over(group), "_high": F.max(value).over(group)})
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    low = runs(rows, keys, order, F.col(value) == F.col("_low"))
    high = runs(rows, keys, order, (F.col(value) == F.col("_high")) & (F.col("_high") > F.col("_low")))
    held = low.unionByName(high).filter(F.col("length") >= least).groupBy(*keys).agg(F.sum("length").alias("held"))
    return sizes.join(held, list(keys), "left").select(*keys, "n", (F.coalesce("held", F.lit(0)) / F.col("n")).alias("share"))


def record_summary(manifest: DataFrame, events: DataFrame, keys: Sequence[str], value: str, removed: DataFrame | None = None, spread: DataFrame | None = None) -> DataFrame:
    """A row per record of ``manifest``, also for those without events: peaks, valid ones, adjacent pairs, interval and value statistics.

    ``removed``: rows of the candidates that repair dropped, counted as removed_candidates; ``spread``: rows per lead with vh, of which the largest is vh_max.
    """
    keys = list(keys)
    valid = F.col("valid")
    nxt = F.when(valid, F.lead("source_index").over(by([*keys, "valid"], "source_index")))
    events = events.withColumn("_edge", nxt - F.col("source_index") == 1)
    found = events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("peaks"), F.sum(valid.cast("int")).alias("valid_beats"), F.sum(F.coalesce(F.col("_edge"), F.lit(False)).cast("int")).alias("pairs"), F.percentile(F.when(valid, F.col("rr_next_ms")), F.lit(0.5)).alias("rr_median_ms"),
        F.avg(F.when(valid, F.col(value))).alias("value_mean"), F.max(F.when(valid, F.col(value))).alias("value_max"),
    )
    out = manifest.join(found, keys, "left").fillna(0, ["peaks", "valid_beats", "pairs"])
    if removed is not None:
        out = out.join(removed.groupBy(*keys).agg(F.count(F.lit(1)).alias("removed_candidates")), keys, "left").fillna(0, ["removed_candidates"])
    return out if spread is None else out.join(spread.groupBy(*keys).agg(F.max("vh").alias("vh_max")), keys, "left")


def coverage(summary: DataFrame, by_columns: Sequence[str], least_valid: int = 3) -> DataFrame:
    """Records, successes and valid events per group."""
    return summary.groupBy(*by_columns).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("valid_beats") >= least_valid).cast("int")).alias("successes"), F.sum("valid_beats").alias("beats"))
