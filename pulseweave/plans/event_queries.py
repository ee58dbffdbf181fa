"""Event queries: a user is a record, an event a beat, errors and extreme values are artefacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import storage
from ..functions.ranking import percentiles
from ..functions.scalar import finite, fold_of, seconds
from ..operators import events as E
from ..operators import shuffles
from ..operators.statistics import descriptives, four_stats
from .registry import query, r, table

KEYS = ["user_id"]
#: Limits of the stand-in: intervals in ms, largest value.
LOW, HIGH, LARGEST = 1e6, 1.5e8, 300.0
VALUES = ["value", "rr_next_ms"]
#: Digits that are kept: such that engines that add in another order agree, and no mean of the tables' two-digit values is a tie.
DIGITS = {"value_mean": 9, "rr_next_ms_mean": 6, "value_sd": 6, "rr_next_ms_sd": 3, "mad": 6, "iqr": 6}
STAT_NAMES = [f"{v}_{s}" for v in VALUES for s in ("mean", "sd", "mad", "iqr")]


def digits(name: str) -> int:
    return DIGITS.get(name) or DIGITS[name.rsplit("_", 1)[1]]


def stat_columns() -> list[Column]:
    return [r(n, digits=digits(n)) for n in STAT_NAMES]


SEEDS = [0, 1, 2, 3, 4, 5]


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select("user_id", "event_id", at.alias("pos"), finite("value").alias("value"), "event_type")


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = peaks(spark, sf_dir)
    return E.intervals(rows.repartition(storage.tasks_for(spark, rows.count()), *KEYS), KEYS, ["pos", "event_id"], "pos", 1.0)


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timed(spark, sf_dir)
    large = (F.col("value") > LARGEST) | (F.col("event_type") == "error")
    return E.validity(rows, KEYS, LOW, HIGH, large)


def valid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.adjacent(validated(spark, sf_dir), KEYS)


CTES = f"""
WITH ev AS (SELECT user_id, event_id, epoch_us(ts) // 1000 - 1704067200000 AS pos, value, event_type FROM events),
iv AS (SELECT *, row_number() OVER w - 1 AS source_index, (lag(pos) OVER w + pos) / 2 AS left_at, (pos + lead(pos) OVER w) / 2 AS right_at,
  (pos - lag(pos) OVER w) * 1.0::double AS rr_prev_ms, (lead(pos) OVER w - pos) * 1.0::double AS rr_next_ms FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY pos, event_id)),
ga AS (SELECT user_id, count(*) AS peaks, avg(CASE WHEN rr_next_ms IS NULL THEN NULL WHEN rr_next_ms BETWEEN {LOW} AND {HIGH} THEN 1.0 ELSE 0.0 END) AS share FROM iv GROUP BY user_id),
gt AS (SELECT *, CASE WHEN peaks < 5 THEN 'insufficient_peaks' WHEN coalesce(share, 0) < 0.75 THEN 'rr_out_of_range' ELSE '' END AS gate FROM ga),
v0 AS (SELECT iv.*, CASE WHEN rr_prev_ms IS NULL OR rr_next_ms IS NULL THEN '{E.EDGE}' WHEN gate <> '' THEN gate
  WHEN rr_prev_ms NOT BETWEEN {LOW} AND {HIGH} OR rr_next_ms NOT BETWEEN {LOW} AND {HIGH} THEN '{E.NEIGHBOUR}' WHEN value > {LARGEST} OR event_type = 'error' THEN '{E.ARTIFACT}' ELSE '' END AS reason FROM iv JOIN gt USING (user_id)),
v1 AS (SELECT *, CASE WHEN reason = '' AND sum((reason = '')::int) OVER (PARTITION BY user_id) < 3 THEN '{E.FEW}' ELSE reason END AS failure_reason FROM v0),
vd AS (SELECT *, failure_reason = '' AS valid, CASE WHEN failure_reason = '' THEN sum((failure_reason = '')::int) OVER (PARTITION BY user_id ORDER BY source_index) - 1 ELSE -1 END AS beat_index FROM v1),
ed AS (SELECT *, lead(source_index) OVER w AS next_source, lead(source_index) OVER w - source_index = 1 AS edge FROM vd WHERE valid WINDOW w AS (PARTITION BY user_id ORDER BY beat_index)),
"""
#: CTES ends with a comma: a query adds its own step ``q``.


def sql(step: str, out: str = "SELECT * FROM q") -> str:
    return f"{CTES} q AS ({step}) {out}"


def stats_sql(source: str, keys: str, minimum: int, extra: str = "") -> str:
    columns = []
    for v in VALUES:
        for name, f in (("mean", f"avg({v})"), ("sd", f"stddev_samp({v})"), ("mad", f"mad({v})"), ("iqr", f"quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25)")):
            columns.append(f"CASE WHEN count({v}) >= {minimum} THEN round({f}, {digits(f"{v}_{name}")}) END AS {v}_{name}")
    return f"SELECT {keys}, {extra}{', '.join(columns)} FROM {source} GROUP BY {keys}"


@query(sql("SELECT user_id, event_id, source_index, round(pos / 1e3::double, 4) AS t_s, left_at, right_at, round(rr_prev_ms, 4) AS rr_prev_ms, round(rr_next_ms, 4) AS rr_next_ms FROM iv"))
def event_rr_and_midpoints(spark, sf_dir):
    return timed(spark, sf_dir).select("user_id", "event_id", "source_index", r(seconds("pos", 1e3), "t_s"), "left_at", "right_at", r("rr_prev_ms"), r("rr_next_ms"))


@query(sql("SELECT user_id, event_id, valid, failure_reason FROM vd"))
def event_validity_reasons(spark, sf_dir):
    return validated(spark, sf_dir).select("user_id", "event_id", "valid", "failure_reason")


@query(sql("SELECT user_id, peaks, round(share, 6) AS rr_share, gate FROM gt"))
def record_gates(spark, sf_dir):
    return E.record_gate(timed(spark, sf_dir), KEYS, LOW, HIGH).select("user_id", "peaks", r("rr_share", digits=6), "gate")


@query(sql("SELECT user_id, event_id, source_index, beat_index FROM vd"))
def valid_beat_index(spark, sf_dir):
    return validated(spark, sf_dir).select("user_id", "event_id", "source_index", "beat_index")


@query(sql("SELECT user_id, beat_index, source_index, next_source, edge FROM ed"))
def adjacent_edges(spark, sf_dir):
    return valid_edges(spark, sf_dir).select("user_id", "beat_index", "source_index", "next_source", "edge")


@query(sql('SELECT user_id, source_index AS "before", next_source AS "after", next_source - source_index - 1 AS missing FROM ed WHERE NOT edge'))
def gap_report(spark, sf_dir):
    return E.gaps(validated(spark, sf_dir), KEYS)


STEPS = "st AS (SELECT user_id, edge, CASE WHEN edge THEN abs(lead(value) OVER w - value) END AS value, CASE WHEN edge THEN abs(lead(rr_next_ms) OVER w - rr_next_ms) END AS rr_next_ms FROM ed WINDOW w AS (PARTITION BY user_id ORDER BY beat_index)),"


@query(CTES + STEPS + "q AS (SELECT user_id, round(avg(value), 9) AS mean_step FROM st GROUP BY user_id) SELECT * FROM q")
def gap_aware_mean_step(spark, sf_dir):
    rows = E.steps(valid_edges(spark, sf_dir), KEYS, "beat_index", ["value"])
    return rows.groupBy("user_id").agg(r(F.avg("value"), "mean_step", 9))


@query(sql(stats_sql("ed", "user_id", 3)))
def order_free_stats(spark, sf_dir):
    return four_stats(valid_edges(spark, sf_dir), KEYS, VALUES, 3).select("user_id", *stat_columns())


@query(CTES + STEPS + f"q AS ({stats_sql('st', 'user_id', 2, 'sum(coalesce(edge, false)::int) AS pairs, ')}) SELECT * FROM q")
def adjacent_stats(spark, sf_dir):
    rows = E.steps(valid_edges(spark, sf_dir), KEYS, "beat_index", VALUES)
    return four_stats(rows, KEYS, VALUES, 2, [F.sum(F.coalesce(F.col("edge"), F.lit(False)).cast("long")).alias("pairs")]).select("user_id", "pairs", *stat_columns())


MOVED = """mv AS (SELECT ed.*, seed, beat_index AS vector_origin, row_number() OVER (PARTITION BY user_id, seed ORDER BY
  CASE WHEN seed = 0 THEN 0 ELSE cast('0x' || substr(md5(seed || '|' || user_id || '|' || event_id), 1, 8) AS bigint) END, beat_index) - 1 AS valid_position
  FROM ed CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4, 5]) AS seed)),
"""


@query(CTES + MOVED + "q AS (SELECT user_id, seed, valid_position, vector_origin FROM mv) SELECT * FROM q")
def shuffled_orders(spark, sf_dir):
    return shuffles.orders(valid_edges(spark, sf_dir), KEYS, SEEDS, "event_id").select("user_id", "seed", "valid_position", "vector_origin")


SHUFFLED = (
    MOVED
    + """sm AS (SELECT m.user_id, m.seed, o.edge, CASE WHEN o.edge THEN abs(lead(m.value) OVER w - m.value) END AS value, CASE WHEN o.edge THEN abs(lead(m.rr_next_ms) OVER w - m.rr_next_ms) END AS rr_next_ms
  FROM mv m JOIN ed o ON o.user_id = m.user_id AND o.beat_index = m.valid_position WINDOW w AS (PARTITION BY m.user_id, m.seed ORDER BY m.valid_position)),
"""
)


@query(CTES + SHUFFLED + f"q AS ({stats_sql('sm', 'user_id, seed', 2, 'sum(coalesce(edge, false)::int) AS pairs, ')}) SELECT * FROM q")
def shuffled_adjacent_stats(spark, sf_dir):
    return shuffles.adjacent_stats(valid_edges(spark, sf_dir), KEYS, VALUES, SEEDS, "event_id").select("user_id", "seed", F.col("pairs").cast("long").alias("pairs"), *stat_columns())


@query(CTES + SHUFFLED + "q AS (SELECT user_id, count(*) AS seeds, count(DISTINCT pairs) AS distinct_pairs FROM (SELECT user_id, seed, sum(coalesce(edge, false)::int) AS pairs FROM sm GROUP BY user_id, seed) GROUP BY user_id) SELECT * FROM q")
def shuffle_invariance(spark, sf_dir):
    found = shuffles.adjacent_stats(valid_edges(spark, sf_dir), KEYS, ["value"], SEEDS, "event_id")
    return found.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("seeds"), F.countDistinct("pairs").alias("distinct_pairs"))


@query()
def numpy_shuffled_stats(spark, sf_dir):
    """The adjacent statistics of orders drawn by NumPy's generator, which SQL does not have; held to NumPy in the tests."""
    valid = valid_edges(spark, sf_dir)
    found = shuffles.moved_stats(shuffles.numpy_orders(valid, "user_id", [0, 7001, 7002, 7003, 7004, 7005]), valid, KEYS, VALUES)
    return found.select("user_id", "seed", F.col("pairs").cast("long").alias("pairs"), *stat_columns())


@query(
    CTES
    + """ok AS (SELECT *, lead(rr_next_ms) OVER (PARTITION BY user_id ORDER BY source_index) - rr_next_ms AS step FROM iv WHERE rr_next_ms IS NOT NULL),
q AS (SELECT user_id, count(*) AS rr_count, round(median(rr_next_ms), 4) AS rr_median_ms, CASE WHEN count(*) >= 2 THEN round(stddev_samp(rr_next_ms) / median(rr_next_ms), 6) END AS rr_cv,
  CASE WHEN count(*) >= 2 THEN round(sqrt(avg(step * step)), 3) END AS rmssd_ms, round(mad(rr_next_ms), 4) AS rr_mad_ms, round(quantile_cont(rr_next_ms, 0.75) - quantile_cont(rr_next_ms, 0.25), 4) AS rr_iqr_ms FROM ok GROUP BY user_id) SELECT * FROM q"""
)
def rr_summary(spark, sf_dir):
    found = E.rr_summary(timed(spark, sf_dir), KEYS)
    return found.select("user_id", "rr_count", r("rr_median_ms"), r("rr_cv", digits=6), r("rmssd_ms", digits=3), r("rr_mad_ms"), r("rr_iqr_ms"))


def with_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timed(spark, sf_dir).withColumn("slope", F.abs(F.col("value") - F.lag("value").over(E.by(KEYS, "source_index"))))
    return rows.withColumn("slope", F.coalesce("slope", "value"))


@query()
def peak_repair(spark, sf_dir):
    """Events of a user as candidate peaks: weak ones shortly after the last kept one go. A fold over what was kept, which SQL cannot express."""
    return E.repair(with_slope(spark, sf_dir), KEYS, ["source_index"], "pos", "value", "slope", 600.0, 86400.0, rate=1e3).select("user_id", "event_id")


SUMMARY = """vv AS (SELECT *, CASE WHEN valid THEN lead(source_index) OVER (PARTITION BY user_id, valid ORDER BY source_index) - source_index = 1 END AS e FROM vd),
sm AS (SELECT user_id, count(*) AS peaks, sum(valid::int) AS valid_beats, sum(coalesce(e, false)::int) AS pairs, median(rr_next_ms) FILTER (valid) AS rr_median_ms, avg(value) FILTER (valid) AS value_mean, max(value) FILTER (valid) AS value_max FROM vv GROUP BY user_id),
mf AS (SELECT c_custkey AS user_id, c_mktsegment FROM customer),
rm AS (SELECT user_id, count(*) AS removed FROM ev WHERE event_type = 'error' GROUP BY user_id),
vh AS (SELECT user_id, max(vh) AS vh_max FROM (SELECT user_id, event_type, stddev_samp(value) / avg(value) AS vh FROM ed GROUP BY user_id, event_type) GROUP BY user_id),
rs AS (SELECT mf.user_id, c_mktsegment, coalesce(peaks, 0) AS peaks, coalesce(valid_beats, 0) AS valid_beats, coalesce(pairs, 0) AS pairs, rr_median_ms, value_mean, value_max, coalesce(removed, 0) AS removed_candidates, vh_max FROM mf LEFT JOIN sm USING (user_id) LEFT JOIN rm USING (user_id) LEFT JOIN vh USING (user_id)),
"""


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    events = validated(spark, sf_dir)
    # stand-ins: errors as candidates that repair removed, event types as leads with their spread
    spread = events.filter("valid").groupBy("user_id", "event_type").agg((F.stddev_samp("value") / F.avg("value")).alias("vh"))
    return E.record_summary(manifest, events, KEYS, "value", events.filter("event_type = 'error'"), spread)


@query(CTES + SUMMARY + "q AS (SELECT user_id, c_mktsegment, peaks, valid_beats, pairs, round(rr_median_ms, 4) AS rr_median_ms, round(value_mean, 9) AS value_mean, value_max, removed_candidates, round(vh_max, 6) AS vh_max FROM rs) SELECT * FROM q")
def record_summary(spark, sf_dir):
    return summaries(spark, sf_dir).select("user_id", "c_mktsegment", "peaks", "valid_beats", "pairs", r("rr_median_ms"), r("value_mean", digits=9), "value_max", "removed_candidates", r("vh_max", digits=6))


@query(CTES + SUMMARY + "q AS (SELECT c_mktsegment, count(*) AS n, sum((valid_beats >= 3)::int) AS successes, sum(valid_beats) AS beats FROM rs GROUP BY c_mktsegment) SELECT * FROM q")
def stage_label_coverage(spark, sf_dir):
    return E.coverage(summaries(spark, sf_dir), ["c_mktsegment"])


METRICS = ["peaks", "valid_beats", "pairs", "rr_median_ms", "value_mean", "value_max", "removed_candidates", "vh_max"]


@query(
    CTES
    + SUMMARY
    + "lb AS (SELECT *, user_id % 2 AS label FROM rs), q AS ("
    + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, " + ", ".join(f"count({m}) FILTER (label = {k}) AS \"{k}_n\", round(avg({m}) FILTER (label = {k}), 4) AS \"{k}_mean\", round(median({m}) FILTER (label = {k}), 4) AS \"{k}_median\", round(stddev_samp({m}) FILTER (label = {k}), 4) AS \"{k}_sd\"" for k in (0, 1)) + " FROM lb"
        for m in METRICS
    )
    + ") SELECT * FROM q"
)
def class_descriptives(spark, sf_dir):
    rows = summaries(spark, sf_dir).withColumn("label", (F.col("user_id") % 2).cast("int"))
    rows = rows.select("label", *[F.col(m).cast("double").alias(m) for m in METRICS])
    found = descriptives(rows, "label", METRICS, [0, 1])
    return found.select("metric", *[r(f"{k}_{s}") if s != "n" else F.col(f"{k}_{s}") for k in (0, 1) for s in ("n", "mean", "median", "sd")])


RUNS = """rn AS (SELECT user_id, source_index, source_index - row_number() OVER (PARTITION BY user_id ORDER BY source_index) AS island FROM iv WHERE value < 20),
ru AS (SELECT user_id, min(source_index) AS "first", max(source_index) AS "last", count(*) AS length FROM rn GROUP BY user_id, island),
"""


@query(CTES + RUNS + "q AS (SELECT * FROM ru) SELECT * FROM q")
def run_lengths(spark, sf_dir):
    return E.runs(timed(spark, sf_dir), KEYS, ["source_index"], F.col("value") < 20)


@query(CTES + RUNS + "q AS (SELECT u.user_id, coalesce(max(length), 0) AS longest, count(length) AS runs FROM (SELECT DISTINCT user_id FROM iv) u LEFT JOIN ru USING (user_id) GROUP BY u.user_id) SELECT * FROM q")
def longest_runs(spark, sf_dir):
    return E.longest_run(timed(spark, sf_dir), KEYS, ["source_index"], F.col("value") < 20)


@query(
    CTES
    + """cl AS (SELECT user_id, source_index, least(greatest(value, 10), 30) AS v FROM iv), mm AS (SELECT *, min(v) OVER (PARTITION BY user_id) AS lo, max(v) OVER (PARTITION BY user_id) AS hi FROM cl),
h AS (SELECT user_id, count(*) AS length FROM (SELECT user_id, source_index - row_number() OVER (PARTITION BY user_id ORDER BY source_index) AS i FROM mm WHERE v = lo) GROUP BY user_id, i
  UNION ALL SELECT user_id, count(*) FROM (SELECT user_id, source_index - row_number() OVER (PARTITION BY user_id ORDER BY source_index) AS i FROM mm WHERE v = hi AND hi > lo) GROUP BY user_id, i),
hs AS (SELECT user_id, sum(length) AS held FROM h WHERE length >= 3 GROUP BY user_id),
q AS (SELECT user_id, n, round(coalesce(held, 0) / n, 6) AS share FROM (SELECT user_id, count(*) AS n FROM cl GROUP BY user_id) LEFT JOIN hs USING (user_id)) SELECT * FROM q"""
)
def boundary_plateau(spark, sf_dir):
    rows = timed(spark, sf_dir).withColumn("v", F.least(F.greatest(F.col("value"), F.lit(10.0)), F.lit(30.0)))
    return E.plateau_share(rows, KEYS, ["source_index"], "v", 3).select("user_id", "n", r("share", digits=6))


@query(
    CTES
    + """vf AS (SELECT user_id, 1 + cast('0x' || substr(md5(user_id::varchar), 1, 8) AS bigint) % 8 AS fold, value FROM ed),
q AS (SELECT fold, user_id, round(avg(value), 9) AS mean FROM vf GROUP BY fold, user_id) SELECT fold::int AS fold, count(*) AS users, round(median(mean), 8) AS median FROM q GROUP BY fold"""
)
def fold_medians(spark, sf_dir):
    rows = valid_edges(spark, sf_dir).groupBy(fold_of("user_id").alias("fold"), "user_id").agg(F.round(F.avg("value"), 9).alias("mean"))
    found = percentiles(rows, ["fold"], "mean", (0.5,))
    return rows.groupBy("fold").agg(F.count(F.lit(1)).alias("users")).join(found, "fold").select("fold", "users", r(F.col("percentiles")[0], "median", 8))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: order-free statistics and gap-aware step statistics of the valid events."""
    return order_free_stats(spark, sf_dir).join(adjacent_stats(spark, sf_dir).select("user_id", "pairs", *[F.col(c).alias(f"step_{c}") for c in STAT_NAMES]), "user_id", "left")
