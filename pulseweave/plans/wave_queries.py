"""Wave queries: embeddings as waves, their labels as classes or records; events as the beats of signals."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import storage
from ..functions.ranking import dense_index, percentiles
from ..functions.scalar import fold_of, let, md5_int
from ..operators import checks, distances, events, intervals, logistic, quality, shuffles, templates, waveforms
from ..operators.statistics import four_stats
from ..sources import manifests, tables
from . import event_queries
from .registry import query, r, table

LABELS, FOLDS = list(range(10)), list(range(1, 9))
THRESHOLDS = (0.05, 0.1, 0.2, 0.3)


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumn("fold", fold_of("vec_id"))


CTES = """
WITH em AS (SELECT vec_id, label, embedding::double[] AS e, (1 + cast('0x' || substr(md5(vec_id::varchar), 1, 8) AS bigint) % 8)::int AS fold FROM embeddings),
ux AS (SELECT vec_id, label, fold, unnest(e) AS v, generate_subscripts(e, 1) AS i FROM em),
"""
Q = "q AS (SELECT 1) "


SAMPLES = range(1, 65)


def whole_wave(wave: str) -> list:
    """All 64 samples, a column each."""
    return [r(F.get(wave, k - 1), f"w{k}", 6) for k in SAMPLES]


def whole_sql(value: str = "v") -> str:
    return ", ".join(f"round(max({value}) FILTER (i = {k}), 6) AS w{k}" for k in SAMPLES)


@query(CTES + "q AS (SELECT label, i, avg(v) AS v, count(*) AS n FROM ux GROUP BY label, i) SELECT label, max(n) AS n, " + whole_sql() + " FROM q GROUP BY label")
def representative_mean(spark, sf_dir):
    return templates.mean_wave(waves(spark, sf_dir), ["label"], "embedding").select("label", "n", *whole_wave("embedding"))


TEMPLATES = """ce AS (SELECT f, l FROM (SELECT unnest(range(1, 9)) AS f) CROSS JOIN (SELECT unnest(range(0, 10)) AS l)),
tp AS (SELECT f AS fold, l AS label, i, avg(v) AS v, count(v) AS n FROM ce LEFT JOIN ux ON ux.label = l AND ux.fold <> f GROUP BY f, l, i),
tn AS (SELECT fold, label, max(n) AS n FROM tp GROUP BY fold, label), ts AS (SELECT *, CASE WHEN min(n) OVER (PARTITION BY fold) >= {least} THEN 'ok' ELSE 'insufficient' END AS status FROM tn),
"""


@query(CTES + TEMPLATES.format(least=20) + Q + "SELECT tp.fold::int AS fold, tp.label::int AS label, max(ts.n) AS n, any_value(status) AS status, " + whole_sql("CASE WHEN status = 'ok' THEN v END") + " FROM tp JOIN ts ON tp.fold = ts.fold AND tp.label = ts.label GROUP BY tp.fold, tp.label")
def fold_templates(spark, sf_dir):
    found = templates.fold_templates(waves(spark, sf_dir), [], "fold", "label", "embedding", FOLDS, LABELS, 20)
    return found.select("fold", "label", "n", "status", *whole_wave("embedding"))


@query(CTES + TEMPLATES.format(least=42) + Q + "SELECT fold::int AS fold, label::int AS label, n, status FROM ts")
def template_status(spark, sf_dir):
    return templates.fold_templates(waves(spark, sf_dir), [], "fold", "label", "embedding", FOLDS, LABELS, 42).select("fold", "label", "n", "status")


@query(CTES + Q + "SELECT f::int AS template_fold, label::int AS label, count(*) AS contributors, count(*) FILTER (fold = f) AS own FROM em CROSS JOIN (SELECT unnest(range(1, 9)) AS f) WHERE fold <> f GROUP BY f, label")
def contributor_check(spark, sf_dir):
    """Contributors per template, and how many of them belong to the template's own fold: none may."""
    rows = waves(spark, sf_dir)
    given = templates.contributors(rows, "vec_id", "fold", "label", FOLDS)
    own = checks.own_fold_contributors(given, rows, "vec_id", "fold").groupBy("template_fold", F.col("label").alias("l")).agg(F.count(F.lit(1)).alias("o"))
    found = given.groupBy("template_fold", "label").agg(F.count(F.lit(1)).alias("contributors"))
    return found.join(own, (found["template_fold"] == own["template_fold"]) & (found["label"] == own["l"]), "left").select(found["template_fold"], "label", "contributors", F.coalesce("o", F.lit(0)).alias("own"))


@query(CTES + "q AS (SELECT label, i, avg(v) AS v, count(*) AS n FROM ux GROUP BY label, i) SELECT label, max(n) AS n, CASE WHEN max(n) >= 50 THEN 'ok' ELSE 'insufficient_prototypes' END AS status, " + whole_sql("CASE WHEN n >= 50 THEN v END") + " FROM q GROUP BY label")
def class_prototypes(spark, sf_dir):
    return templates.prototypes(waves(spark, sf_dir), "label", "embedding", 50).select("label", "n", "status", *whole_wave("embedding"))


VH = """sb AS (SELECT label, avg(sd) AS b FROM (SELECT label, i, stddev_samp(v) AS sd FROM ux GROUP BY label, i) GROUP BY label),
sw AS (SELECT label, avg(sd) AS w, count(*) AS n FROM (SELECT label, vec_id, stddev_samp(v) AS sd FROM ux GROUP BY label, vec_id) GROUP BY label),
vh AS (SELECT label, n, CASE WHEN n >= 3 AND w > 1e-8 THEN b / w END AS vh FROM sb JOIN sw USING (label)),
"""


@query(CTES + VH + Q + "SELECT label, n, round(vh, 6) AS vh FROM vh")
def vh_per_lead(spark, sf_dir):
    return templates.sample_spread(waves(spark, sf_dir), ["label"], "embedding").select("label", "n", r("vh", digits=6))


@query(CTES + VH + Q + "SELECT g, bool_and(vh < 1.0) AS eligible FROM (SELECT label % 3 AS g, vh FROM vh) GROUP BY g")
def prototype_eligibility(spark, sf_dir):
    found = templates.sample_spread(waves(spark, sf_dir), ["label"], "embedding").withColumn("g", F.col("label") % 3)
    return templates.prototype_eligible(found, ["g"], F.lit(True), 1.0)


MORPH = "mo AS (SELECT vec_id, any_value(label) AS label, avg(v) AS m, stddev_pop(v) AS sd, min(v) AS lo, max(v) AS hi, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.75) AS q75 FROM ux GROUP BY vec_id),"


@query(CTES + MORPH + Q + "SELECT vec_id, round(m, 6) AS wave_mean, round(sd, 6) AS wave_sd, round(lo, 6) AS wave_min, round(hi, 6) AS wave_max, round(q25, 6) AS wave_q25, round(q75, 6) AS wave_q75 FROM mo")
def array_morphology(spark, sf_dir):
    found = templates.morphology(waves(spark, sf_dir), "embedding")
    return found.select("vec_id", *[r(c, digits=6) for c in ("wave_mean", "wave_sd", "wave_min", "wave_max", "wave_q25", "wave_q75")])


#: v_h of records of twelve vectors; two thirds of the records, by hash, are the pool.
RECORD_VH = """ur AS (SELECT vec_id // 12 AS record, vec_id, i, v FROM ux), rb AS (SELECT record, avg(sd) AS b FROM (SELECT record, i, stddev_samp(v) AS sd FROM ur GROUP BY record, i) GROUP BY record),
rw AS (SELECT record, avg(sd) AS w, count(*) AS n FROM (SELECT record, vec_id, stddev_samp(v) AS sd FROM ur GROUP BY record, vec_id) GROUP BY record),
rv AS (SELECT record, record % 2 AS class, CASE WHEN n >= 3 AND w > 1e-8 THEN b / w END AS vh, cast('0x' || substr(md5('pool|' || record), 1, 8) AS bigint) % 3 <> 0 AS pool, (1 + cast('0x' || substr(md5(record::varchar), 1, 8) AS bigint) % 8)::int AS fold FROM rb JOIN rw USING (record)),
"""
VH_LIMITS = (0.96, 0.98, 0.99, 1.0, 1.02)


def record_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = waves(spark, sf_dir).withColumn("record", F.floor(F.col("vec_id") / 12))
    found = templates.sample_spread(rows, ["record"], "embedding")
    return found.withColumns({"class": (F.col("record") % 2).cast("int"), "pool": md5_int("pool", F.col("record")) % 3 != 0, "fold": fold_of("record")})


@query(CTES + RECORD_VH + Q + f"SELECT t::double AS threshold, class::int AS class, count(*) FILTER (vh < t) AS eligible, count(*) FILTER (vh < t AND pool) AS eligible_pool FROM rv CROSS JOIN (SELECT unnest({list(VH_LIMITS)}) AS t) GROUP BY t, class")
def vh_threshold_counts(spark, sf_dir):
    """Records under five limits of v_h per class, all of them and those of the pool."""
    return templates.threshold_counts(record_spread(spark, sf_dir), "vh", "class", VH_LIMITS, F.col("pool"))


@query(
    CTES
    + RECORD_VH
    + Q
    + """, me AS (SELECT record, i, avg(v) AS v FROM ur GROUP BY record, i), ok AS (SELECT * FROM rv WHERE pool AND vh < 1.0), gr AS (SELECT f, c FROM (SELECT unnest(range(1, 9)) AS f) CROSS JOIN (SELECT unnest([0, 1]) AS c)),
nn AS (SELECT f, c, count(record) AS n FROM gr LEFT JOIN ok ON ok.class = c AND ok.fold <> f GROUP BY f, c), st AS (SELECT *, CASE WHEN min(n) OVER (PARTITION BY f) >= 7 THEN 'ok' ELSE 'insufficient' END AS status FROM nn),
mm AS (SELECT f, c, i, avg(v) AS v FROM gr JOIN ok ON ok.class = c AND ok.fold <> f JOIN me USING (record) GROUP BY f, c, i)
SELECT st.f::int AS fold, st.c::int AS class, n, status, """
    + whole_sql("CASE WHEN status = 'ok' THEN v END")
    + " FROM st LEFT JOIN mm ON mm.f = st.f AND mm.c = st.c GROUP BY st.f, st.c, n, status"
)
def strict_templates(spark, sf_dir):
    """Mean waves of the pool's records with a small spread, per fold and class; folds with too few of either class have none."""
    rows = templates.mean_wave(waves(spark, sf_dir).withColumn("record", F.floor(F.col("vec_id") / 12)), ["record"], "embedding")
    rows = rows.drop("n").join(record_spread(spark, sf_dir), "record")
    found = templates.strict_templates(rows, [], "fold", "class", "embedding", FOLDS, [0, 1], F.col("pool"), F.col("vh") < 1.0, 7)
    return found.select("fold", "class", "n", "status", *whole_wave("embedding"))


#: Distances: waves stretched to 500 samples; a record of the pair table is twelve vectors in order of their number.
def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waves(spark, sf_dir).select("vec_id", "label", "fold", distances.stretched("embedding").alias("wave"))


@query()
def pairwise_distance(spark, sf_dir):
    """Elastic distance of all pairs of a record's waves; held to a plain version in the tests."""
    rows = waves(spark, sf_dir).select(F.floor(F.col("vec_id") / 12).alias("record"), "vec_id", F.col("embedding").alias("wave"))
    found = distances.pair_tiles(rows, ["record"], "vec_id", ["wave"], kernel=distances.stretched_distance, names=["distance"])
    return found.select("record", "i", "j", r("distance", digits=6))


@query()
def template_distance(spark, sf_dir):
    """Elastic distance of every wave to its fold's templates of all classes."""
    # waves are stretched in the tasks that measure them, which commutes with the templates' means; templates are written, so that Spark knows how few they are
    rows = waves(spark, sf_dir).withColumnRenamed("embedding", "wave")
    made = storage.written(templates.fold_templates(rows, [], "fold", "label", "wave", FOLDS, LABELS, 1).select("fold", F.col("label").alias("template_label"), "wave"), "templates")
    rows = distances.dealt(rows.select("vec_id", "fold", F.col("wave").cast("array<double>").alias("wave")), "vec_id")
    return distances.to_templates(rows, made, ["fold"], "wave", distances.stretched_distance).select("vec_id", "template_label", r("distance", digits=6))


@query()
def self_reference_distance(spark, sf_dir):
    """Elastic distance of every wave to its label's mean."""
    # a label's vectors are numbered in ranges of their identifiers, and waves meet the few means where they are
    places = dense_index(waves(spark, sf_dir).select("vec_id", "label"), ["label"], F.floor(F.col("vec_id") / 4096), ["vec_id"])
    rows = beats(spark, sf_dir)
    found = distances.to_own_mean(rows, templates.mean_wave(rows, ["label"], "wave"), ["label"], "vec_id", "wave")
    return found.join(places, ["label", "vec_id"]).select("label", "index", r("distance", digits=6))


@query()
def probe_grid(spark, sf_dir):
    """A cell per probe, lead and class; a vector is a lead of the probe vec_id // 3, and prototypes are of the other folds' probes."""
    rows = waves(spark, sf_dir).select(F.floor(F.col("vec_id") / 3).alias("probe"), (F.col("vec_id") % 3).alias("lead"), "label", F.col("embedding").cast("array<double>").alias("wave"))
    rows = rows.withColumn("fold", fold_of("probe"))
    made = templates.fold_templates(rows, ["lead"], "fold", "label", "wave", FOLDS, LABELS, 1).withColumn("status", F.when((F.col("n") >= 14) & F.col("wave").isNotNull(), "ok").otherwise("insufficient_prototypes"))
    made = storage.written(made, "prototypes")
    return distances.probe_grid(rows, made, "probe", "lead", "label", "wave", [0, 1, 2], LABELS, "fold", distances.stretched_distance, 64).select("probe", "lead", "label", r("distance", digits=6), "status")


@query(
    event_queries.CTES
    + event_queries.MOVED
    + """pr AS (SELECT a.user_id, a.beat_index AS i, b.beat_index AS j, sqrt((a.value - b.value) ** 2 + ((a.rr_next_ms - b.rr_next_ms) / 1e6) ** 2) AS distance FROM ed a JOIN ed b ON a.user_id = b.user_id AND a.beat_index < b.beat_index),
nx AS (SELECT user_id, seed, valid_position, vector_origin, lead(vector_origin) OVER (PARTITION BY user_id, seed ORDER BY valid_position) AS n FROM mv),
q AS (SELECT nx.user_id, nx.seed, nx.valid_position, least(nx.vector_origin, n) AS i, greatest(nx.vector_origin, n) AS j FROM nx JOIN ed ON ed.user_id = nx.user_id AND ed.beat_index = nx.valid_position AND ed.edge)
SELECT user_id, seed, count(*) AS pairs, round(avg(distance), 6) AS mean FROM q JOIN pr USING (user_id, i, j) GROUP BY user_id, seed"""
)
def neighbour_pair_lookup(spark, sf_dir):
    valid = event_queries.valid_edges(spark, sf_dir)
    needed = shuffles.neighbours(shuffles.orders(valid, ["user_id"], event_queries.SEEDS, "event_id"), valid, ["user_id"])
    end = lambda at, v, rr: valid.select("user_id", F.col("beat_index").alias(at), F.col("value").alias(v), F.col("rr_next_ms").alias(rr))
    pairs = needed.select("user_id", "i", "j").distinct().join(end("i", "v1", "r1"), ["user_id", "i"]).join(end("j", "v2", "r2"), ["user_id", "j"])
    gap = (F.col("r1") - F.col("r2")) / 1e6
    pairs = pairs.select("user_id", "i", "j", F.sqrt((F.col("v1") - F.col("v2")) * (F.col("v1") - F.col("v2")) + gap * gap).alias("distance"))
    found = needed.join(pairs, ["user_id", "i", "j"])
    return found.groupBy("user_id", "seed").agg(F.count(F.lit(1)).alias("pairs"), r(F.avg("distance"), "mean", 6))


@query()
def shuffled_wave_distance(spark, sf_dir):
    """Four statistics of the elastic distance between neighbouring waves of a record (twelve vectors) for each order; only pairs that an order needs are computed, once."""
    rows = waves(spark, sf_dir).select(F.floor(F.col("vec_id") / 12).alias("record"), "vec_id", (F.col("vec_id") % 12).cast("int").alias("beat_index"), distances.stretched("embedding").alias("wave"))
    places = rows.select("record", "vec_id", "beat_index").withColumn("edge", F.lead("beat_index").over(events.by(["record"], "beat_index")).isNotNull())
    needed = shuffles.neighbours(shuffles.orders(places, ["record"], event_queries.SEEDS, "vec_id"), places, ["record"])
    end = lambda at, wave: rows.select("record", F.col("beat_index").alias(at), F.col("wave").alias(wave))
    pairs = distances.with_distance(needed.select("record", "i", "j").distinct().join(end("i", "a"), ["record", "i"]).join(end("j", "b"), ["record", "j"]))
    found = four_stats(needed.join(pairs, ["record", "i", "j"]), ["record", "seed"], ["distance"], 2, [F.count(F.lit(1)).alias("pairs")])
    return found.select("record", "seed", "pairs", *[r(f"distance_{n}", digits=6) for n in ("mean", "sd", "mad", "iqr")])


#: Values on a grid of 2**-20, so that sums are the same in any order.
HALVES = """
WITH em AS (SELECT vec_id, label % 2 AS y, (1 + cast('0x' || substr(md5(vec_id::varchar), 1, 8) AS bigint) % 8)::int AS fold, unnest(embedding::double[]) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
g AS (SELECT f::int AS held_fold, fold, y, CASE WHEN fold = f THEN 1 - y ELSE y END AS turned, i, round(v * 1048576) AS v FROM em CROSS JOIN (SELECT unnest(range(1, 9)) AS f)),
a AS (SELECT held_fold, y, i, sum(v) AS every, count(*) AS n, coalesce(sum(v) FILTER (fold <> held_fold), 0) AS others, count(*) FILTER (fold <> held_fold) AS m FROM g GROUP BY held_fold, y, i),
b AS (SELECT held_fold, turned AS y, i, sum(v) AS every, count(*) AS n, coalesce(sum(v) FILTER (fold <> held_fold), 0) AS others, count(*) FILTER (fold <> held_fold) AS m FROM g GROUP BY held_fold, turned, i)
SELECT held_fold, count(DISTINCT y) AS rows_first, count(DISTINCT y) AS rows_second, bool_and(a.others = b.others AND a.m = b.m) AS unchanged, bool_and(a.every = b.every AND a.n = b.n) AS leaky_unchanged FROM a JOIN b USING (held_fold, y, i) GROUP BY held_fold
"""


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of two classes, with values on the grid."""
    return waves(spark, sf_dir).select("vec_id", "fold", (F.col("label") % 2).cast("int").alias("y"), checks.on_grid("embedding").alias("wave"))


def held_templates(rows: DataFrame, leak: bool = False) -> DataFrame:
    """Templates of each held-out fold: from all other folds or, with a planted leak, from all rows."""
    if leak:
        return templates.mean_wave(rows, ["held_fold", "y"], "wave").select("held_fold", "y", "n", "wave")
    found = templates.fold_templates(rows, ["held_fold"], "fold", "y", "wave", FOLDS, [0, 1], 1)
    return found.filter("fold = held_fold").select("held_fold", "y", "n", "wave")


@query(HALVES)
def template_invariance(spark, sf_dir):
    """Templates of a fold do not change with its labels; those of a run with a planted leak do."""
    parts = {}
    for leak in (False, True):
        run = lambda rows, leak=leak: {"templates": held_templates(rows, leak)}
        parts[leak] = checks.label_invariance(run, classes(spark, sf_dir), "y", "fold", FOLDS, {"templates": ["y", "n", "wave"]}, 12)
    return parts[False].drop("table").join(parts[True].select("held_fold", F.col("unchanged").alias("leaky_unchanged")), "held_fold")


A_FEATURES = ["wave_mean", "wave_sd", "wave_min", "wave_max", "wave_q25", "wave_q75", "to_1", "to_0"]


def study(rows: DataFrame, leak: bool = False) -> dict[str, DataFrame]:
    """One run of model A for every held-out fold: templates, the features of all rows against them, and the scores of the held-out rows."""
    rows = storage.written(distances.dealt(rows, "vec_id"), "study")
    made = storage.written(held_templates(rows, leak), "templates")
    # a wave is the same in all folds: it is stretched and described once, and distances stretch it in their tasks
    each = distances.dealt(rows.select("vec_id", "wave").distinct(), "vec_id").withColumn("stretched", distances.stretched("wave"))
    shapes = templates.morphology(each, "stretched").drop("stretched")
    pairs = rows.select("held_fold", "vec_id", F.col("wave").alias("a")).join(made.select("held_fold", "y", F.col("wave").alias("b")), "held_fold")
    far = distances.with_distance(pairs, kernel=distances.stretched_distance).groupBy("held_fold", "vec_id").agg(*[F.max(F.when(F.col("y") == k, F.col("distance"))).alias(f"to_{k}") for k in (1, 0)])
    features = storage.written(rows.join(shapes, ["vec_id", "wave"]).drop("wave").join(far, ["held_fold", "vec_id"]), "features")
    held = features.withColumn("held", (F.col("fold") == F.col("held_fold")).cast("int"))
    scores = logistic.fold_scores(held, ["held_fold"], "held", "y", A_FEATURES, [1]).filter("held = 1").select("held_fold", "vec_id", "score")
    return {"templates": made, "features": features.select("held_fold", "vec_id", *A_FEATURES), "predictions": scores}


STUDY = {"templates": ["y", "n", "wave"], "features": ["vec_id", *A_FEATURES], "predictions": ["vec_id", "score"]}


@query()
def study_invariance(spark, sf_dir):
    """Whether templates, features and predictions of a fold stay as they are when its labels are turned round; the tests plant a leak."""
    return checks.label_invariance(study, classes(spark, sf_dir), "y", "fold", FOLDS, STUDY, 5)


SEQUENCE = ("V1", "V5", "V6")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beats of three vectors as leads, twelve to a record; about every seventh is not valid, so some neighbours have a gap between them."""
    rows = waves(spark, sf_dir).select(F.floor(F.col("vec_id") / 3).alias("beat"), (F.col("vec_id") % 3).alias("lead"), distances.stretched("embedding").alias("wave"))
    rows = rows.groupBy("beat").pivot("lead", [0, 1, 2]).agg(F.first("wave")).withColumnsRenamed(dict(zip("012", SEQUENCE, strict=True)))
    rows = rows.withColumns({"record": F.floor(F.col("beat") / 12), "source_index": (F.col("beat") % 12).cast("int"), "valid": md5_int("beat", F.col("beat")) % 7 != 0})
    upto = events.by(["record"], "source_index").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("beat_index", F.when(F.col("valid"), F.sum(F.col("valid").cast("int")).over(upto) - 1).otherwise(-1))


@query()
def sequence_distance_stats(spark, sf_dir):
    """Direct distances between adjacent beats on three leads, in the original order and in shuffled ones, from a cache of all pairs; gaps are no pairs."""
    rows = storage.written(sequences(spark, sf_dir), "sequences")
    pairs = distances.pair_tiles(rows.filter("valid"), ["record"], "beat_index", SEQUENCE, names=SEQUENCE)
    edges = events.adjacent(rows.drop(*SEQUENCE), ["record"])
    found = shuffles.distance_stats(edges, pairs, ["record"], event_queries.SEEDS, "beat", SEQUENCE)
    return found.select("record", "seed", "pairs", *[r(f"{w}_{n}", digits=6) for w in SEQUENCE for n in ("mean", "sd", "mad", "iqr")])


EDGES = """WITH b AS (SELECT DISTINCT vec_id // 3 AS beat, vec_id // 36 AS record, (vec_id // 3) % 12 AS source_index, cast('0x' || substr(md5('beat|' || (vec_id // 3)), 1, 8) AS bigint) % 7 <> 0 AS valid FROM embeddings),
n AS (SELECT record, lead(source_index) OVER (PARTITION BY record ORDER BY source_index) - source_index AS step FROM b WHERE valid)
"""


@query(EDGES + "SELECT record, count(*) AS beats, count(*) FILTER (step = 1) AS pairs, count(*) FILTER (step > 1) AS gaps FROM n GROUP BY record")
def sequence_edges(spark, sf_dir):
    """How many neighbours of a record are pairs and how many have a gap between them."""
    edges = events.adjacent(sequences(spark, sf_dir).drop(*SEQUENCE), ["record"])
    one = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return edges.groupBy("record").agg(F.count(F.lit(1)).alias("beats"), one(F.col("edge")).alias("pairs"), one(~F.col("edge")).alias("gaps"))


#: Signal quality: a vector is a lead of the record vec_id // 6.
def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waves(spark, sf_dir).select(F.floor(F.col("vec_id") / 6).alias("record"), (F.col("vec_id") % 6).alias("lead"), F.transform("embedding", lambda x: F.round(x.cast("double"), 2)).alias("wave"))


LEADS = """
WITH le AS (SELECT vec_id // 6 AS record, vec_id % 6 AS lead, list_transform(embedding::double[], lambda x: round(x, 2)) AS wave FROM embeddings),
lx AS (SELECT record, lead, unnest(wave) AS v, generate_subscripts(wave, 1) AS i FROM le),
dx AS (SELECT record, lead, i, v, abs(lead(v) OVER w - v) AS d FROM lx WINDOW w AS (PARTITION BY record, lead ORDER BY i)),
md AS (SELECT record, lead, median(d) AS med, mad(d) AS dm FROM dx GROUP BY record, lead),
il AS (SELECT record, lead, max(n) AS longest FROM (SELECT record, lead, count(*) AS n FROM (SELECT record, lead, i - row_number() OVER (PARTITION BY record, lead ORDER BY i) AS g FROM dx WHERE d < 0.045) GROUP BY record, lead, g) GROUP BY record, lead),
mo AS (SELECT record, lead, max(n) / 64.0::double AS mode_share FROM (SELECT record, lead, v, count(*) AS n FROM lx GROUP BY record, lead, v) GROUP BY record, lead),
lq AS (SELECT record, lead, quantile_cont(v, 0.99) - quantile_cont(v, 0.01) AS amplitude_range, avg((d < 0.045)::int) FILTER (d IS NOT NULL) AS flat_share, avg((d > med + 10 * dm)::int) FILTER (d IS NOT NULL) AS jump_share, max(med) AS median_step, quantile_cont(d, 0.95) AS p95_step FROM dx JOIN md USING (record, lead) GROUP BY record, lead),
lf AS (SELECT lq.*, coalesce(longest, 0) AS longest_flat, mode_share, flat_share > 0.2 AS flat_flag FROM lq LEFT JOIN il USING (record, lead) JOIN mo USING (record, lead))
"""


@query(LEADS + "SELECT record, lead, round(amplitude_range, 6) AS amplitude_range, round(flat_share, 6) AS flat_share, round(jump_share, 6) AS jump_share, longest_flat, round(mode_share, 6) AS mode_share, round(median_step, 6) AS median_step, round(p95_step, 6) AS p95_step, flat_flag FROM lf")
def lead_quality(spark, sf_dir):
    found = quality.lead_quality(leads(spark, sf_dir), "wave", 0.045)
    return found.select("record", "lead", r("amplitude_range", digits=6), r("flat_share", digits=6), r("jump_share", digits=6), "longest_flat", r("mode_share", digits=6), r("median_step", digits=6), r("p95_step", digits=6), "flat_flag")


@query(LEADS + "SELECT record, count(*) AS leads, bool_or(amplitude_range < 0.02) AS low_amplitude, bool_or(flat_flag) AS flatline, round(median(amplitude_range), 6) AS amplitude_median, round(median(flat_share), 6) AS flat_median, round(max(flat_share), 6) AS flat_max, round(max(jump_share), 6) AS jump_max FROM lf GROUP BY record")
def record_quality(spark, sf_dir):
    found = quality.record_quality(quality.lead_quality(leads(spark, sf_dir), "wave", 0.045), ["record"])
    return found.select("record", "leads", "low_amplitude", "flatline", *[r(c, digits=6) for c in ("amplitude_median", "flat_median", "flat_max", "jump_max")])


@query("WITH u AS (SELECT vec_id // 6 AS record, vec_id % 6 AS lead, unnest(embedding::double[]) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT a.record, a.lead, b.lead AS other_lead, corr(a.v, b.v) AS corr FROM u a JOIN u b ON a.record = b.record AND a.i = b.i AND a.lead < b.lead GROUP BY ALL) SELECT record, lead, other_lead, round(corr, 6) AS corr FROM c WHERE abs(corr) > 0.2")
def correlated_pairs(spark, sf_dir):
    rows = waves(spark, sf_dir).select(F.floor(F.col("vec_id") / 6).alias("record"), (F.col("vec_id") % 6).alias("lead"), "embedding")
    return quality.correlated_pairs(rows, ["record"], "lead", "embedding", 0.2).select("record", "lead", "other_lead", r("corr", digits=6))


LIMBS = ("I", "II", "III", "aVR", "aVL", "aVF")
_WIDE = "w AS (SELECT vec_id // 6 AS record, pos, " + ", ".join(f'max(v) FILTER (vec_id % 6 = {k}) AS "{n}"' for k, n in enumerate(LIMBS)) + " FROM (SELECT vec_id, unnest(embedding::double[]) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2 HAVING count(*) = 6)"


@query(
    f"""WITH {_WIDE}, rg AS (SELECT record, list_median([{', '.join(f'quantile_cont("{n}", 0.99) - quantile_cont("{n}", 0.01)' for n in LIMBS)}]) AS scale FROM w GROUP BY record),
x AS (SELECT record, relation, r FROM (SELECT record, 'einthoven' AS relation, "II" - "I" - "III" AS r FROM w UNION ALL SELECT record, 'aVR', "aVR" + ("I" + "II") / 2 FROM w UNION ALL SELECT record, 'aVL', "aVL" - ("I" - "II" / 2) FROM w UNION ALL SELECT record, 'aVF', "aVF" - ("II" - "I" / 2) FROM w))
SELECT record, relation, round(avg(r), 6) AS residual_mean, round(sqrt(avg(r * r)), 6) AS rmse, round(sqrt(avg(r * r)) / any_value(scale), 6) AS relative_rmse FROM x JOIN rg USING (record) GROUP BY record, relation""".replace("list_median(", "list_aggregate(").replace("]) AS scale", "], 'median') AS scale")
)
def limb_residuals(spark, sf_dir):
    rows = waves(spark, sf_dir).withColumn("lead", F.col("vec_id") % 6).groupBy(F.floor(F.col("vec_id") / 6).alias("record")).pivot("lead", list(range(6))).agg(F.first("embedding"))
    rows = rows.select("record", *[F.col(str(k)).alias(n) for k, n in enumerate(LIMBS)]).dropna()
    found = quality.limb_residuals(rows, ["record"], {n: n for n in LIMBS})
    return found.select("record", "relation", *[r(c, digits=6) for c in ("residual_mean", "rmse", "relative_rmse")])


#: Peaks are tops of a record's first lead; steps within two samples of one are near it.
NEAR = """,
pk AS (SELECT record, i - 1 AS p FROM (SELECT record, i, v, lag(v) OVER w AS b, lead(v) OVER w AS a FROM lx WHERE lead = 0 WINDOW w AS (PARTITION BY record ORDER BY i)) WHERE v > 0.1 AND v > b AND v >= a),
nr AS (SELECT *, EXISTS (SELECT 1 FROM pk WHERE pk.record = dx.record AND dx.i - 1 BETWEEN p - 2 AND p + 2) AS near FROM dx WHERE d IS NOT NULL)"""
GRID = LEADS.rstrip() + NEAR + """,
th AS (SELECT unnest([0.025, 0.045, 0.065, 0.105]) AS t),
gr AS (SELECT record, lead, t, avg((d < t)::int) AS low_share, avg((d = 0)::int) AS exact_share, avg((d < t)::int) FILTER (NOT near) AS outside_share FROM nr CROSS JOIN th GROUP BY ALL),
gl AS (SELECT record, lead, t, max(n) AS longest FROM (SELECT record, lead, t, count(*) AS n FROM (SELECT record, lead, t, i - row_number() OVER (PARTITION BY record, lead, t ORDER BY i) AS g FROM dx CROSS JOIN th WHERE d < t) GROUP BY record, lead, t, g) GROUP BY record, lead, t),
tg AS (SELECT gr.*, coalesce(longest, 0) AS longest, low_share > 0.2 AS flag FROM gr LEFT JOIN gl USING (record, lead, t))
"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.with_peaks(leads(spark, sf_dir), lead_peaks(spark, sf_dir), ["record"], "p", 2, "wave")
    return quality.threshold_grid(rows, "wave", (0.025, 0.045, 0.065, 0.105), 1.0, F.col("inside"))


def lead_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several peaks a record: record and p."""
    return leads(spark, sf_dir).filter("lead = 0").select("record", F.explode(quality.tops("wave", 0.1)).alias("p"))


@query(LEADS.rstrip() + NEAR + " SELECT record, lead, count(*) AS steps, count(*) FILTER (NOT near) AS outside, count(*) FILTER (NOT near AND d < 0.045) AS low_outside FROM nr GROUP BY record, lead")
def steps_outside_peaks(spark, sf_dir):
    """Steps of all leads that no peak of their record is near, by a join of points with intervals."""
    steps = leads(spark, sf_dir).select("record", "lead", F.posexplode(quality.differences("wave")).alias("at", "d"))
    around = lead_peaks(spark, sf_dir).select("record", (F.col("p") - 2).alias("start"), (F.col("p") + 2).alias("end"))
    rows = intervals.with_inside(steps, around, ["record"], "at", "start", "end", 16)
    one = lambda c: F.sum(c.cast("long"))
    return rows.groupBy("record", "lead").agg(F.count(F.lit(1)).alias("steps"), one(~F.col("inside")).alias("outside"), one(~F.col("inside") & (F.col("d") < 0.045)).alias("low_outside"))


@query(LEADS.rstrip() + NEAR + " SELECT record, count(DISTINCT x) AS covered FROM (SELECT record, unnest(range(greatest(p - 2, 0), least(p + 2, 62) + 1)) AS x FROM pk) GROUP BY record")
def peak_coverage(spark, sf_dir):
    """How many steps of a record lie near any peak; neighbourhoods overlap."""
    around = lead_peaks(spark, sf_dir).select("record", (F.col("p") - 2).alias("start"), (F.col("p") + 2).alias("end"))
    return intervals.covered(around, ["record"], "start", "end", 16, 0, 62)


@query(GRID + "SELECT record, lead, t::double AS threshold_mv, round(low_share, 6) AS low_share, flag, longest::double AS longest_low_s, round(exact_share, 6) AS exact_share, round(outside_share, 6) AS outside_share FROM tg")
def threshold_grid(spark, sf_dir):
    return grid(spark, sf_dir).select("record", "lead", "threshold_mv", r("low_share", digits=6), "flag", "longest_low_s", r("exact_share", digits=6), r("outside_share", digits=6))


@query(GRID + ", p AS (SELECT record, t, bool_or(flag) AS f FROM tg GROUP BY record, t) SELECT t::double AS threshold_mv, count(*) AS records, round(avg(f::int), 6) AS flag_rate FROM p GROUP BY t")
def saturation(spark, sf_dir):
    return quality.saturation(grid(spark, sf_dir), ["record"]).select("threshold_mv", "records", r("flag_rate", digits=6))


@query(GRID + "SELECT lead, t::double AS threshold_mv, round(avg(flag::int), 6) AS flag_rate, round(median(low_share), 6) AS low_median, median(longest)::double AS longest_median, round(max(low_share), 6) AS low_max FROM tg GROUP BY lead, t")
def lead_summary(spark, sf_dir):
    found = quality.lead_summary(grid(spark, sf_dir), "lead")
    return found.select("lead", "threshold_mv", r("flag_rate", digits=6), r("low_median", digits=6), "longest_median", r("low_max", digits=6))


@query(GRID + ", p AS (SELECT record, t, bool_or(flag) AS f, max(low_share) AS m FROM tg GROUP BY record, t) SELECT t::double AS threshold_mv, round(avg(f::int), 6) AS flag_rate, round(median(m), 6) AS max_median, round(quantile_cont(m, 0.25), 6) AS max_q25, round(quantile_cont(m, 0.75), 6) AS max_q75 FROM p GROUP BY t")
def flat_threshold_table(spark, sf_dir):
    found = quality.flat_thresholds(quality.flat_records(grid(spark, sf_dir), ["record"]))
    return found.select("threshold_mv", *[r(c, digits=6) for c in ("flag_rate", "max_median", "max_q25", "max_q75")])


#: Signals made from events: a user's events, in order, are records of twelve, and a record's events are pulses on twelve leads.
RECORD, PULSES = ["user_id", "record"], 12


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per twelve events of a user, the last ones fewer: their values in order, which ``pulses`` turns into 12 leads x 5000 samples where they are needed."""
    rows = event_queries.timed(spark, sf_dir).withColumn("record", F.floor(F.col("source_index") / PULSES))
    values = F.transform(F.array_sort(F.collect_list(F.struct("source_index", "value"))), lambda e: e["value"])
    return rows.groupBy(*RECORD).agg(values.alias("signal")).withColumn("ok", F.lit(True))


GAINS = np.array([0.4 + 0.1 * k if name != "aVR" else -0.5 for k, name in enumerate(waveforms.LEADS)])
WANDER, PULSE = 0.05 * np.sin(np.arange(5000) / 400.0), np.exp(np.arange(-59, 60) ** 2 / -50.0)


def pulses(values: pa.ListScalar) -> np.ndarray:
    """(time, lead) of a record's values: pulses every 300 to 500 samples, their height from the values; a missing value has none."""
    base = WANDER.copy()
    # pulse k has its middle between 400 k + 150 and 400 k + 249 and ends 60 samples from it, so no sample has two
    for k, v in enumerate(values.as_py()):
        if v is not None:
            at = k * 400 + 150 + int(math.fmod(math.floor(v), 100))
            first, behind = max(at - 59, k * 400 + 90), min(at + 60, k * 400 + 490)
            base[first:behind] += (1 + math.fmod(v, 1)) * PULSE[first - at + 59 : behind - at + 59]
    return np.multiply.outer(GAINS, base).T  # a lead's samples lie together


@query()
def waveform_peaks(spark, sf_dir):
    """Detected peaks of signals made from events; NumPy inside Spark tasks, held to known pulses in the tests."""
    return waveforms.detect(signals(spark, sf_dir), RECORD, decode=pulses).filter("failure_code IS NULL").select(*RECORD, "r_peak_sample", r("amp", digits=6), r("slope", digits=6))


@query()
def waveform_beats(spark, sf_dir):
    """Cut beats of the detected peaks, after repair and validity: the mean beat of each record, whole, on all leads."""
    # a record's signal bounds its events, so all is asked in the row that has them: neither signals nor peaks are stored or sent again
    found = waveforms.detect_whole(signals(spark, sf_dir), RECORD, decode=pulses).filter("failure_code IS NULL")
    kept = let(events.repaired(F.col("peaks"), "r_peak_sample", "amp", "slope"), lambda p: events.valid_events(p, "r_peak_sample", 0.5, 300, 2000))
    # an event's height is the last thing that validity asks for, and known when its beat is cut
    valid = found.select(*RECORD, "signal", kept.alias("cuts")).filter(F.size("cuts") > 0)
    found = waveforms.mean_beats_whole(valid, RECORD, "cuts", decode=pulses, digits=6, largest=20.0, least=3)
    return found.filter("failure_code IS NULL").select(*RECORD, "lead", "n", "wave")


@query()
def detector_grid(spark, sf_dir):
    """Candidates for nine detector settings, summed up over signals made from events."""
    keys = ["min_peak_distance_ms", "mad_multiplier"]
    found = waveforms.detector_grid(signals(spark, sf_dir), RECORD, decode=pulses)
    # records of 10 s have few distinct outcomes, so these are counted as they are found and medians are taken over counts
    counts = found.groupBy(*keys, "peak_count", "rr_in_range_fraction", "beat_gate_pass", "failure_code").agg(F.count(F.lit(1)).alias("n"))
    n, half = F.col("n"), F.lit(0.5)
    return counts.groupBy(*keys).agg(
        F.sum(F.when(F.col("failure_code").isNotNull(), n).otherwise(0)).alias("failed"), (F.sum(F.col("beat_gate_pass").cast("double") * n) / F.sum(n)).alias("pass_rate"),
        F.percentile("peak_count", half, n).alias("peak_median"), r(F.percentile("rr_in_range_fraction", half, n), "rr_median", 6),
    )


@query()
def lead_spectra(spark, sf_dir):
    """Power and band shares per lead of signals made from events."""
    return waveforms.spectra(signals(spark, sf_dir), RECORD, decode=pulses).filter("failure_code IS NULL").select(*RECORD, "lead", *[r(c, digits=6) for c in ("total_power", "baseline_ratio", "power_49_51_ratio", "power_40_100_ratio")], "zero_power")


@query("SELECT doc_id AS path, octet_length(encode(coalesce(text, '')))::bigint AS size, sha256(coalesce(text, '')) AS sha256 FROM documents")
def content_manifest(spark, sf_dir):
    return manifests.content_manifest(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT page_id AS path, CASE WHEN page_id % 10 = 1 THEN 'added' WHEN page_id % 10 = 2 THEN 'removed' WHEN page_id % 10 = 3 THEN 'changed' ELSE 'touched' END AS what FROM pages WHERE page_id % 10 IN (1, 2, 3, 4)")
def manifest_drift(spark, sf_dir):
    """Pages added, removed, changed, and written again as they were."""
    pages = table(spark, sf_dir, "pages")
    at = F.timestamp_seconds(F.col("page_id"))
    manifest = lambda rows: manifests.content_manifest(rows, "page_id", "html").join(rows.select(F.col("page_id").alias("path"), F.col("at").alias("modified")), "path")
    before = manifest(pages.filter("page_id % 10 <> 1").withColumn("at", at))
    moved = pages.filter("page_id % 10 <> 2").withColumn("html", F.when(F.col("page_id") % 10 == 3, F.concat("html", F.lit("x"))).otherwise(F.col("html")))
    return manifests.drift(before, manifest(moved.withColumn("at", F.when(F.col("page_id") % 10 == 4, F.timestamp_seconds(F.col("page_id") + 1)).otherwise(at))))


@query("SELECT vec_id, CASE WHEN vec_id % 5 = 1 THEN 'only_second' WHEN vec_id % 5 = 2 THEN 'only_first' WHEN vec_id % 5 = 3 THEN 'differs' ELSE '' END AS what FROM embeddings")
def recompute_check(spark, sf_dir):
    """A stored table against a recomputed one with rows missing on either side and values moved."""
    rows = waves(spark, sf_dir).select("vec_id", F.col("embedding").cast("array<double>").alias("wave"))
    stored = rows.filter("vec_id % 5 <> 1")
    again = rows.filter("vec_id % 5 <> 2").withColumn("wave", F.when(F.col("vec_id") % 5 == 3, F.transform("wave", lambda x: x + 1e-9)).otherwise(F.col("wave")))
    return checks.compared(stored, again, ["vec_id"], "wave").select("vec_id", "what")


@query("SELECT event_id FROM events WHERE value > 100 AND event_type = 'view'")
def mark_antijoin(spark, sf_dir):
    """Marks without an event among those kept: the kept ones lack the views, so these are found."""
    rows = table(spark, sf_dir, "events")
    return checks.not_in(rows.filter("value > 100").select("event_id"), rows.filter("event_type <> 'view'"), ["event_id"])


@query(CTES + Q + "SELECT f::int AS test_fold, count(*) FILTER (fold <> f) AS train, count(*) FILTER (fold = f) AS test, 0 AS shared FROM em CROSS JOIN (SELECT unnest(range(1, 9)) AS f) GROUP BY f")
def fold_disjointness(spark, sf_dir):
    rows = waves(spark, sf_dir).select("vec_id", "fold").withColumn("test_fold", F.explode(F.array(*[F.lit(f) for f in FOLDS])))
    train, test = rows.filter("fold <> test_fold"), rows.filter("fold = test_fold")
    shared = checks.overlap(train, test, ["vec_id", "test_fold"]).groupBy("test_fold").agg(F.count(F.lit(1)).alias("s"))
    out = rows.groupBy("test_fold").agg(F.sum((F.col("fold") != F.col("test_fold")).cast("long")).alias("train"), F.sum((F.col("fold") == F.col("test_fold")).cast("long")).alias("test"))
    return out.join(shared, "test_fold", "left").select("test_fold", "train", "test", F.coalesce("s", F.lit(0)).cast("int").alias("shared"))


@query("SELECT user_id, coalesce(sum(n) OVER (ORDER BY user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS first, sum(n) OVER (ORDER BY user_id)::bigint AS \"end\", n FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)")
def beat_offsets(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return tables.beat_offsets(counts, [], "user_id", "n", F.floor(F.col("user_id") / 1024)).select("user_id", "first", "end", "n")


@query("SELECT l_orderkey, count(*) AS lines, round(max(l_quantity) - min(l_quantity), 6) AS spread, count(DISTINCT l_linenumber) AS numbers FROM lineitem GROUP BY l_orderkey")
def line_ranges(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), r(F.max("l_quantity") - F.min("l_quantity"), "spread", 6), F.countDistinct("l_linenumber").alias("numbers"))


@query("SELECT conv_id, count(*) AS turns, sum((role = p)::int) AS repeated_roles FROM (SELECT conv_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, text) AS p FROM conversations) GROUP BY conv_id")
def turn_sequences(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    before = F.lag("role").over(events.by(["conv_id"], "turn", "text"))
    return rows.withColumn("p", before).groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum((F.col("role") == F.col("p")).cast("int")).alias("repeated_roles"))


@query("SELECT s_suppkey, s_acctbal < 0 AS failed, CASE WHEN s_acctbal < 0 THEN 'read_failure' WHEN s_suppkey % 5 = 0 THEN 'reader_result_invalid' ELSE '' END AS quality_code FROM supplier")
def quality_status(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").withColumns({"read_ok": F.col("s_acctbal") >= 0, "failure_code": F.lit(""), "has_signal": F.col("s_suppkey") % 5 != 0})
    return quality.quality_status(rows).select("s_suppkey", (~F.col("read_ok")).alias("failed"), "quality_code")
