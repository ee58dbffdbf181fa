"""Score queries: labelled documents as records, scores of models A, B and C as functions of hashes and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import first_per_group
from ..functions.scalar import fold_of, md5_int
from ..functions.storage import written
from ..operators import checks, logistic, metrics
from .registry import query, r, table

SEEDS = [0, 1, 2, 3, 4, 5]
CFG = ["stage", "seed", "model"]
REPLICATES = 1000


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("label"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    return labels.join(docs, "doc_id").withColumn("fold", fold_of("doc_id"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per record, model and seed; only C depends on the seed, and records in fold 8 of strict stages have no score."""
    rows = labelled(spark, sf_dir).withColumns({"model": F.explode(F.array(*[F.lit(m) for m in "ABC"])), "stage": F.explode(F.array(F.lit("stage1"), F.lit("stage2")))})
    rows = rows.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in SEEDS])))
    drawn = md5_int(F.col("stage"), F.col("model"), F.when(F.col("model") == "C", F.col("seed")).otherwise(0), F.col("doc_id")) % 1000
    score = (drawn + 250 * F.col("label")) / F.lit(1250.0)
    return rows.withColumn("score", F.when(~((F.col("stage") == "stage2") & (F.col("fold") == 8)), score)).select("stage", "seed", "model", "doc_id", "fold", "label", "score")


CTES = """
WITH lb AS (SELECT doc_id, quality AS label, n_chars, source, (1 + cast('0x' || substr(md5(doc_id::varchar), 1, 8) AS bigint) % 8)::int AS fold FROM labels JOIN documents USING (doc_id) WHERE quality IN (0, 1)),
pr AS (SELECT stage, seed, model, doc_id, fold, label, CASE WHEN NOT (stage = 'stage2' AND fold = 8) THEN
  (cast('0x' || substr(md5(stage || '|' || model || '|' || CASE WHEN model = 'C' THEN seed ELSE 0 END || '|' || doc_id), 1, 8) AS bigint) % 1000 + 250 * label) / 1250.0::double END AS score
  FROM lb CROSS JOIN (SELECT unnest(['A', 'B', 'C']) AS model) CROSS JOIN (SELECT unnest(['stage1', 'stage2']) AS stage) CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4, 5]) AS seed)),
"""


def oof_sql(name: str, keys: str) -> str:
    """Average-rank AUROC from ranks, not from running sums."""
    on = " AND ".join(f"a.{k.strip()} = c.{k.strip()}" for k in keys.split(","))
    return f"""{name}r AS (SELECT {keys}, label, rank() OVER (PARTITION BY {keys} ORDER BY score) + (count(*) OVER (PARTITION BY {keys}, score) - 1) / 2.0::double AS rk FROM pr WHERE score IS NOT NULL),
{name}a AS (SELECT {keys}, (sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0::double) / nullif(count(*) FILTER (label = 1) * count(*) FILTER (label = 0), 0) AS auroc FROM {name}r GROUP BY {keys}),
{name}c AS (SELECT {keys}, count(*) AS expected, count(score) AS evaluated, (avg((score >= 0.5)::int) FILTER (label = 1 AND score IS NOT NULL) + avg((score < 0.5)::int) FILTER (label = 0 AND score IS NOT NULL)) / 2 AS ba FROM pr GROUP BY {keys}),
{name} AS (SELECT {', '.join('c.' + k.strip() for k in keys.split(','))}, expected, evaluated, expected - evaluated AS missing, round(auroc, 8) AS auroc, round(ba, 8) AS balanced_accuracy, CASE WHEN expected = evaluated THEN 'complete' ELSE 'partial_not_full_CV' END AS coverage FROM {name}c c LEFT JOIN {name}a a ON {on}),
"""


POOLED, BY_FOLD = oof_sql("po", "stage, seed, model"), oof_sql("bf", "stage, seed, model, fold")
DONE = "q AS (SELECT 1) "


def pooled(spark: SparkSession, sf_dir: str, keys: list[str]) -> DataFrame:
    found = metrics.oof_metrics(predictions(spark, sf_dir), keys)
    return found.select(*keys, "expected", "evaluated", "missing", r("auroc", digits=8), r("balanced_accuracy", digits=8), "coverage")


@query(CTES + POOLED + DONE + "SELECT * FROM po")
def oof_metrics(spark, sf_dir):
    return pooled(spark, sf_dir, CFG)


@query(CTES + BY_FOLD + DONE + "SELECT * FROM bf")
def oof_metrics_by_fold(spark, sf_dir):
    return pooled(spark, sf_dir, [*CFG, "fold"])


@query(CTES + POOLED + BY_FOLD + DONE + ", x AS (SELECT stage, seed, model, 'pooled' AS level, NULL::int AS fold, expected, evaluated, missing, auroc, balanced_accuracy, coverage FROM po UNION ALL SELECT stage, seed, model, 'fold', fold, expected, evaluated, missing, auroc, balanced_accuracy, coverage FROM bf) SELECT * FROM x")
def oof_metrics_levels(spark, sf_dir):
    """Pooled metrics and those of each fold, from one scan of the predictions."""
    found = metrics.oof_metrics_levels(predictions(spark, sf_dir), CFG, "fold")
    return found.select(*CFG, "level", "fold", "expected", "evaluated", "missing", r("auroc", digits=8), r("balanced_accuracy", digits=8), "coverage")


@query(
    CTES
    + POOLED
    + DONE
    + """, s AS (SELECT stage, seed, model, evaluated - (seed = 2 AND model = 'B')::int AS evaluated, auroc + CASE WHEN seed = 1 AND model = 'A' THEN 0.01 WHEN seed = 1 AND model = 'C' THEN 1e-9 ELSE 0 END AS auroc, CASE WHEN seed = 4 AND model = 'A' THEN NULL ELSE balanced_accuracy END AS ba FROM po WHERE NOT (seed = 3 AND model = 'C')
  UNION ALL SELECT 'stage3', seed, model, evaluated, auroc, balanced_accuracy FROM po WHERE stage = 'stage1' AND seed = 0)
SELECT coalesce(s.stage, po.stage) AS stage, coalesce(s.seed, po.seed) AS seed, coalesce(s.model, po.model) AS model, CASE WHEN s.stage IS NULL THEN 'not_stored' WHEN po.stage IS NULL THEN 'not_recomputed' WHEN s.evaluated <> po.evaluated THEN 'evaluated' WHEN abs(s.auroc - po.auroc) > 1e-8 + 1e-5 * abs(po.auroc) THEN 'auroc' WHEN s.ba IS NULL OR abs(s.ba - po.balanced_accuracy) > 1e-8 + 1e-5 * abs(po.balanced_accuracy) THEN 'balanced_accuracy' ELSE '' END AS what
FROM s FULL JOIN po ON s.stage = po.stage AND s.seed = po.seed AND s.model = po.model"""
)
def stored_metrics(spark, sf_dir):
    """Metrics as they were stored, some of them altered, lost or added on purpose, against those recomputed from the predictions."""
    found = metrics.oof_metrics(predictions(spark, sf_dir), CFG)
    at = lambda seed, model: (F.col("seed") == seed) & (F.col("model") == model)
    altered = found.withColumns({
        "evaluated": F.col("evaluated") - at(2, "B").cast("int"), "auroc": F.col("auroc") + F.when(at(1, "A"), 0.01).when(at(1, "C"), 1e-9).otherwise(0.0), "balanced_accuracy": F.when(~at(4, "A"), F.col("balanced_accuracy")),
    })
    stored = written(altered.filter(~at(3, "C")).unionByName(altered.filter("stage = 'stage1' AND seed = 0").withColumn("stage", F.lit("stage3"))), "stored")
    return checks.differing_metrics(stored, found, CFG)


@query(CTES + BY_FOLD + DONE + "SELECT stage, seed, model, count(auroc) AS n, round(median(auroc), 6) AS median, round(quantile_cont(auroc, 0.75) - quantile_cont(auroc, 0.25), 6) AS iqr FROM bf GROUP BY stage, seed, model")
def fold_auc_spread(spark, sf_dir):
    return metrics.spread(pooled(spark, sf_dir, [*CFG, "fold"]), CFG, "auroc").select(*CFG, "n", r("median", digits=6), r("iqr", digits=6))


@query(
    CTES
    + POOLED
    + DONE
    + "SELECT stage, count(*) AS seeds, round(avg(auroc), 6) AS auroc_mean, round(stddev_samp(auroc), 6) AS auroc_sd, min(auroc) AS auroc_min, max(auroc) AS auroc_max, round(avg(balanced_accuracy), 6) AS ba_mean, round(stddev_samp(balanced_accuracy), 6) AS ba_sd, min(evaluated) AS evaluated_min FROM po WHERE model = 'C' AND seed <> 0 GROUP BY stage"
)
def shuffle_summary(spark, sf_dir):
    found = metrics.shuffle_summary(pooled(spark, sf_dir, CFG), ["stage"])
    return found.select("stage", "seeds", *[r(c, digits=6) for c in ("auroc_mean", "auroc_sd")], "auroc_min", "auroc_max", *[r(c, digits=6) for c in ("ba_mean", "ba_sd")], "evaluated_min")


@query(CTES + DONE + ', w AS (SELECT stage, seed, doc_id, fold, label, max(score) FILTER (model = \'A\') AS "A", max(score) FILTER (model = \'B\') AS "B", max(score) FILTER (model = \'C\') AS "C" FROM pr GROUP BY stage, seed, doc_id, fold, label) SELECT stage, seed, doc_id, fold, label, round("A", 6) AS "A", round("B", 6) AS "B", round("C", 6) AS "C" FROM w')
def oof_wide(spark, sf_dir):
    found = metrics.wide(predictions(spark, sf_dir), ["stage", "seed", "doc_id", "fold", "label"])
    return found.select("stage", "seed", "doc_id", "fold", "label", *[r(m, digits=6) for m in "ABC"])


@query(CTES + DONE + "SELECT stage, seed, doc_id, count(DISTINCT model) AS have, 2 AS variants FROM pr WHERE NOT (model = 'B' AND doc_id % 7 = 0) AND model <> 'A' GROUP BY stage, seed, doc_id HAVING count(DISTINCT model) <> 2")
def model_coverage(spark, sf_dir):
    """Records that one of two models was not asked about: every seventh is left out on purpose."""
    rows = predictions(spark, sf_dir).filter(~((F.col("model") == "B") & (F.col("doc_id") % 7 == 0)) & (F.col("model") != "A"))
    return checks.uneven_sets(rows, ["stage", "seed"], "model", "doc_id").select("stage", "seed", "doc_id", "have", F.col("variants").cast("int").alias("variants"))


@query(CTES + DONE + "SELECT stage, model, doc_id, count(DISTINCT score) AS \"values\" FROM pr GROUP BY stage, model, doc_id HAVING count(DISTINCT score) > 1")
def seed_dependence(spark, sf_dir):
    """Only model C may depend on the seed, and does."""
    return checks.seed_dependent(predictions(spark, sf_dir), ["stage", "model", "doc_id"])


@query(CTES + DONE + "SELECT doc_id FROM (SELECT doc_id, stage FROM pr WHERE score IS NOT NULL AND model = 'A' AND seed = 0) GROUP BY doc_id HAVING count(DISTINCT stage) = 2")
def common_valid(spark, sf_dir):
    rows = predictions(spark, sf_dir).filter((F.col("model") == "A") & (F.col("seed") == 0))
    return checks.common_to_all(rows, F.col("score").isNotNull(), "doc_id", "stage", 2)


@query(CTES + DONE + "SELECT stage, seed, model, doc_id, count(*) AS \"rows\" FROM (SELECT * FROM pr UNION ALL SELECT * FROM pr WHERE doc_id % 11 = 0 AND model = 'A') GROUP BY ALL HAVING count(*) <> 1")
def repeated_predictions(spark, sf_dir):
    """One prediction per configuration and record: rows repeated on purpose are found."""
    rows = predictions(spark, sf_dir)
    both = checks.union_all(rows, rows.filter((F.col("doc_id") % 11 == 0) & (F.col("model") == "A")))
    return checks.not_once(both, [*CFG, "doc_id"])


def _auroc(name: str, score: str) -> str:
    return f"{name} AS (SELECT rep, (sum(c * (nb + n0 / 2.0::double))) / (sum(c) * sum(n0)) AS auroc FROM (SELECT rep, s, c, n0, coalesce(sum(n0) OVER (PARTITION BY rep ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM (SELECT rep, {score} AS s, sum(w) FILTER (label = 1) AS c1, coalesce(sum(w) FILTER (label = 1), 0) AS c, coalesce(sum(w) FILTER (label = 0), 0) AS n0 FROM dr GROUP BY rep, {score})) GROUP BY rep)"


def _balanced(score: str) -> str:
    return f"(sum(w) FILTER (label = 1 AND {score} >= 0.5) / sum(w) FILTER (label = 1) + sum(w) FILTER (label = 0 AND {score} < 0.5) / sum(w) FILTER (label = 0)) / 2"


def bootstrap_sql(first: str, second: str) -> str:
    """Of two sets of rows of ``pr``; draws by hash, ranks by running sums of weights."""
    return f"""
ix AS (SELECT doc_id, label, "A" AS f, "B" AS s, row_number() OVER (PARTITION BY label ORDER BY cast('0x' || substr(md5(doc_id::varchar), 1, 8) AS bigint) % 256, doc_id) - 1 AS k FROM
  (SELECT doc_id, label, max(score) FILTER ({first}) AS "A", max(score) FILTER ({second}) AS "B" FROM pr WHERE stage = 'stage1' GROUP BY doc_id, label)),
sz AS (SELECT label, count(*) AS size FROM ix GROUP BY label),
dw AS (SELECT rep, ix.label, cast('0x' || substr(md5('5001|' || rep || '|' || ix.label || '|' || k), 1, 8) AS bigint) % size AS k, count(*) AS w FROM ix JOIN sz USING (label) CROSS JOIN (SELECT unnest(range(0, {REPLICATES})) AS rep) GROUP BY ALL),
dr AS (SELECT rep, dw.label, f, s, w FROM dw JOIN ix USING (label, k) UNION ALL SELECT -1, label, f, s, 1 FROM ix),
{_auroc('a1', 'f')}, {_auroc('a2', 's')},
bb AS (SELECT rep, {_balanced('s')} - {_balanced('f')} AS ba FROM dr GROUP BY rep),
dl AS (SELECT rep, a2.auroc - a1.auroc AS auroc, ba FROM a1 JOIN a2 USING (rep) JOIN bb USING (rep))
SELECT round(max(auroc) FILTER (rep = -1), 6) AS delta_auroc, round(quantile_cont(auroc, 0.025) FILTER (rep >= 0), 6) AS auroc_low, round(quantile_cont(auroc, 0.975) FILTER (rep >= 0), 6) AS auroc_high,
  round(max(ba) FILTER (rep = -1), 6) AS delta_ba, round(quantile_cont(ba, 0.025) FILTER (rep >= 0), 6) AS ba_low, round(quantile_cont(ba, 0.975) FILTER (rep >= 0), 6) AS ba_high, count(*) FILTER (rep >= 0) AS replicates FROM dl
"""


A_B = ("seed = 0 AND model = 'A'", "seed = 0 AND model = 'B'")
B_C = ("seed = 0 AND model = 'B'", "seed = 0 AND model = 'C'")
C_SHUFFLED = ("seed = 1 AND model = 'C'", "seed = 0 AND model = 'C'")


def bootstrapped(spark: SparkSession, sf_dir: str, first: str, second: str) -> DataFrame:
    rows = predictions(spark, sf_dir).filter("stage = 'stage1'")
    pairs = rows.filter(first).select("doc_id", "label", F.col("score").alias("first")).join(rows.filter(second).select("doc_id", F.col("score").alias("second")), "doc_id")
    found = metrics.paired_bootstrap(pairs, "first", "second", "doc_id", replicates=REPLICATES)
    return found.select(*[r(c, digits=6) for c in ("delta_auroc", "auroc_low", "auroc_high", "delta_ba", "ba_low", "ba_high")], "replicates")


@query(CTES + bootstrap_sql(*A_B))
def paired_bootstrap(spark, sf_dir):
    return bootstrapped(spark, sf_dir, *A_B)


@query(CTES + bootstrap_sql(*B_C))
def paired_bootstrap_c_b(spark, sf_dir):
    """Model C against model B."""
    return bootstrapped(spark, sf_dir, *B_C)


@query(CTES + bootstrap_sql(*C_SHUFFLED))
def paired_bootstrap_shuffled(spark, sf_dir):
    """Model C in its own order against C in a shuffled one."""
    return bootstrapped(spark, sf_dir, *C_SHUFFLED)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three features of labelled documents, one of them with missing values."""
    rows = labelled(spark, sf_dir).withColumn("size", F.log1p(F.col("n_chars").cast("double")))
    return rows.withColumns({"noise": (md5_int("doc_id") % 997) / F.lit(997.0), "source_code": F.when(F.col("doc_id") % 9 != 0, (md5_int(F.col("source")) % 101).cast("double"))}).select("doc_id", "fold", "label", "size", "noise", "source_code")


FEATURES = ["size", "noise", "source_code"]


@query()
def fold_logistic(spark, sf_dir):
    """Out-of-fold scores of a logistic model: iterative, held to a Newton solution in the tests."""
    found = logistic.fold_scores(features(spark, sf_dir), [], "fold", "label", FEATURES, range(1, 9))
    return found.select("doc_id", "fold", "label", r("score", digits=6))


@query(CTES + DONE + "SELECT doc_id, (doc_id % 9 = 0)::int AS missing FROM lb")
def missing_features(spark, sf_dir):
    return features(spark, sf_dir).select("doc_id", logistic.missing_count(FEATURES).alias("missing"))


@query(
    CTES
    + DONE
    + ", f AS (SELECT fold, ln(1 + n_chars::double) AS x FROM lb) SELECT t::int AS test_fold, round(median(x), 6) AS median, round(stddev_samp(x), 6) AS sd FROM f JOIN (SELECT unnest(range(1, 9)) AS t) ON fold <> t GROUP BY t"
)
def training_scales(spark, sf_dir):
    found = logistic.training_scales(features(spark, sf_dir), [], "fold", ["size"], range(1, 9))
    return found.select("test_fold", r(F.col("medians")[0], "median", 6), r(F.col("sds")[0], "sd", 6))


@query(CTES + DONE + "SELECT label, count(*) AS n, round(avg(n_chars), 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n_chars DESC, doc_id) AS k FROM lb) WHERE k <= 20 GROUP BY label")
def longest_per_label(spark, sf_dir):
    rows = first_per_group(labelled(spark, sf_dir), ["label"], [F.desc("n_chars"), "doc_id"], 20)
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), r(F.avg("n_chars"), "mean", 6))
