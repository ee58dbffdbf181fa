"""Cohort queries: customers are patients, their orders records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import md5_int
from ..functions.text import with_stratum
from ..operators import cohorts as C
from .registry import query, r, table

LABELS = ["F", "O"]
SEED, N = 5001, 60


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in the form of the metadata table; broken and empty codes, ages and notes come from the keys."""
    rows = table(spark, sf_dir, "orders")
    key, who = F.col("o_orderkey"), F.col("o_custkey")
    codes = F.when(key % 53 == 0, F.lit("{'F': ")).when(key % 59 == 0, F.lit("")).when(key % 61 == 0, F.lit("{}")).when(key % 7 == 0, F.concat(F.lit("{'"), F.col("o_orderstatus"), F.lit("': 100.0, 'X': 0.0, ' O ': 50.0}"))).otherwise(F.concat(F.lit("{'"), F.col("o_orderstatus"), F.lit("': 100.0, 'X': 0.0}")))
    note = lambda k: F.when(key % k == 0, F.lit("v")).when(key % k == 1, F.lit("  "))
    return rows.select(
        key.alias("ecg_id"), F.when(who % 97 != 0, who.cast("double")).alias("patient_id"), F.when(key % 101 == 0, "300").when(key % 103 == 0, "n/a").otherwise((key % 95).cast("string")).alias("age"), codes.alias("scp_codes"),
        (1 + md5_int(who) % 10).cast("double").alias("strat_fold"), F.concat(F.lit("r/"), key.cast("string")).alias("filename_hr"), F.col("o_orderpriority").alias("device"), F.when(key % 4 != 0, (key % 4).cast("string")).alias("site"),
        note(11).alias("baseline_drift"), note(13).alias("static_noise"), F.lit(None).cast("string").alias("burst_noise"), note(17).alias("electrodes_problems"), F.lit(" ").alias("extra_beats"), note(19).alias("pacemaker"),
    )


def dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("F", 1.0), ("O", 1.0), ("P", 1.0), ("X", None)], "code string, diagnostic double")


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cohort_index(metadata(spark, sf_dir), dictionary(spark), LABELS)


CTES = """
WITH md AS (SELECT o_orderkey AS ecg_id, CASE WHEN o_custkey % 97 <> 0 THEN o_custkey::double END AS patient_id, CASE WHEN o_orderkey % 101 = 0 THEN 300.0 WHEN o_orderkey % 103 = 0 THEN NULL ELSE (o_orderkey % 95)::double END AS age,
  o_orderstatus AS st, (1 + cast('0x' || substr(md5(o_custkey::varchar), 1, 8) AS bigint) % 10)::double AS strat_fold, o_orderpriority AS device, CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 4)::varchar END AS site,
  o_orderkey % 53 = 0 AS broken, o_orderkey % 59 = 0 OR o_orderkey % 61 = 0 AS empty, o_orderkey % 7 = 0 AS more FROM orders),
cd AS (SELECT *, CASE WHEN broken THEN 'malformed_scp_codes' WHEN empty THEN 'empty_scp_codes' ELSE '' END AS code_status,
  CASE WHEN broken OR empty THEN []::varchar[] WHEN more THEN list_sort(list_distinct([st, 'O'])) ELSE [st] END AS diagnostic_codes FROM md),
lb AS (SELECT *, CASE WHEN len(diagnostic_codes) = 1 AND diagnostic_codes[1] IN ('F', 'O') THEN diagnostic_codes[1] END AS label, CASE WHEN strat_fold <= 8 THEN 'train' WHEN strat_fold = 9 THEN 'validation' ELSE 'test' END AS split,
  list_filter([CASE WHEN ecg_id % 11 = 0 THEN 'baseline_drift' END, CASE WHEN ecg_id % 13 = 0 THEN 'static_noise' END, CASE WHEN ecg_id % 17 = 0 THEN 'electrodes_problems' END, CASE WHEN ecg_id % 19 = 0 THEN 'pacemaker' END], lambda x: x IS NOT NULL) AS quality_note_fields FROM cd),
cf AS (SELECT patient_id, count(DISTINCT label) > 1 AS c FROM lb WHERE patient_id IS NOT NULL AND label IS NOT NULL GROUP BY patient_id),
ci AS (SELECT lb.*, CASE WHEN lb.patient_id IS NOT NULL THEN coalesce(c, false) END AS patient_label_conflict FROM lb LEFT JOIN cf USING (patient_id)),
ix AS (SELECT *, coalesce(label IS NOT NULL AND split = 'train' AND patient_id IS NOT NULL AND NOT patient_label_conflict, false) AS sampling_eligible FROM ci),
rh AS (SELECT *, sha256('record|5001|' || patient_id::varchar || '|' || ecg_id) AS record_hash FROM ix WHERE sampling_eligible),
op AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label, patient_id ORDER BY record_hash, ecg_id::varchar) AS k FROM rh) WHERE k = 1),
"""


@query(CTES + "q AS (SELECT 1) SELECT ecg_id, patient_id, split, label, code_status, CASE WHEN code_status <> '' THEN code_status WHEN len(diagnostic_codes) = 0 THEN 'no_diagnostic_codes' ELSE '' END AS label_status, list_aggregate(diagnostic_codes, 'string_agg', ';') AS diagnostic, CASE WHEN age <> 300 THEN age END AS age_years, coalesce(age >= 90, false) AS age_90_plus, len(quality_note_fields) AS notes, patient_label_conflict, sampling_eligible FROM ix")
def cohort_index(spark, sf_dir):
    joined = F.when(F.size("diagnostic_codes") > 0, F.array_join("diagnostic_codes", ";"))
    return index(spark, sf_dir).select("ecg_id", "patient_id", "split", "label", "code_status", "label_status", joined.alias("diagnostic"), "age_years", "age_90_plus", F.col("quality_note_count").alias("notes"), "patient_label_conflict", "sampling_eligible")


@query(CTES + "q AS (SELECT unnest(diagnostic_codes) AS code, code_status FROM ix) SELECT code, count(*) AS n FROM q GROUP BY code")
def diagnostic_codes(spark, sf_dir):
    return index(spark, sf_dir).select(F.explode("diagnostic_codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(CTES + "q AS (SELECT unnest(quality_note_fields) AS field FROM ix) SELECT field, count(*) AS n FROM q GROUP BY field")
def quality_notes(spark, sf_dir):
    return index(spark, sf_dir).select(F.explode("quality_note_fields").alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def one_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.one_per_patient(C.candidates(index(spark, sf_dir), LABELS), SEED)


@query(CTES + "q AS (SELECT 1) SELECT ecg_id, patient_id, label, record_hash FROM op")
def eligible_one_per_patient(spark, sf_dir):
    return one_each(spark, sf_dir).select("ecg_id", "patient_id", "label", "record_hash")


SAMPLE = f"""st AS (SELECT *, '["' || device || '","' || coalesce(site, '<MISSING>') || '"]' AS stratum, sha256('sample|5001|' || label || '|' || patient_id::varchar) AS sample_hash FROM op),
sz AS (SELECT label, stratum, count(*) AS size, sum(count(*)) OVER (PARTITION BY label) AS total FROM st GROUP BY label, stratum),
qf AS (SELECT *, ({N} * size // total)::bigint AS f, ({N} * size) % total AS rest FROM sz),
qt AS (SELECT label, stratum, size, total::bigint AS total, least(size, f + (row_number() OVER (PARTITION BY label ORDER BY rest DESC, stratum) <= {N} - sum(f) OVER (PARTITION BY label))::int)::bigint AS quota FROM qf),
sp AS (SELECT st.*, quota, row_number() OVER (PARTITION BY st.label, st.stratum ORDER BY sample_hash, ecg_id) AS stratum_rank FROM st JOIN qt ON st.label = qt.label AND st.stratum = qt.stratum),
sa AS (SELECT *, sha256('role|5001|' || label || '|' || patient_id::varchar) AS role_hash FROM sp WHERE stratum_rank <= quota),
ro AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY role_hash, ecg_id) AS role_rank, count(*) OVER (PARTITION BY label) AS n FROM sa),
"""


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.stratified_sample(one_each(spark, sf_dir), ["device", "site"], N, SEED)


@query(CTES + SAMPLE + "q AS (SELECT 1) SELECT label, stratum, size, total, quota FROM qt")
def sample_quotas(spark, sf_dir):
    return C.quotas(with_stratum(one_each(spark, sf_dir), ["device", "site"]), N)


NAMES = ("caf\u00e9", "cafe\u0301", "true", " \u00c5ngstr\u00f6m\u00a0", "A\u030angstro\u0308m", " \t")


@query(
    f"""WITH c AS (SELECT c_acctbal > 0 AS b, CASE c_custkey % 7 {' '.join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(NAMES))} END AS n FROM customer),
t AS (SELECT b, coalesce(nullif(trim(nfc_normalize(n), ' ' || chr(9) || chr(160)), ''), '<MISSING>') AS n FROM c)
SELECT '["' || n || '","' || b::int || '"]' AS stratum, count(*) AS n FROM t GROUP BY ALL"""
)
def strata_of_any_form(spark, sf_dir):
    """Strata by names that come composed and decomposed, by text that says true, and by a boolean."""
    name = F.when(F.lit(False), "")
    for k, n in enumerate(NAMES):
        name = name.when(F.col("c_custkey") % 7 == k, n)
    rows = table(spark, sf_dir, "customer").select(name.alias("name"), (F.col("c_acctbal") > 0).alias("rich"))
    return with_stratum(rows, ["name", "rich"]).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))


@query(CTES + SAMPLE + "q AS (SELECT 1) SELECT ecg_id, label, stratum, stratum_rank, sample_hash FROM sa")
def stratified_sample(spark, sf_dir):
    return sample(spark, sf_dir).select("ecg_id", "label", "stratum", "stratum_rank", "sample_hash")


@query(CTES + SAMPLE + "q AS (SELECT 1) SELECT ecg_id, label, role_rank, CASE WHEN role_rank <= CASE WHEN n = 150 THEN 100 ELSE ceil(2 * n / 3) END THEN 'prototype_pool' ELSE 'exploratory_probe' END AS role FROM ro")
def sample_roles(spark, sf_dir):
    return C.roles(sample(spark, sf_dir), SEED).select("ecg_id", "label", "role_rank", "role")


FAILED = "fl AS (SELECT *, CASE WHEN ecg_id % 23 = 0 THEN 'read' WHEN ecg_id % 29 = 0 THEN 'beat' END AS failure, CASE WHEN ecg_id % 31 <> 0 THEN ecg_id % 13 END AS amplitude FROM ix WHERE label IS NOT NULL),"


def failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled records with failure codes of two steps and an amplitude."""
    key = F.col("ecg_id")
    rows = index(spark, sf_dir).filter(F.col("label").isNotNull()).withColumns({"read_code": F.when(key % 23 == 0, "read").when(key % 23 == 1, " "), "beat_code": F.when(key % 29 == 0, "beat"), "amplitude": F.when(key % 31 != 0, key % 13)})
    return rows.withColumns({"failure": C.first_failure("read_code", "beat_code"), "sample_hash": F.sha2(key.cast("string"), 256)})


@query(CTES + FAILED + "q AS (SELECT *, dense_rank() OVER (ORDER BY amplitude NULLS LAST) AS range_rank, sha256(ecg_id::varchar) AS sample_hash FROM fl) SELECT ecg_id, label, failure, range_rank, place FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY failure NULLS LAST, range_rank, sample_hash) AS place FROM q) WHERE place <= 5")
def casebook_top5(spark, sf_dir):
    ranked = C.with_range_rank(failed(spark, sf_dir), "amplitude")
    return C.casebook(ranked, ["label"], [F.col("failure").asc_nulls_last(), "range_rank", "sample_hash"]).select("ecg_id", "label", "failure", "range_rank", "place")


@query(CTES + FAILED + "q AS (SELECT *, sha256(ecg_id::varchar) AS sample_hash FROM fl WHERE failure IS NULL) SELECT ecg_id, label, place FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sample_hash) AS place FROM q) WHERE place <= 5")
def controls_top5(spark, sf_dir):
    return C.casebook(failed(spark, sf_dir).filter("failure IS NULL"), ["label"], ["sample_hash"]).select("ecg_id", "label", "place")


@query(CTES + FAILED + "q AS (SELECT ecg_id, label, failure IS NULL AS ok, len(quality_note_fields) > 0 AS flags, coalesce(amplitude, 0) AS beats, 2 * (failure IS NULL)::int + (len(quality_note_fields) > 0)::int AS priority FROM fl), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY priority, beats, ecg_id) AS k FROM q) WHERE k <= 10) SELECT DISTINCT ecg_id, label, priority FROM (SELECT ecg_id, label, priority FROM f UNION ALL SELECT ecg_id, label, priority FROM q WHERE NOT ok OR ecg_id IN (1, 2))")
def review_top10(spark, sf_dir):
    rows = failed(spark, sf_dir).select("ecg_id", "label", F.col("failure").isNull().alias("ok"), F.col("has_quality_note").alias("flags"), F.coalesce("amplitude", F.lit(0)).alias("beats"))
    return C.review_list(rows, "label", "ok", "flags", "beats", named=(1, 2)).select("ecg_id", "label", "priority")


@query(CTES + "q AS (SELECT 1) SELECT strat_fold, count(*) AS \"rows\", count(label) AS labelled, sum(sampling_eligible::int) AS eligible, count(DISTINCT patient_id) AS patients FROM ix GROUP BY strat_fold")
def cohort_summary(spark, sf_dir):
    return C.cohort_summary(index(spark, sf_dir))


GATE = """q AS (SELECT label, count(*) FILTER (failure IS NULL) AS n FROM fl GROUP BY label),
g AS (SELECT count(*) AS records, sum((failure IS DISTINCT FROM 'read')::int) AS read_ok, sum((failure IS NULL)::int) AS beat_ok, (SELECT CASE WHEN count(*) = 2 THEN min(n) ELSE 0 END FROM q) AS prototypes_min,
  (SELECT count(*) FROM (SELECT ecg_id // 6 FROM fl GROUP BY 1 HAVING count(*) = 6 AND bool_and(failure IS NULL))) AS probes_ok FROM fl)
"""


@query(CTES + FAILED + GATE + "SELECT *, read_ok >= 297 AND beat_ok >= 270 AND prototypes_min >= 20 AND probes_ok >= 80 AS gate_pass FROM g")
def success_gate(spark, sf_dir):
    """A probe is six records in a row, its cells."""
    rows = failed(spark, sf_dir)
    probes = rows.select(F.floor(F.col("ecg_id") / 6).alias("probe"), F.col("failure").isNull().alias("ok"))
    return C.success_gate(rows, ~F.col("failure").eqNullSafe("read"), F.col("failure").isNull(), 297, 270, "label", F.col("failure").isNull(), 20, probes=probes)


@query(CTES + "q AS (SELECT 1) SELECT patient_id, count(DISTINCT split) AS splits, bool_or(patient_label_conflict) AS conflict, count(*) AS records FROM ix WHERE patient_id IS NOT NULL GROUP BY patient_id")
def patient_checks(spark, sf_dir):
    rows = index(spark, sf_dir).filter(F.col("patient_id").isNotNull())
    return rows.groupBy("patient_id").agg(F.countDistinct("split").alias("splits"), F.bool_or("patient_label_conflict").alias("conflict"), F.count(F.lit(1)).alias("records"))


@query(
    "WITH f AS (SELECT o_orderkey AS k, 'r/' || o_orderkey AS stem, o_orderkey % 3 <> 0 AS h, o_orderkey % 5 <> 0 AS d FROM orders) SELECT k AS ecg_id, stem || '.hea' AS header_path, CASE WHEN h AND d THEN 'present' WHEN h THEN 'missing_dat' WHEN d THEN 'missing_hea' ELSE 'missing_both' END AS file_status FROM f"
)
def file_status(spark, sf_dir):
    rows = metadata(spark, sf_dir)
    return C.with_files(rows, sidecars(rows)).select("ecg_id", "header_path", "file_status")


def sidecars(rows: DataFrame) -> DataFrame:
    """The files that are there: every third header is missing, and every fifth data file."""
    return rows.filter("ecg_id % 3 <> 0").select(F.concat("filename_hr", F.lit(".hea")).alias("path")).unionByName(rows.filter("ecg_id % 5 <> 0").select(F.concat("filename_hr", F.lit(".dat")).alias("path")))


@query("SELECT c_mktsegment, n_name, count(*) AS customers, round(avg(c_acctbal), 6) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def strata_sizes(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf_dir, "customer").join(nations, "c_nationkey").groupBy("c_mktsegment", "n_name").agg(F.count(F.lit(1)).alias("customers"), r(F.avg("c_acctbal"), "balance", 6))
