"""Queries over tables that were written and read again, and over rules that tables must keep."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import storage
from ..functions.scalar import as_json, joined
from ..functions.storage import shared_dir
from ..operators import checks, events, logistic, quality
from ..operators import cohorts as C
from ..operators.waveforms import LEADS
from ..sources import records, tables
from . import cohort_queries, event_queries, score_queries, wave_queries
from .registry import query, r, table


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/pulseweave/{name}-{uuid.uuid4().hex}"


@query(cohort_queries.CTES + "q AS (SELECT 1) SELECT o_orderkey AS ecg_id, CASE WHEN o_custkey % 97 <> 0 THEN o_custkey::double END AS patient_id, CASE WHEN o_orderkey % 101 = 0 THEN '300' WHEN o_orderkey % 103 = 0 THEN 'n/a' ELSE (o_orderkey % 95)::varchar END AS age, (1 + cast('0x' || substr(md5(o_custkey::varchar), 1, 8) AS bigint) % 10)::double AS strat_fold, o_orderpriority AS device, CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 4)::varchar END AS site FROM orders")
def metadata_csv(spark, sf_dir):
    """The metadata as a CSV file with columns in another order and one that is not wanted."""
    path, rows = _path(spark, "metadata"), cohort_queries.metadata(spark, sf_dir)
    rows.select(F.lit("x").alias("other"), *reversed(rows.columns)).write.option("header", True).option("escape", '"').csv(path)
    return tables.read_metadata(spark, path).select("ecg_id", "patient_id", "age", "strat_fold", "device", "site")


@query("SELECT DISTINCT p_type AS code, CASE WHEN length(p_type) % 2 = 0 THEN 1.0::double END AS diagnostic FROM part")
def code_dictionary_csv(spark, sf_dir):
    path = _path(spark, "codes")
    parts = table(spark, sf_dir, "part").select(F.col("p_type").alias("any name"), F.when(F.length("p_type") % 2 == 0, "1.0").otherwise("no").alias("diagnostic")).distinct()
    parts.write.option("header", True).option("escape", '"').csv(path)
    return tables.read_code_dictionary(spark, path)


@query("SELECT 1 AS schema_version, s_suppkey, CASE WHEN s_suppkey % 5 NOT IN (0, 1) THEN round(s_acctbal, 2) END AS balance FROM supplier")
def stored_results(spark, sf_dir):
    """A result table with numbers that are not finite, written once as CSV and read again; a second run must not overwrite it."""
    path, key = _path(spark, "results"), F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(key % 5 == 0, F.lit(float("nan"))).when(key % 5 == 1, F.lit(float("inf"))).otherwise(F.col("s_acctbal").cast("double")).alias("balance"))
    tables.write_results(rows, path, "csv")
    try:
        tables.write_results(rows, path, "csv")
    except Exception as e:
        if "PATH_ALREADY_EXISTS" not in str(e):
            raise
    else:
        raise AssertionError("a run was overwritten")
    return tables.read_results(spark, path, "schema_version int, s_suppkey long, balance double").select("schema_version", "s_suppkey", r("balance", digits=2))


@query(
    """WITH g AS (SELECT vec_id // 6 AS record, count(*) AS n FROM embeddings GROUP BY 1)
SELECT record, CASE WHEN record % 17 = 0 THEN 'read_failure' WHEN record % 7 = 0 THEN 'sampling_rate_mismatch' WHEN n <> 6 THEN 'shape_mismatch' WHEN record % 11 = 0 THEN 'noncanonical_leads' WHEN record % 13 = 0 THEN 'nonfinite_signal' END AS failure_code,
  NOT (record % 17 = 0 OR record % 7 = 0 OR n <> 6 OR record % 11 = 0 OR record % 13 = 0) AS ok FROM g"""
)
def shape_gate(spark, sf_dir):
    """Records of six vectors as leads; some of another rate, order of leads or with a value that is not finite."""
    names, at = LEADS[:6], F.col("record")
    rows = table(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / 6).alias("record")).agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda e: e["embedding"]).alias("signal"))
    given = F.array(*[F.lit(n) for n in names])
    rows = rows.withColumns({
        "ok": at % 17 != 0, "failure_code": F.when(at % 17 == 0, "read_failure"), "sampling_rate": F.when(at % 7 == 0, 250.0).otherwise(500.0), "lead_names": F.when(at % 11 == 0, F.reverse(given)).otherwise(given),
        "signal": F.when(at % 13 == 0, F.transform("signal", lambda lead: F.transform(lead, lambda v, k: F.when(k == 3, F.lit(float("nan")).cast("float")).otherwise(v)))).otherwise(F.col("signal")),
    })
    return records.shape_gate(rows, samples=64, leads=names).select("record", "failure_code", "ok")


@query(
    cohort_queries.CTES
    + """br AS (SELECT ecg_id, CASE WHEN ecg_id % 499 = 0 THEN 11.0 WHEN ecg_id % 503 = 0 THEN 2.5 WHEN ecg_id % 509 = 0 THEN NULL ELSE strat_fold END AS f, 1 AS k FROM md UNION ALL SELECT ecg_id, strat_fold, 2 FROM md WHERE ecg_id % 997 = 0)
SELECT ecg_id, 'ecg_id is not a key' AS rule FROM br GROUP BY ecg_id HAVING count(*) > 1
UNION ALL SELECT ecg_id, 'strat_fold is not 1 to 10' FROM br WHERE f IS NULL OR f <> floor(f) OR f NOT BETWEEN 1 AND 10"""
)
def metadata_faults(spark, sf_dir):
    """Rows that break the rules of the metadata, broken on purpose; the table as it was has none."""
    rows, key = cohort_queries.metadata(spark, sf_dir), F.col("ecg_id")
    C.check_metadata(rows)
    fold = F.when(key % 499 == 0, 11.0).when(key % 503 == 0, 2.5).when(key % 509 == 0, F.lit(None)).otherwise(F.col("strat_fold"))
    return C.metadata_faults(rows.withColumn("strat_fold", fold).unionByName(rows.filter(key % 997 == 0)))


_LIST = lambda c: f"array_to_string({c}, ';')"
_NOTE = lambda k: f"CASE WHEN ecg_id % {k} = 0 THEN 'v' WHEN ecg_id % {k} = 1 THEN '  ' END"
_AGE = "CASE WHEN ecg_id % 101 = 0 THEN '300' WHEN ecg_id % 103 = 0 THEN 'n/a' ELSE (ecg_id % 95)::varchar END"
#: What each audit column holds, in the order of the audit.
AUDIT = {
    "ecg_id": "ecg_id", "patient_id": "patient_id", "diagnostic_codes": _LIST("diagnostic_codes"), "label": "label", "strat_fold": "strat_fold", "split": "split", "filename_hr": "'r/' || ecg_id", "device": "device", "site": "site",
    "age_raw": _AGE, "age_years": "CASE WHEN ecg_id % 101 <> 0 AND ecg_id % 103 <> 0 THEN age END", "age_90_plus": "coalesce(age >= 90, false)",
    "baseline_drift": _NOTE(11), "static_noise": _NOTE(13), "burst_noise": "NULL", "electrodes_problems": _NOTE(17), "extra_beats": "' '", "pacemaker": _NOTE(19),
    "has_quality_note": "len(quality_note_fields) > 0", "quality_note_fields": _LIST("quality_note_fields"), "quality_note_count": "len(quality_note_fields)", "label_status": "CASE WHEN code_status <> '' THEN code_status WHEN len(diagnostic_codes) = 0 THEN 'no_diagnostic_codes' ELSE '' END",
    "header_path": "'r/' || ecg_id || '.hea'", "signal_path": "'r/' || ecg_id || '.dat'", "header_exists": "ecg_id % 3 <> 0", "signal_exists": "ecg_id % 5 <> 0", "file_status": "CASE WHEN ecg_id % 15 NOT IN (0, 3, 5, 6, 9, 10, 12) THEN 'present' WHEN ecg_id % 15 = 0 THEN 'missing_both' WHEN ecg_id % 3 = 0 THEN 'missing_hea' ELSE 'missing_dat' END",
    "patient_label_conflict": "patient_label_conflict", "sampling_eligible": "sampling_eligible",
}


@query(cohort_queries.CTES + "q AS (SELECT 1) SELECT ecg_id, concat_ws('|', " + ", ".join(f"coalesce(({c})::varchar, '-')" for c in AUDIT.values()) + ") AS head FROM ix")
def audit_columns(spark, sf_dir):
    """All columns of the audit, those of the files too, by their place."""
    rows = cohort_queries.index(spark, sf_dir)
    rows = C.audit_columns(C.with_files(rows, cohort_queries.sidecars(rows)))
    first = rows.columns[: len(AUDIT)]
    texts = [joined(c) if rows.schema[c].dataType.typeName() == "array" else F.col(c).cast("string") for c in first]
    return rows.select("ecg_id", F.concat_ws("|", *[F.coalesce(t, F.lit("-")) for t in texts]).alias("head"))


@query(cohort_queries.CTES + "q AS (SELECT 1) SELECT ecg_id, strat_fold FROM ix WHERE strat_fold BETWEEN 1 AND 8")
def readable_folds(spark, sf_dir):
    rows = C.only_folds(cohort_queries.index(spark, sf_dir)).select("ecg_id", "strat_fold")
    C.check_folds(rows)
    return rows


@query(cohort_queries.CTES + "q AS (SELECT 1) SELECT ecg_id, strat_fold FROM ix WHERE strat_fold > 8")
def folds_outside(spark, sf_dir):
    """What a run that reads all folds reads beyond those allowed."""
    return checks.outside(cohort_queries.index(spark, sf_dir), "strat_fold", range(1, 9)).select("ecg_id", "strat_fold")


@query(cohort_queries.CTES + """q AS (SELECT 1) SELECT ecg_id, '[' || coalesce(list_aggregate(list_transform(quality_note_fields, lambda x: '"' || x || '"'), 'string_agg', ','), '') || ']' AS flags FROM ix""")
def flags_as_json(spark, sf_dir):
    return cohort_queries.index(spark, sf_dir).select("ecg_id", as_json("quality_note_fields").alias("flags"))


@query(
    score_queries.CTES
    + """bad AS (SELECT f AS fold, st AS stage FROM (SELECT unnest(range(1, 9)) AS f) CROSS JOIN (SELECT unnest(['stage1', 'stage2']) AS st) WHERE (st = 'stage1' AND f = 3) OR (st = 'stage2' AND f IN (5, 6)))
SELECT pr.stage, seed, model, doc_id, CASE WHEN bad.fold IS NULL THEN round(score, 6) END AS score, CASE WHEN bad.fold IS NULL THEN 'ok' ELSE 'insufficient_train_prototypes' END AS score_status FROM pr LEFT JOIN bad ON pr.fold = bad.fold AND pr.stage = bad.stage"""
)
def unusable_folds(spark, sf_dir):
    """Scores of folds without usable templates: fold 3 of stage 1, folds 5 and 6 of stage 2; a fold that is bad in one stage is not so in the other."""
    scored = score_queries.predictions(spark, sf_dir)
    short = ((F.col("stage") == "stage1") & (F.col("fold") == 3)) | ((F.col("stage") == "stage2") & F.col("fold").isin(5, 6))
    status = scored.select("stage", "fold").distinct().withColumn("status", F.when(short, "insufficient").otherwise("ok"))
    return logistic.with_unusable_folds(scored, status, "fold", ["stage"]).select("stage", "seed", "model", "doc_id", r("score", digits=6), "score_status")


@query(
    score_queries.CTES
    + """bad AS (SELECT f AS fold, st AS stage FROM (SELECT unnest(range(1, 9)) AS f) CROSS JOIN (SELECT unnest(['stage1', 'stage2']) AS st) WHERE (st = 'stage1' AND f = 3) OR (st = 'stage2' AND f IN (5, 6)))
SELECT pr.stage, seed, model, doc_id, pr.fold::int AS fold, CASE WHEN bad.fold IS NULL THEN round(score, 6) END AS score, CASE WHEN bad.fold IS NULL THEN 'ok' ELSE 'insufficient_train_prototypes' END AS score_status FROM pr LEFT JOIN bad ON pr.fold = bad.fold AND pr.stage = bad.stage"""
)
def completed_scores(spark, sf_dir):
    """Scores of a run that left out whole folds without usable templates, and one of them only for some records: all expected rows are there."""
    scored = score_queries.predictions(spark, sf_dir)
    stage, fold = F.col("stage"), F.col("fold")
    short = ((stage == "stage1") & (fold == 3)) | ((stage == "stage2") & fold.isin(5, 6))
    status = scored.select("stage", "fold").distinct().withColumn("status", F.when(short, "insufficient").otherwise("ok"))
    records = scored.filter("seed = 0 AND model = 'A'").select("stage", "fold", "doc_id", "label")
    ran = scored.filter(~(short & ((fold != 6) | (F.col("doc_id") % 2 == 0))))
    found = logistic.completed(ran, records, status, ["stage"], "fold", "doc_id", score_queries.SEEDS, ["A", "B", "C"])
    return found.select("stage", "seed", "model", "doc_id", "fold", r("score", digits=6), "score_status")


@query("SELECT c_custkey, record, n FROM customer LEFT JOIN (SELECT vec_id // 6 AS record, count(*) AS n FROM embeddings GROUP BY 1) ON record = c_custkey")
def manifest_records(spark, sf_dir):
    """Every record of the manifest with its signal, also those without one."""
    signals = wave_queries.leads(spark, sf_dir).groupBy("record").agg(F.count(F.lit(1)).alias("n"))
    manifest = table(spark, sf_dir, "customer").select("c_custkey")
    return manifest.join(signals, F.col("c_custkey") == F.col("record"), "left")


#: What is planted in the files of every 20th record and so on; all others are good.
PLANTED = {k + 1: code for k, code in enumerate(records.CODES)}
_PLANT = " ".join(f"WHEN {k} THEN '{c}'" for k, c in PLANTED.items())


def record_files(rows):
    """path and content of the two files of each record: three vectors as leads, in thousandths, the leads in turn; records with a plant are broken as it says."""
    at = F.col("record") % 20
    plant = F.lit("")
    for k, code in PLANTED.items():
        plant = F.when(at == k, code).otherwise(plant)
    digits = F.transform(F.arrays_zip("a", "b", "c"), lambda z: F.array(z["a"], z["b"], z["c"]))
    byte = lambda v: F.to_binary(F.concat(F.substring(v, 3, 2), F.substring(v, 1, 2)), F.lit("hex"))
    word = lambda v: byte(F.lpad(F.hex((v + 65536) % 65536), 4, "0"))
    value = lambda v: F.round(v.cast("double") * 1000).cast("long") + 7
    rows = rows.withColumn("plant", plant).withColumns({c: F.transform(c, value) for c in "abc"})
    first = F.when(F.col("plant") == "invalid_digital_sentinel", -32768).otherwise(F.get(F.col("a"), 0))
    rows = rows.withColumn("a", F.transform("a", lambda v, k: F.when(k == 0, first).otherwise(v)))
    data = F.aggregate(F.flatten(digits), F.lit(b""), lambda s, v: F.concat(s, word(v)))
    data = F.when(F.col("plant") == "missing_data", F.lit(None)).when(F.col("plant") == "data_size_mismatch", F.concat(data, F.lit(b"\0"))).when(F.col("plant") == "noncanonical_leads", F.concat(data, data, data, data)).otherwise(data)
    said = lambda code, other, usual: F.when(F.col("plant") == code, F.lit(other)).otherwise(F.lit(usual))
    name = F.concat(F.lit("r"), F.col("record").cast("string"))
    leads = said("noncanonical_leads", "12", "3")
    count = F.when(F.col("plant") == "data_size_limit", F.lit("400000000")).otherwise(F.size("a").cast("string"))

    def line(k: int, lead: str):
        folder = said("unsafe_path", "../", "")
        file = F.concat(folder, name, said("unsupported_multifile", str(k), "") if k else F.lit(""), F.lit(".dat"))
        form = F.concat(said("unsupported_format", "212", "16"), said("unsupported_format_modifier", "x2", ""))
        gain = F.when(F.col("plant") == "nonfinite_signal", F.lit("1e-308(7)/")).when(F.col("plant") == "malformed_header", F.lit("none(7)/")).otherwise(F.lit("1000(7)/"))
        return F.concat(file, F.lit(" "), form, F.lit(" "), gain, said("unsupported_unit", "foo", "mV"), F.lit(f" 16 0 0 0 0 {lead}\n"))

    lines = F.concat(*[line(k, lead) for k, lead in enumerate(("V1", "V5", "V6"))])
    lines = F.concat(lines, F.when(F.col("plant") == "noncanonical_leads", F.concat(lines, lines, lines)).otherwise(F.lit("")), said("header_read_error", "\u00e9\n", ""))
    header = F.when(F.col("plant") != "missing_header", F.concat(name, F.lit(" "), leads, F.lit(" 500 "), count, F.lit("\n"), lines).cast("binary"))
    folder = F.concat((F.col("record") % 8).cast("string"), F.lit("/"), name)
    both = F.array(F.struct(F.concat(folder, F.lit(".hea")).alias("path"), header.alias("content")), F.struct(F.concat(folder, F.lit(".dat")).alias("path"), data.alias("content")))
    return rows.select(F.explode(both).alias("f")).select("f.*").filter("content IS NOT NULL")


@query(
    f"""WITH p AS (SELECT vec_id // 3 AS record, vec_id % 3 AS lead, list_sum(list_transform(embedding::double[], lambda x: round(x * 1000) / 1000)) AS s FROM embeddings),
w AS (SELECT record, max(s) FILTER (lead = 0) AS a, max(s) FILTER (lead = 1) AS b, max(s) FILTER (lead = 2) AS c FROM p GROUP BY record HAVING count(*) = 3),
f AS (SELECT *, CASE record % 20 {_PLANT} END AS failure_code FROM w)
SELECT record, failure_code, failure_code IS NULL AS ok, CASE WHEN failure_code IS NULL THEN 3 END AS leads, CASE WHEN failure_code IS NULL THEN round(a, 3) END AS v1, CASE WHEN failure_code IS NULL THEN round(b, 3) END AS v5, CASE WHEN failure_code IS NULL THEN round(c, 3) END AS v6 FROM f"""
)
def ingested_records(spark, sf_dir):
    """Records written as header and data files by the tasks, every code planted, and read again: code, or sums of the samples."""
    rows = table(spark, sf_dir, "embeddings").withColumns({"record": F.floor(F.col("vec_id") / 3), "lead": F.col("vec_id") % 3}).groupBy("record").pivot("lead", [0, 1, 2]).agg(F.first("embedding")).withColumnsRenamed({"0": "a", "1": "b", "2": "c"})
    folder = _path(spark, "records")
    records.write_files(record_files(rows.dropna(subset=["a", "b", "c"])), folder).write.format("noop").mode("overwrite").save()
    found = records.read_records(spark, folder)
    total = lambda k: r(F.aggregate(F.get("signal", k), F.lit(0.0), lambda s, v: s + v), f"v{(1, 5, 6)[k]}", 3)
    return found.select(F.regexp_extract("record", r"r(\d+)$", 1).cast("long").alias("record"), "failure_code", "ok", F.when(F.col("ok"), F.size("lead_names")).alias("leads"), *[total(k) for k in range(3)])


STORE = """st AS (SELECT 'stage1' AS stage, user_id, beat_index, value FROM ed UNION ALL SELECT 'stage2', user_id, row_number() OVER (PARTITION BY user_id ORDER BY beat_index) - 1, value FROM ed WHERE event_type <> 'view'),
n AS (SELECT stage, user_id, count(*) AS n, sum(value * (beat_index + 1)) AS s FROM st GROUP BY stage, user_id),
q AS (SELECT stage, user_id, coalesce(sum(n) OVER (PARTITION BY stage ORDER BY user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS first, sum(n) OVER (PARTITION BY stage ORDER BY user_id)::bigint AS "end", round(s, 6) AS in_order FROM n)"""


@query(event_queries.CTES + STORE + " SELECT * FROM q")
def ragged_store(spark, sf_dir):
    """Values of valid events in a ragged store per stage, read again by their offsets; the sum depends on their order."""
    valid = event_queries.valid_edges(spark, sf_dir)
    fewer = valid.filter("event_type <> 'view'").withColumn("beat_index", F.row_number().over(events.by(["user_id"], "beat_index")) - 1)
    rows = checks.union_all(*[x.select(F.lit(stage).alias("stage"), "user_id", "beat_index", "value") for stage, x in (("stage1", valid), ("stage2", fewer))])
    path = _path(spark, "ragged")
    tables.write_ragged(rows, path, ["stage"], "user_id", "beat_index", F.floor(F.col("user_id") / 1024))
    stored, offsets = tables.read_ragged(spark, path)
    tasks = storage.tasks_for(spark, stored.count())
    places = offsets.withColumn("row", F.explode(F.sequence("first", F.col("end") - 1))).repartition(tasks, "stage", "row")
    back = places.join(stored.select("stage", "row", "value").repartition(tasks, "stage", "row"), ["stage", "row"])
    return back.groupBy("stage", "user_id").agg(F.first("first").alias("first"), F.first("end").alias("end"), r(F.sum(F.col("value") * (F.col("row") - F.col("first") + 1)), "in_order", 6))


@query(score_queries.CTES + """q AS (SELECT 1) SELECT 'rows' AS rule, count(*)::bigint AS n FROM pr
UNION ALL SELECT 'fold outside 1 to 8', count(*) FILTER (coalesce(fold NOT BETWEEN 1 AND 8, true)) FROM pr UNION ALL SELECT 'label not 0 or 1', count(*) FILTER (coalesce(label NOT IN (0, 1), true)) FROM pr
UNION ALL SELECT 'score outside 0 to 1', count(*) FILTER (score < 0 OR score > 1) FROM pr UNION ALL SELECT 'another model', count(*) FILTER (model NOT IN ('A', 'B', 'C')) FROM pr
UNION ALL SELECT 'models with other numbers of rows', (SELECT max(n) - min(n) FROM (SELECT count(*) AS n FROM pr GROUP BY model)) UNION ALL SELECT 'scores without identifier', count(*) FILTER (doc_id IS NULL) FROM pr""")
def checked_predictions(spark, sf_dir):
    """Predictions written with their rules checked on the way; what the checks counted is read back."""
    path = _path(spark, "predictions")
    model = lambda m: F.sum((F.col("model") == m).cast("long"))
    counts = [model(m) for m in "ABC"]
    checks.write_checked(score_queries.predictions(spark, sf_dir), path, {
        "fold outside 1 to 8": ~F.col("fold").between(1, 8), "label not 0 or 1": ~F.col("label").isin(0, 1), "score outside 0 to 1": F.coalesce((F.col("score") < 0) | (F.col("score") > 1), F.lit(False)), "another model": ~F.col("model").isin("A", "B", "C"), "scores without identifier": F.col("doc_id").isNull(),
    }, {"models with other numbers of rows": F.greatest(*counts) - F.least(*counts)})
    checks.read_checked(spark, path)
    return spark.read.parquet(f"{path}/checks")


PLATEAU = """WITH cl AS (SELECT vec_id, i, least(greatest(round(v, 1), -0.1), 0.1) AS v FROM (SELECT vec_id, unnest(embedding::double[]) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)),
mm AS (SELECT *, min(v) OVER (PARTITION BY vec_id) AS lo, max(v) OVER (PARTITION BY vec_id) AS hi FROM cl),
h AS (SELECT vec_id, count(*) AS n FROM (SELECT vec_id, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS g FROM mm WHERE v = lo) GROUP BY vec_id, g
  UNION ALL SELECT vec_id, count(*) FROM (SELECT vec_id, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS g FROM mm WHERE v = hi AND hi > lo) GROUP BY vec_id, g)
"""


@query(PLATEAU + "SELECT vec_id, round(coalesce(held, 0) / 64.0::double, 6) AS plateau_share FROM (SELECT DISTINCT vec_id FROM cl) LEFT JOIN (SELECT vec_id, sum(n) AS held FROM h WHERE n >= 5 GROUP BY vec_id) USING (vec_id)")
def plateau_share(spark, sf_dir):
    """Share of a lead in plateaus at its bounds; vectors are clipped, so that they have some."""
    clipped = F.transform("embedding", lambda v: F.least(F.greatest(F.round(v.cast("double"), 1), F.lit(-0.1)), F.lit(0.1)))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", clipped.alias("wave"))
    return quality.lead_quality(rows, "wave").select("vec_id", r("plateau_share", digits=6))


@query("""WITH u AS (SELECT vec_id // 6 AS record, vec_id % 6 AS lead, unnest(embedding::double[]) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT a.record, corr(a.v, b.v) AS corr FROM u a JOIN u b ON a.record = b.record AND a.i = b.i AND a.lead < b.lead GROUP BY a.record, a.lead, b.lead)
SELECT record, n AS leads, n = 6 AS complete, coalesce(p, 0) AS repeated_pairs FROM (SELECT vec_id // 6 AS record, count(*) AS n FROM embeddings GROUP BY 1) LEFT JOIN (SELECT record, count(*) AS p FROM c WHERE abs(corr) > 0.2 GROUP BY record) USING (record)""")
def repeated_leads(spark, sf_dir):
    """Flags of near-identical leads, and whether a record has them all."""
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 6).alias("record"), (F.col("vec_id") % 6).alias("lead"), "embedding")
    pairs = quality.correlated_pairs(rows, ["record"], "lead", "embedding", 0.2)
    found = quality.record_quality(quality.lead_quality(rows.withColumnRenamed("embedding", "wave"), "wave"), ["record"], pairs, 6)
    return found.select("record", "leads", "complete", "repeated_pairs")


@query(score_queries.CTES + "q AS (SELECT 1) SELECT doc_id, true AS unchanged FROM lb WHERE fold = 1")
def label_flip(spark, sf_dir):
    """Whether the scores of a fold stay as they are when its labels are flipped: all must."""
    rows = score_queries.features(spark, sf_dir)
    flipped = rows.withColumn("label", F.when(F.col("fold") == 1, 1 - F.col("label")).otherwise(F.col("label")))
    scores = lambda x, name: logistic.fold_scores(x, [], "fold", "label", score_queries.FEATURES, [1]).filter("fold = 1").select("doc_id", r("score", name, 6))
    return scores(rows, "a").join(scores(flipped, "b"), "doc_id").select("doc_id", F.col("a").eqNullSafe(F.col("b")).alias("unchanged"))
