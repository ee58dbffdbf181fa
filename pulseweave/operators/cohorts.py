"""From a metadata table to a labelled cohort and a hash-deterministic stratified sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import dense_index, first_per_group
from ..functions.scalar import let, present, record_hash
from ..functions.text import normal_text, with_stratum

#: Columns and note fields of the metadata, and the age that stands for "90 and over".
REQUIRED = ("ecg_id", "patient_id", "age", "scp_codes", "strat_fold", "filename_hr")
NOTES = ("baseline_drift", "static_noise", "burst_noise", "electrodes_problems", "extra_beats", "pacemaker")
AGE_90_PLUS = 300.0


class ContractError(ValueError):
    """A table breaks a rule that no row may break."""


def require(bad: DataFrame, what: str) -> None:
    """Raise if ``bad`` has any row."""
    if not bad.isEmpty():
        raise ContractError(f"{what}: {bad.limit(3).collect()}")


def metadata_faults(metadata: DataFrame) -> DataFrame:
    """(ecg_id, rule) of identifiers that are null or repeated, and of folds that are no whole number from 1 to 10."""
    keys = metadata.groupBy("ecg_id").count().filter("count > 1 OR ecg_id IS NULL").select("ecg_id", F.lit("ecg_id is not a key").alias("rule"))
    fold = F.col("strat_fold").cast("double")
    return keys.unionByName(metadata.filter(fold.isNull() | (fold != F.floor(fold)) | ~fold.between(1, 10)).select("ecg_id", F.lit("strat_fold is not 1 to 10").alias("rule")))


def check_metadata(metadata: DataFrame) -> None:
    """Required columns are there, and no row breaks a rule."""
    if absent := [c for c in REQUIRED if c not in metadata.columns]:
        raise ContractError(f"columns are missing: {absent}")
    require(metadata_faults(metadata), "metadata")


def split_of(fold: str | Column = "strat_fold") -> Column:
    fold = F.col(fold) if isinstance(fold, str) else fold
    return F.when(fold.between(1, 8), "train").when(fold == 9, "validation").when(fold == 10, "test")


def codes_of(text: str = "scp_codes") -> Column:
    """Struct of codes, the trimmed, distinct, non-empty keys of a map's text, and code_status, why there are none: ``empty_scp_codes`` or ``malformed_scp_codes``. The text is parsed once."""
    blank = present(text).isNull()

    def found(parsed: Column) -> Column:
        keys = F.array_sort(F.array_distinct(F.filter(F.transform(F.map_keys(parsed), lambda k: F.trim(k)), lambda k: k != "")))
        return let(keys, lambda own: F.struct(F.when(F.size(own) > 0, own).otherwise(F.array().cast("array<string>")).alias("codes"), F.when(F.size(own) > 0, "").otherwise("empty_scp_codes").alias("code_status")))

    none = lambda why: F.struct(F.array().cast("array<string>").alias("codes"), F.lit(why).alias("code_status"))
    parsed = let(F.from_json(F.col(text), "map<string,double>"), lambda p: F.when(p.isNull(), none("malformed_scp_codes")).otherwise(found(p)))
    return F.when(blank, none("empty_scp_codes")).otherwise(parsed)


def with_codes(metadata: DataFrame, dictionary: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Codes, the diagnostic ones among them, and the strict label: the one supported code that is the only diagnostic one.

    ``dictionary`` (code, diagnostic) is a code book of bounded size; it becomes one array.
    """
    book = dictionary.filter(F.col("diagnostic") == 1).agg(F.collect_set("code").alias("_book"))
    out = metadata.withColumn("_codes", codes_of()).select(*metadata.columns, "_codes.*").join(F.broadcast(book))
    out = out.withColumn("diagnostic_codes", F.array_sort(F.array_intersect("codes", "_book"))).drop("_book")
    only = F.when(F.size("diagnostic_codes") == 1, F.element_at("diagnostic_codes", 1))
    return out.withColumns({"label": F.when(only.isin(*labels), only), "label_status": F.when(F.col("code_status") != "", F.col("code_status")).when(F.size("diagnostic_codes") == 0, "no_diagnostic_codes").otherwise("")})


def with_age(metadata: DataFrame) -> DataFrame:
    age = F.col("age").try_cast("double")
    return metadata.withColumns({"age_raw": F.col("age"), "age_years": F.when(age != AGE_90_PLUS, age), "age_90_plus": F.coalesce(age >= 90, F.lit(False))})


def with_notes(metadata: DataFrame, fields: Sequence[str] = NOTES) -> DataFrame:
    """Which note fields are not blank."""
    named = F.array(*[F.when(present(c).isNotNull(), F.lit(c)) for c in fields])
    return metadata.withColumn("quality_note_fields", F.array_compact(named)).withColumns({"quality_note_count": F.size("quality_note_fields"), "has_quality_note": F.size("quality_note_fields") > 0})


def with_files(metadata: DataFrame, files: DataFrame, stem: str = "filename_hr") -> DataFrame:
    """Sidecar paths and file_status; ``files`` has a path column. A stem that leaves the root is an error."""
    require(metadata.filter(F.col(stem).rlike(r"(^/|(^|/)\.\.(/|$))")).select("ecg_id", stem), "a path leaves the root")
    base = F.regexp_replace(present(stem), r"\.(hea|dat)$", "")
    have = files.select(F.regexp_replace("path", r"\.(hea|dat)$", "").alias("_stem"), F.regexp_extract("path", r"\.(hea|dat)$", 1).alias("_kind")).groupBy("_stem").agg(F.bool_or(F.col("_kind") == "hea").alias("_hea"), F.bool_or(F.col("_kind") == "dat").alias("_dat"))
    out = metadata.withColumn("_stem", base).join(have, "_stem", "left")
    hea, dat = F.coalesce("_hea", F.lit(False)), F.coalesce("_dat", F.lit(False))
    status = F.when(F.col("_stem").isNull(), "missing_filename").when(hea & dat, "present").when(hea, "missing_dat").when(dat, "missing_hea").otherwise("missing_both")
    return out.withColumns({"header_path": F.concat("_stem", F.lit(".hea")), "signal_path": F.concat("_stem", F.lit(".dat")), "header_exists": hea, "signal_exists": dat, "file_status": status}).drop("_stem", "_hea", "_dat")


def with_conflicts(rows: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Whether a patient has more than one supported label (null without a patient), and whether the row may be sampled."""
    labelled = rows.filter(F.col("patient_id").isNotNull() & F.col("label").isin(*labels))
    conflicts = labelled.groupBy("patient_id").agg(F.min("label").alias("_a"), F.max("label").alias("_b")).filter("_a <> _b").select(F.col("patient_id").cast("string").alias("_who"), F.lit(True).alias("_conflict"))
    # rows without a patient have keys of their own: they would all meet in one task
    who = F.coalesce(F.col("patient_id").cast("string"), F.concat(F.lit("none "), F.col("ecg_id").cast("string")))
    out = rows.withColumn("_who", who).join(conflicts, "_who", "left")
    out = out.withColumn("patient_label_conflict", F.when(F.col("patient_id").isNotNull(), F.coalesce("_conflict", F.lit(False)))).select(*rows.columns, "patient_label_conflict")
    return out.withColumn("sampling_eligible", F.coalesce(F.col("label").isNotNull() & (F.col("split") == "train") & F.col("patient_id").isNotNull() & ~F.col("patient_label_conflict"), F.lit(False)))


def check_splits(rows: DataFrame) -> None:
    """No patient lies in two splits."""
    require(rows.filter(F.col("patient_id").isNotNull()).groupBy("patient_id").agg(F.countDistinct("split").alias("splits")).filter("splits > 1"), "a patient lies in several splits")


#: Order of the columns of an audit; quality_note_present is named has_quality_note here, strict_label label, hea_path and dat_path by what they hold.
PREFERRED = (
    "ecg_id", "patient_id", "diagnostic_codes", "label", "strat_fold", "split", "filename_hr", "device", "site", "sex", "age_raw", "age_years", "age_90_plus", *NOTES,
    "has_quality_note", "quality_note_fields", "quality_note_count", "label_status", "header_path", "signal_path", "header_exists", "signal_exists", "file_status", "patient_label_conflict", "sampling_eligible",
)


def audit_columns(rows: DataFrame) -> DataFrame:
    """Preferred columns first, every other one kept."""
    first = [c for c in PREFERRED if c in rows.columns]
    return rows.select(*first, *[c for c in rows.columns if c not in first])


def cohort_index(metadata: DataFrame, dictionary: DataFrame, labels: Sequence[str]) -> DataFrame:
    rows = with_notes(with_age(with_codes(metadata, dictionary, labels))).withColumn("split", split_of())
    return audit_columns(with_conflicts(rows, labels))


def first_failure(*codes: str) -> Column:
    """The first code of the list that is not blank: read, peak, beat, ..."""
    return F.coalesce(*[present(c) for c in codes])


def candidates(rows: DataFrame, labels: Sequence[str], folds: Sequence[int] = range(1, 9)) -> DataFrame:
    """Rows that may be drawn: a supported label, a fold in range, a patient, no conflict (null counts as one), eligible (null does not)."""
    return rows.filter(
        F.col("label").isin(*labels) & F.col("strat_fold").isin(*folds) & present("patient_id").isNotNull() & ~F.coalesce("patient_label_conflict", F.lit(True)) & F.coalesce("sampling_eligible", F.lit(False))
    )


def one_per_patient(rows: DataFrame, seed: int, keys: Sequence[str] = ("label", "patient_id"), identity: str = "ecg_id") -> DataFrame:
    """The record of each patient with the smallest hash, then text. Patients that are named by text are one in any form of it."""
    rows = normal_text(rows, ["patient_id"]).withColumn("record_hash", record_hash("record", seed, F.col("patient_id"), F.col(identity)))
    first = F.min_by(F.struct(*rows.columns), F.struct(F.col("record_hash"), F.col(identity).cast("string")))
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(first.alias("_row")).select("_row.*")


def quotas(rows: DataFrame, n: int, label: str = "label", by: str = "stratum") -> DataFrame:
    """Largest-remainder quotas of ``n`` rows per label over strata: whole parts first, the rest by remainder, then by name; in whole numbers."""
    sizes = rows.groupBy(label, by).agg(F.count(F.lit(1)).alias("size"))
    s = sizes.withColumn("total", F.sum("size").over(Window.partitionBy(label)))
    s = s.withColumns({"floor": F.floor(F.lit(n) * F.col("size") / F.col("total")).cast("long"), "rest": (F.lit(n) * F.col("size")) % F.col("total")})
    s = s.withColumns({"left": F.lit(n) - F.sum("floor").over(Window.partitionBy(label)), "place": F.row_number().over(Window.partitionBy(label).orderBy(F.desc("rest"), by))})
    return s.withColumn("quota", F.least(F.col("size"), F.col("floor") + (F.col("place") <= F.col("left")).cast("long"))).select(label, by, "size", "total", "quota")


def stratified_sample(rows: DataFrame, strata: Sequence[str], n: int, seed: int) -> DataFrame:
    """``n`` rows per label, by stratum quota and then by hash. A row's hash is compared inside its stratum only."""
    rows = with_stratum(normal_text(rows, ["patient_id"]), strata).withColumn("sample_hash", record_hash("sample", seed, F.col("label"), F.col("patient_id")))
    taken = quotas(rows, n).select("label", "stratum", "quota")
    first = first_per_group(rows, ["label", "stratum"], ["sample_hash", "ecg_id"], n)  # no quota exceeds n
    first = first.withColumn("stratum_rank", F.row_number().over(Window.partitionBy("label", "stratum").orderBy("sample_hash", "ecg_id")))
    return first.join(taken, ["label", "stratum"]).filter(F.col("stratum_rank") <= F.col("quota"))


def roles(sample: DataFrame, seed: int, per_class: int = 150, pool: int = 100) -> DataFrame:
    """The first of each label by role hash make the prototype pool: 100 of 150, else two thirds, rounded up. A sample is small: ``per_class`` rows a label."""
    sample = sample.withColumn("role_hash", record_hash("role", seed, F.col("label"), F.col("patient_id")))
    n = F.count(F.lit(1)).over(Window.partitionBy("label"))
    k = F.when(n == per_class, F.lit(pool)).otherwise(F.ceil(2 * n / 3))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("role_hash", "ecg_id"))
    return sample.withColumns({"role_rank": rank, "role": F.when(rank <= k, "prototype_pool").otherwise("exploratory_probe")}).orderBy("label", "role_rank")


def casebook(rows: DataFrame, group: Sequence[str], order: Sequence[str | Column], n: int = 5) -> DataFrame:
    """The first ``n`` of each group, numbered; groups of any size are ranked in slices first."""
    first = first_per_group(rows, group, order, n)
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def with_range_rank(rows: DataFrame, value: str, name: str = "range_rank", ranges: int = 256) -> DataFrame:
    """Dense rank of a number over a selected table, nulls last: distinct values are ranked in ranges, in tasks of their own, and rows are joined to them."""
    values = rows.select(F.col(value).alias("_value")).distinct()
    span = values.agg(F.min("_value").cast("double").alias("_low"), F.max("_value").cast("double").alias("_high"))
    share = (F.col("_value") - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0))
    bucket = F.when(F.col("_value").isNull(), ranges).otherwise(F.coalesce(F.floor(share * (ranges - 1)).cast("int"), F.lit(0)))
    ranks = dense_index(values.join(F.broadcast(span)), [], bucket, ["_value"], name).select("_value", (F.col(name) + 1).cast("int").alias(name))
    return rows.join(ranks, F.col(value).eqNullSafe(F.col("_value"))).drop("_value")


def review_list(rows: DataFrame, label: str, ok: str, flags: str, size: str, identity: str = "ecg_id", n: int = 10, named: Sequence = ()) -> DataFrame:
    """The first ``n`` per class in ascending order of priority (2 for success, 1 for flags), valid events and identifier, all failures, and the named ones; each once."""
    ranked = rows.withColumn("priority", 2 * F.col(ok).cast("int") + F.col(flags).cast("int"))
    first = first_per_group(ranked, [label], ["priority", size, identity], n)
    more = ranked.filter(~F.col(ok) | F.col(identity).isin(*named)) if named else ranked.filter(~F.col(ok))
    return first.unionByName(more).distinct()


def cohort_summary(rows: DataFrame) -> DataFrame:
    """Rows, strict labels and patients per fold."""
    return rows.groupBy("strat_fold").agg(F.count(F.lit(1)).alias("rows"), F.count("label").alias("labelled"), F.sum(F.col("sampling_eligible").cast("int")).alias("eligible"), F.countDistinct("patient_id").alias("patients"))


def assert_counts(rows: DataFrame, label: str, expected: dict) -> None:
    """The counts per label are the expected ones."""
    want = rows.sparkSession.createDataFrame([(k, int(v)) for k, v in expected.items()], f"{label} {rows.schema[label].dataType.simpleString()}, want long")
    have = rows.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("have"))
    require(have.join(want, label, "full_outer").filter(~F.coalesce("have", F.lit(0)).eqNullSafe(F.coalesce("want", F.lit(0)))), "counts differ")


def success_gate(records: DataFrame, read_ok: Column, beat_ok: Column, least_read: int, least_beat: int, label: str, pool: Column, least_pool: int, labels: int = 2, probes: DataFrame | None = None, probe: str = "probe", cells: int = 6, least_probes: int = 80) -> DataFrame:
    """Successes against their least numbers, one row, and whether all are met.

    ``probes`` (probe, ok) has a row per cell of a probe; a probe succeeds if all its ``cells`` are ok.
    """
    pools = records.filter(pool).groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.when(F.count(F.lit(1)) == labels, F.min("n")).otherwise(F.lit(0)).alias("prototypes_min"))
    sums = records.agg(F.count(F.lit(1)).alias("records"), F.sum(read_ok.cast("int")).alias("read_ok"), F.sum(beat_ok.cast("int")).alias("beat_ok"))
    met = (F.col("read_ok") >= least_read) & (F.col("beat_ok") >= least_beat) & (F.col("prototypes_min") >= least_pool)
    out = sums.join(F.broadcast(pools))
    if probes is not None:
        whole = probes.groupBy(probe).agg(F.bool_and("ok").alias("_all"), F.count(F.lit(1)).alias("_n"))
        out = out.join(F.broadcast(whole.agg(F.count_if(F.col("_all") & (F.col("_n") == cells)).alias("probes_ok"))))
        met = met & (F.col("probes_ok") >= least_probes)
    return out.withColumn("gate_pass", met)


def only_folds(rows: DataFrame, folds: Sequence[int] = range(1, 9), fold: str = "strat_fold") -> DataFrame:
    """The rows of the folds that may be read; use ``check_folds`` on what was read."""
    return rows.filter(F.col(fold).isin(*folds))


def check_folds(rows: DataFrame, folds: Sequence[int] = range(1, 9), fold: str = "strat_fold") -> None:
    require(rows.filter(~F.coalesce(F.col(fold).isin(*folds), F.lit(False))), "a fold outside of those allowed was read")
