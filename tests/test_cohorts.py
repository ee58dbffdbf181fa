from collections import Counter

import pytest
from pyspark.sql import functions as F

from pulseweave.operators import cohorts as C

COLUMNS = "ecg_id long, patient_id double, age string, scp_codes string, strat_fold double, filename_hr string, " + ", ".join(f"{n} string" for n in C.NOTES)


def metadata(spark, rows):
    return spark.createDataFrame([(*r, *[None] * len(C.NOTES)) if len(r) == 6 else r for r in rows], COLUMNS)


@pytest.fixture
def dictionary(spark):
    return spark.createDataFrame([("LVH", 1.0), ("NORM", 1.0), ("SR", None)], "code string, diagnostic double")


def test_index(spark, dictionary):
    rows = [
        (1, 10.0, "300", "{'LVH': 100.0, 'SR': 0.0}", 1.0, "a/1"),
        (2, 10.0, "50", "{'NORM': 100.0}", 1.0, "a/2"),
        (3, 11.0, "n/a", "{'NORM': 80.0}", 9.0, "a/3"),
        (4, None, "91", "{'LVH': 1.0}", 2.0, None),
        (5, 12.0, None, "{'LVH': 1.0, 'NORM': 1.0}", 3.0, "a/5"),
        (6, 13.0, "40", "", 10.0, "a/6"),
        (7, 14.0, "40", "{'SR': ", 4.0, "a/7"),
        (8, 15.0, "40", "{' NORM ': 5.0}", 4.0, "a/8"),
    ]
    table = metadata(spark, rows)
    C.check_metadata(table)
    found = {r.ecg_id: r for r in C.cohort_index(table, dictionary, ["LVH", "NORM"]).collect()}
    assert [found[i].label for i in range(1, 9)] == ["LVH", "NORM", "NORM", "LVH", None, None, None, "NORM"]
    assert [found[i].patient_label_conflict for i in (1, 2, 3, 4, 8)] == [True, True, False, None, False]
    assert [i for i in found if found[i].sampling_eligible] == [8]
    assert (found[1].age_years, found[1].age_90_plus, found[4].age_90_plus, found[3].age_years) == (None, True, True, None)
    assert (found[6].label_status, found[7].label_status, found[3].split, found[6].split) == ("empty_scp_codes", "malformed_scp_codes", "validation", "test")


def test_broken_tables_are_errors(spark):
    row = (1, 1.0, "1", "{}", 1.0, "x")
    for bad in ([row, row], [(None, *row[1:])], [(1, 1.0, "1", "{}", 11.0, "x")], [(1, 1.0, "1", "{}", 1.5, "x")]):
        with pytest.raises(C.ContractError):
            C.check_metadata(metadata(spark, bad))
    with pytest.raises(C.ContractError):
        C.check_metadata(metadata(spark, [row]).drop("age"))
    with pytest.raises(C.ContractError):
        C.check_splits(spark.createDataFrame([(1.0, "train"), (1.0, "test")], "patient_id double, split string"))
    with pytest.raises(C.ContractError):
        C.with_files(metadata(spark, [(1, 1.0, "1", "{}", 1.0, "../x")]), spark.createDataFrame([("x.hea",)], "path string"))


def plain_quotas(sizes, n):
    total = sum(sizes.values())
    parts = {k: n * v // total for k, v in sizes.items()}
    for k in sorted(sizes, key=lambda k: (-(n * sizes[k] % total), k))[: n - sum(parts.values())]:
        parts[k] += 1
    return {k: min(v, sizes[k]) for k, v in parts.items()}


def test_quotas_and_sample(spark):
    sizes = {"a": 31, "b": 7, "c": 7, "d": 1}
    rows = [(f"{k}{i}", float(i), "x", k) for k, n in sizes.items() for i in range(n)]
    table = spark.createDataFrame(rows, "ecg_id string, patient_id double, label string, site string")
    n = 20
    found = C.stratified_sample(table, ["site"], n, 5001)
    assert Counter(r.site for r in found.collect()) == Counter(plain_quotas(sizes, n))
    again = C.stratified_sample(table.repartition(3), ["site"], n, 5001)
    assert {r.ecg_id for r in again.collect()} == {r.ecg_id for r in found.collect()}
    roles = Counter(r.role for r in C.roles(found, 5001).collect())
    assert roles == {"prototype_pool": 14, "exploratory_probe": 6}


def test_one_per_patient_and_lists(spark):
    rows = spark.createDataFrame([(i, float(i // 3), "x", i % 4 != 0, i % 2 == 0, i) for i in range(12)], "ecg_id long, patient_id double, label string, ok boolean, flags boolean, beats long")
    assert C.one_per_patient(rows, 1).count() == 4
    listed = {r.ecg_id for r in C.review_list(rows, "label", "ok", "flags", "beats", n=2, named=(7,)).collect()}
    assert listed == {0, 4, 8, 7}
    assert [r.place for r in C.casebook(rows, ["label"], ["beats"], 3).orderBy("place").collect()] == [1, 2, 3]


def test_range_ranks(spark):
    values = [5, None, 3, 3, 1000, 7, None, -2]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v int").repartition(3)
    order = sorted({v for v in values if v is not None})
    for ranges in (256, 2):
        found = {r.i: r.range_rank for r in C.with_range_rank(rows, "v", ranges=ranges).collect()}
        assert found == {i: order.index(v) + 1 if v is not None else len(order) + 1 for i, v in enumerate(values)}
    one = C.with_range_rank(rows.filter("v = 3"), "v").collect()
    assert [r.range_rank for r in one] == [1, 1]


def test_probes_of_the_gate(spark):
    records = spark.createDataFrame([(i, "ab"[i % 2], True) for i in range(8)], "i int, label string, ok boolean")
    cells = spark.createDataFrame([(p, not (p == 2 and c == 4)) for p in range(4) for c in range(6 if p != 3 else 5)], "probe int, ok boolean")
    gate = lambda least: C.success_gate(records, F.col("ok"), F.col("ok"), 8, 8, "label", F.col("ok"), 4, probes=cells, least_probes=least).first()
    assert gate(2).probes_ok == 2 and gate(2).gate_pass and not gate(3).gate_pass


def test_audit_columns_come_first(spark, dictionary):
    table = metadata(spark, [(1, 10.0, "300", "{'LVH': 100.0}", 1.0, "a/1")]).withColumn("extra", F.lit(1))
    columns = C.cohort_index(table, dictionary, ["LVH", "NORM"]).columns
    assert [c for c in columns if c in C.PREFERRED] == [c for c in C.PREFERRED if c in columns]
    assert columns.index("extra") > columns.index("sampling_eligible") and set(table.columns) <= set(columns)
