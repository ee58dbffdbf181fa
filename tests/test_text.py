from pulseweave.functions.text import key_text, normal_text, with_stratum
from pulseweave.operators import cohorts


def test_strata(spark):
    rows = [(" x ", True, None, 1.5, 7), ("true", False, "", float("nan"), 7), ("caf\u00e9", None, " \t\n", None, None), ("cafe\u0301\u3000", None, "\u2003", -0.5, 1), (None, True, "TRUE", 2.0, 0)]
    df = spark.createDataFrame(rows, "s string, b boolean, t string, x double, n int").repartition(3)
    found = with_stratum(df, ["s", "b", "t", "x", "n"])
    assert found.columns == [*df.columns, "stratum"] and {x[:3] for x in found.collect()} == {r[:3] for r in rows}
    assert {x.stratum for x in found.collect()} == {
        '["x","1","<MISSING>","1.5","7"]', '["true","0","<MISSING>","<MISSING>","7"]', '["caf\u00e9","<MISSING>","<MISSING>","<MISSING>","<MISSING>"]',
        '["caf\u00e9","<MISSING>","<MISSING>","-0.5","1"]', '["<MISSING>","1","TRUE","2.0","0"]',
    }


def test_ascii_rows_do_not_pass_through_python(spark):
    df = spark.createDataFrame([("a",), ("\u00e9",)], "s string")
    plan = normal_text(df, ["s"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" in plan and "octet_length" in plan
    assert normal_text(df.selectExpr("1 AS n"), ["n"])._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 0
    assert df.limit(0).select(key_text(df, "s")).collect() == [] == with_stratum(df.limit(0), ["s"]).collect()


def test_clashing_names(spark):
    df = spark.createDataFrame([("e\u0301", "k", "l")], "s string, _s string, _S_ string")
    assert with_stratum(df, ["s"]).first() == ("e\u0301", "k", "l", '["\u00e9"]')


def test_patients_in_two_forms_are_one(spark):
    rows = [("A", "Andre\u0301", 1), ("A", "Andr\u00e9 ", 2), ("A", "Bo", 3)]
    df = spark.createDataFrame(rows, "label string, patient_id string, ecg_id long")
    assert sorted(x.patient_id for x in cohorts.one_per_patient(df, 5001).collect()) == ["Andr\u00e9", "Bo"]
