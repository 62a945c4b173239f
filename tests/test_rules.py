import pytest
from conftest import one
from pyspark.sql import functions as F

from evispark.functions import patients as R
from evispark.functions import query_text as Q
from evispark.operators import triage, validation
from evispark.sources import patients as files

# (id, age, gender, smoking history, symptoms) and the expected score and level.
PATIENTS = [
    ("PT-101", 55, "Male", "Current Smoker", ["unexplained hemoptysis", "fatigue"], 50, "moderate"),
    ("PT-102", 25, "Female", "Never Smoked", ["persistent cough", "sore throat"], 0, "low"),
    ("PT-103", 45, "Male", "Ex-Smoker", ["persistent cough", "shortness of breath"], 40, "moderate"),
    ("PT-104", 35, "Female", "Never Smoked", ["dysphagia"], 100, "high"),
    ("PT-105", 65, "Male", "Ex-Smoker", ["iron-deficiency anaemia", "fatigue"], 50, "moderate"),
    ("PT-106", 18, "Female", "Never Smoked", ["fatigue"], 0, "low"),
    ("PT-107", 48, "Male", "Current Smoker", ["persistent hoarseness"], 100, "high"),
    ("PT-108", 32, "Female", "Never Smoked", ["unexplained breast lump"], 100, "high"),
    ("PT-109", 45, "Male", "Never Smoked", ["dyspepsia"], 20, "low"),
    ("PT-110", 60, "Male", "Never Smoked", ["visible haematuria"], 100, "high"),
]


@pytest.fixture(scope="module")
def patients(spark):
    df = spark.createDataFrame([p[:5] for p in PATIENTS], "patient_id string, age int, gender string, smoking_history string, symptoms array<string>")
    return files.for_triage(df.withColumn("symptom_duration_days", F.lit(3)))


def test_golden_scores(patients):
    got = {r.patient_id: (r.score, r.risk_level) for r in triage.assess(patients).collect()}
    assert got == {p[0]: (p[5], p[6]) for p in PATIENTS}


def test_flags_and_reasons(patients):
    rows = {r.patient_id: r for r in triage.assess(patients).collect()}
    assert [f.red_flag for f in rows["PT-103"].red_flags] == ["persistent cough in patient ≥40"]
    assert rows["PT-103"].reasons == ["Patient age 45 (≥40)", "Risk factor: Ex-Smoker"]
    assert rows["PT-108"].reasons == ["New breast lump - urgent referral"]
    assert rows["PT-101"].red_flags == []   # the other spelling is not a rule


def test_lump_hits_two_rules_and_empty_none(spark):
    df = spark.createDataFrame([(["LUMP", ""], 20)], "symptoms array<string>, age int")
    flags = one(df.select(R.red_flags(F.col("symptoms"), F.col("age")).alias("f")))["f"]
    assert [f["red_flag"] for f in flags] == ["breast lump", "testicular lump"]


def test_null_fields(spark):
    df = spark.createDataFrame([(None, None, None)], "symptoms array<string>, age int, risk_factors array<string>")
    row = one(triage.assess(df))
    assert (row["score"], row["risk_level"], row["red_flags"]) == (0, "low", [])


def test_pathways_and_levels(spark):
    df = spark.createDataFrame([("Lung", "urgent_2_week"), ("skin", "urgent_2_week"), ("lung", "routine")], "c string, u string")
    rows = df.select(R.pathway(F.col("c"), F.col("u")).alias("p")).select("p.*").collect()
    assert [(r.pathway, r.timeline) for r in rows] == [
        ("Suspected lung cancer pathway", "Appointment within 2 weeks"), ("Suspected skin cancer pathway", "2 weeks"),
        ("Suspected lung cancer pathway", "Routine")]
    levels = spark.createDataFrame([("HIGH", "Monitor"), ("x", "x"), (None, None)], "l string, u string")
    from evispark import fixed
    assert [tuple(r) for r in levels.select(R.normal_level(F.col("l")), R.normal_urgency(F.col("u")),
                                            R.normal_urgency(F.col("u"), fixed.AGENT_URGENCIES)).collect()] == [
        ("high", "monitor", "routine"), ("insufficient_info", "routine", "routine"), ("insufficient_info", "routine", "routine")]


def test_queries(spark):
    df = spark.createDataFrame([("cough", 55, ["a", "b", "c", "d"], "Lung"), ("x", 30, [], None)],
                               "q string, age int, s array<string>, c string")
    got = [r[0] for r in df.select(Q.patient_query(F.col("q"), F.col("age"), F.col("s"), F.col("c"))).collect()]
    assert got == ["cough aged 40 and over a b c lung cancer", "x"]
    expand = spark.createDataFrame([("Patient with cough and a lump",), ("persistent cough, coughing",), ("none",)], "q string")
    assert [r[0] for r in expand.select(Q.expand_query(F.col("q"))).collect()] == [
        "Patient with cough and a lump persistent cough chronic cough coughing", "persistent cough, coughing chronic cough", "none"]
    empty = spark.createDataFrame([("", [], None, [])], "p string, s array<string>, age int, r array<string>")
    assert empty.select(Q.assessment_query(F.col("p"), F.col("s"), F.col("age"), F.col("r"))).first()[0] == "cancer referral criteria"


def test_validation(spark):
    df = spark.createDataFrame([(1, 130, "robot"), (2, 50, "M"), (3, None, None)], "id int, age int, sex string")
    good, bad = validation.split(df, validation.RULES["patient"])
    assert {r.id for r in good.collect()} == {2, 3}
    assert bad.first().violations == ["age_range", "sex_known"]
    filled = validation.with_defaults(df, {"age": 0, "content_type": "text"}).orderBy("id").collect()
    assert (filled[2].age, filled[2].content_type) == (0, "text")
