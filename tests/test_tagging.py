import re

import pytest
from conftest import one
from pyspark.sql import functions as F

from evispark.functions import tagging as T
from evispark.functions import vectors as V
from evispark.operators import chunking


def tagged(spark, text, **options):
    return one(T.tag(spark.createDataFrame([(text,)], "text string"), **options))


@pytest.mark.parametrize("text, field, expected", [
    ("people aged 40 and over", "age_thresholds", ["40+"]),
    ("30 years or younger", "age_thresholds", ["<30"]),
    ("over 40", "age_thresholds", []),
    ("within 12 weeks", "timeframes", ["12_week"]),
    ("12 weeks", "urgency", "urgent_2_week"),
    ("non-urgent referral", "urgency", "urgent"),
    ("Consider referral", "urgency", "consider"),
    ("nothing here", "urgency", "unknown"),
    ("Do not offer", "actions", ["do_not_offer"]),
    ("Chest X-ray and chest x ray", "investigations", ["chest_x_ray"]),
    ("section about a molecule", "investigations", ["ct"]),
    ("section about a molecule", "symptoms", ["mole"]),
    ("Lung cancer, smoker, family history", "cancer_types", ["lung_cancer"]),
    ("smoker with a family history", "risk_factors", ["smoker", "family_history"]),
])
def test_tags(spark, text, field, expected):
    assert tagged(spark, text)[field] == expected


def test_guarded_urgency(spark):
    assert tagged(spark, "12 weeks", strict=False)["urgency"] == "unknown"
    assert tagged(spark, "a 2-week wait", strict=False)["urgency"] == "urgent_2_week"
    assert tagged(spark, "non-urgent referral", strict=False)["urgency"] == "routine"


def test_word_boundary(spark):
    df = spark.createDataFrame([("section of a ct scan",)], "low string")
    assert one(df.select(T.lexicon_tags("low", ["ct", "mri"], word_boundary=True).alias("t")))["t"] == ["ct"]
    df = spark.createDataFrame([("section only",)], "low string")
    assert one(df.select(T.lexicon_tags("low", ["ct"], word_boundary=True).alias("t")))["t"] == []


def test_density_and_tokens(spark):
    df = spark.createDataFrame([("x" * 396 + "lump",), ("",), ("fever",)], "text string").withColumn("low", F.lower("text"))
    rows = df.select(T.density(F.col("text"), "low").alias("d"), T.token_estimate(F.col("text")).alias("n"),
                     T.token_floor(F.col("text")).alias("f")).collect()
    assert [tuple(r) for r in rows] == [(0.25, 100, 100), (0.0, 1, 0), (1.0, 1, 1)]


def test_embedding_prefix(spark):
    rich = {"cancer_types": "lung_cancer", "symptoms": "weight_loss,cough", "urgency": "urgent_2_week", "actions": "offer",
            "investigations": "ct,cxr", "age_thresholds": "40+"}
    df = spark.createDataFrame([tuple(rich.values()), ("",) * 6], ", ".join(f"{k} string" for k in rich))
    full, empty = [r[0] for r in df.select(V.embedding_prefix()).collect()]
    assert full == ("Cancer types: lung cancer | Symptoms: weight loss, cough | Urgency: urgent 2 week | Actions: offer | "
                    "Investigations: CT, CXR | Age criteria: 40+")
    assert empty == ""


def test_flags_and_flat_form(spark):
    text = "Refer urgently people aged 40 and over with haemoptysis for lung cancer"
    df = spark.createDataFrame([(text, "1.2.3 Lung")], "text string, section string")
    row = one(chunking.flatten_tags(chunking.enrich(df)))
    assert (row["has_recommendation"], row["is_urgent"], row["has_table"]) == (True, True, False)
    assert row["section_hierarchy"] == "1|1.2|1.2.3"
    assert row["cancer_types"] == "lung_cancer" and row["age_thresholds"] == "40+"


@pytest.mark.parametrize("regex, text", [
    ("(cat|horse)", "a cat"), ("[abc]de", "bde"), ("(foo)?bars", "bars"), ("weeks{0,1}", "week"), ("x?weeks?", "week"),
    (r"two[\s\-]?week", "twoweek"), (r"refer\s+urgently", "refer  urgently")])
def test_guard_never_hides_a_match(spark, regex, text):
    df = spark.createDataFrame([(text,), ("nothing",)], "t string")
    assert [r[0] for r in df.select(T.guarded_match(F.col("t"), [regex])).collect()] == [True, False]


def test_terms_are_looked_up_once(spark):
    """For the tags and for the density, which counts every term, also where two have one tag; a null text keeps its density."""
    lexicons = {"cancer_types": ["zebra"], "symptoms": ["sore-toe", "sore toe"], "investigations": ["scan"]}
    df = spark.createDataFrame([("a sore-toe, a Sore toe " + "x" * 377, ""), (None, "")], "text string, section string")
    tagged_rows = chunking.enrich(df, lexicons)
    text = tagged_rows._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Contains(text_lower") and len(re.findall(r"Contains\(text_lower#\d+, zebra\)", text)) == 1
    first, none = tagged_rows.collect()
    assert first["symptoms"] == ["sore_toe"] and first["semantic_density"] == 0.5
    plain = [r[0] for r in df.withColumn("low", F.lower("text")).select(T.density(F.col("text"), "low", ["zebra", "sore-toe", "sore toe", "scan"])).collect()]
    assert [first["semantic_density"], none["semantic_density"]] == plain and none["symptoms"] == []
