"""Triage of whole patient tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patients as P


def assess(patients: DataFrame, cancer: str | None = None) -> DataFrame:
    """Red flags, risk and (with a cancer column) pathway in one row-local projection."""
    out = (patients.withColumn("red_flags", P.red_flags(F.col("symptoms"), F.col("age")))
           .withColumn("_risk", P.risk(F.col("red_flags"), F.col("symptoms"), F.col("age"), F.col("risk_factors"))))
    out = out.select("*", "_risk.*").drop("_risk")
    return out.withColumn("pathway", P.pathway(F.col(cancer), F.col("urgency"))) if cancer else out


def flag_rows(assessed: DataFrame, key: str) -> DataFrame:
    return assessed.select(key, F.explode("red_flags").alias("f")).select(key, "f.*")


def report(assessed: DataFrame) -> DataFrame:
    """Patients by risk level and urgency; few groups, combined before the shuffle."""
    return assessed.groupBy("risk_level", "urgency").agg(
        F.count(F.lit(1)).alias("patients"), F.sum("score").alias("total_score"),
        F.sum(F.size("red_flags")).alias("red_flags"))


def symptoms_only(rows: DataFrame) -> DataFrame:
    """Patient rows from symptoms alone: the complaint is the symptoms, the rest is empty."""
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    return rows.withColumns({
        "presenting_complaint": F.array_join("symptoms", ", "), "symptom_duration": none, "medical_history": empty,
        "risk_factors": empty, "family_history": empty, "additional_notes": F.lit("")})
