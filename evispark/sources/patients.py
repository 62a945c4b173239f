"""Patient files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

def read_patients(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Patient rows from a JSON list, from ``{"patients": [...]}``, or from lines.  The id is ``patient_id`` or ``id``."""
    both = f"patients array<{schemas.struct_ddl(schemas.PATIENT_FILE)}>, {schemas.ddl(schemas.PATIENT_FILE)}"
    raw = spark.read.schema(both).option("multiLine", multiline).json(path)
    own = F.array(F.struct(*[F.col(f) for f in schemas.PATIENT_FILE]))
    rows = raw.select(F.explode(F.coalesce("patients", own)).alias("p")).select("p.*")
    return rows.withColumn("patient_id", F.coalesce("patient_id", "id")).drop("id")


def patient_list(patients: DataFrame) -> DataFrame:
    return patients.select(F.col("patient_id").alias("id"), F.coalesce("name", F.lit("Unknown")).alias("name"), "age",
                           F.left(F.coalesce(F.array_join("symptoms", ", "), F.lit("")), F.lit(100)
                                  ).alias("presenting_complaint"))


def find_patients(patients: DataFrame, term: str) -> DataFrame:
    """Case-insensitive substring of id or name."""
    t = F.lit(term.lower())
    return patients.where(F.contains(F.lower("patient_id"), t) | F.coalesce(F.contains(F.lower("name"), t), F.lit(False)))


def patient(patients: DataFrame, patient_id: str) -> DataFrame:
    return patients.where(F.col("patient_id") == patient_id)


def for_triage(patients: DataFrame) -> DataFrame:
    """Patient file rows as triage input: the smoking history is the risk factor."""
    return patients.withColumns({
        "risk_factors": F.when(F.coalesce("smoking_history", F.lit("")) != "", F.array("smoking_history")
                               ).otherwise(F.array().cast("array<string>")),
        "sex": F.when(F.col("gender") == "Male", "male").when(F.col("gender") == "Female", "female").otherwise("other"),
        "symptom_duration": F.col("symptom_duration_days").cast("string")})
