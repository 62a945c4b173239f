"""Patients with rules, evidence and citations in one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import query_text
from ..operators import lookups, retrieval, triage
from ..operators.search import top_k


def assess_patients(patients: DataFrame, chunks: DataFrame, flat: DataFrame, embed: retrieval.Embed, k: int = 5,
                    threshold: float = 0.5, key: str = "patient_id") -> DataFrame:
    """Rules per patient, the evidence found for them, and a fixed outcome where there is none."""
    ruled = triage.assess(patients)
    query = query_text.assessment_query(F.col("presenting_complaint"), F.col("symptoms"), F.col("age"), F.col("risk_factors"))
    vectors = patients.select(F.col(key).alias("query_id"), embed(query).alias("embedding"))
    hits = retrieval.finish(top_k(vectors, chunks, 2 * k), k, threshold)
    evidence = lookups.context_texts(retrieval.hit_rows(hits, flat), k).withColumnRenamed("query_id", key)
    joined = ruled.join(evidence, key, "left")
    none = F.col("citations").isNull()
    return joined.withColumns({
        "risk_level": F.when(none, "insufficient_info").otherwise(F.col("risk_level")),
        "urgency": F.when(none, "routine").otherwise(F.col("urgency")),
        "confidence": F.when(none, 0.0).otherwise(F.lit(None).cast("double")),
        "recommended_actions": F.when(none, F.array(F.lit("Gather additional clinical information"))).otherwise(
            F.array("recommendation"))})
