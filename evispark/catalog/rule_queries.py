"""Triage rules, patient texts, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions import patients as R
from ..functions import query_text as Q
from ..operators import retrieval, triage, validation
from ..operators.sizes import spread
from ..plans import assess
from . import query
from .derived import PATIENTS_SQL, patients, quoted, table, texts
from .lookup_queries import CITATION_SQL
from .search_queries import (CHUNK_VECTORS_SQL, SCORE, embed, patient_requests, ranked_sql, search_chunks, sql_patient_query,
                             sql_vector)
from .text_queries import flat_notes

RULES_SQL = "rules AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {quoted(f)}, {quoted(c)}, {quoted(n)})" for i, (f, c, n) in enumerate(fixed.RED_FLAGS)) + ") t(rule_no, flag, condition, note))"
_age_flag, _age_urgency, _age_condition, _age_note = fixed.AGE_RED_FLAG
FLAGS_CTE = f"""{PATIENTS_SQL}, {RULES_SQL},
sym AS (SELECT patient_id, age, lower(symptoms[j]) AS symptom, j FROM (SELECT *, generate_subscripts(symptoms, 1) AS j FROM patients)),
flags AS (SELECT patient_id, 0 AS kind, j, rule_no, symptom, flag AS red_flag, 'urgent_2_week' AS urgency, condition, note FROM sym
    JOIN rules ON contains(symptom, flag) OR contains(flag, symptom)
  UNION ALL SELECT patient_id, 1, j, 0, symptom, {quoted(_age_flag)}, {quoted(_age_urgency)}, {quoted(_age_condition)}, {quoted(_age_note)} FROM sym
    WHERE age >= 40 AND contains(symptom, 'cough') AND contains(symptom, 'persistent'))"""
HIGH = " OR ".join(f"contains(lower(r), {quoted(w)})" for w in fixed.HIGH_RISK_FACTORS)
RISK_CTE = f"""{FLAGS_CTE}, byp AS (SELECT patient_id, count(*) FILTER (urgency = 'urgent_2_week') AS urgent_flags, count(*) AS n_flags,
  string_agg(note, ';' ORDER BY kind, j, rule_no) AS notes FROM flags GROUP BY patient_id),
pts AS (SELECT p.*, coalesce(urgent_flags, 0) AS urgent_flags, coalesce(n_flags, 0) AS n_flags, notes, list_filter(risk_factors, lambda r: {HIGH}) AS hits FROM patients p LEFT JOIN byp USING (patient_id)),
scored AS (SELECT *, CASE WHEN age >= 40 THEN 20 ELSE 0 END + CASE WHEN age >= 50 THEN 10 ELSE 0 END + CASE WHEN len(symptoms) >= 3 THEN 15 ELSE 0 END
  + 20 * len(hits) AS points, concat_ws(';', CASE WHEN age >= 40 THEN 'Patient age ' || age || ' (≥40)' END, CASE WHEN age >= 50 THEN 'Patient age ' || age || ' (≥50)' END,
  CASE WHEN len(symptoms) >= 3 THEN 'Multiple symptoms (' || len(symptoms) || ')' END,
  CASE WHEN len(hits) > 0 THEN array_to_string(list_transform(hits, lambda r: 'Risk factor: ' || r), ';') END) AS why FROM pts),
risk AS (SELECT patient_id, cancer, n_flags, CAST(CASE WHEN urgent_flags > 0 THEN 100 ELSE points END AS INTEGER) AS score,
  CASE WHEN urgent_flags > 0 OR points >= 60 THEN 'high' WHEN points >= 40 THEN 'moderate' ELSE 'low' END AS risk_level,
  CASE WHEN urgent_flags > 0 OR points >= 60 THEN 'urgent_2_week' WHEN points >= 40 THEN 'urgent' ELSE 'routine' END AS urgency,
  CASE WHEN urgent_flags > 0 THEN notes ELSE why END AS reasons,
  CASE WHEN urgent_flags > 0 THEN {quoted(fixed.RED_FLAG_RECOMMENDATION)} {" ".join(f"WHEN points >= {s} THEN {quoted(r)}" for s, _, _, r in fixed.RISK_BANDS)} END AS recommendation FROM scored)"""


@query("red_flags", f"WITH {FLAGS_CTE} SELECT patient_id, symptom, red_flag, urgency, condition, note FROM flags")
def red_flags(spark, sf):
    return triage.flag_rows(triage.assess(patients(spark, sf)), "patient_id")


@query("risk_score", f"WITH {RISK_CTE} SELECT patient_id, score, risk_level, urgency, reasons, recommendation FROM risk")
def risk_score(spark, sf):
    return triage.assess(patients(spark, sf)).select("patient_id", "score", "risk_level", "urgency",
                                                    F.array_join("reasons", ";").alias("reasons"), "recommendation")


PATHWAY_WHEN = "lower(cancer) = '{}' AND urgency = '{}'"


def _pathway(field: int, default: str) -> str:
    cases = " ".join(f"WHEN {PATHWAY_WHEN.format(c, u)} THEN {quoted(v if isinstance(v, str) else ';'.join(v))}"
                     for c, u, *rest in fixed.PATHWAYS for v in [rest[field]])
    return f"CASE {cases} ELSE {default} END"


@query("pathways", f"""WITH {RISK_CTE} SELECT patient_id, cancer, urgency, {_pathway(0, "'Suspected ' || cancer || ' cancer pathway'")} AS pathway,
  {_pathway(1, "CASE WHEN urgency = 'urgent_2_week' THEN '2 weeks' ELSE 'Routine' END")} AS timeline,
  {_pathway(2, quoted(';'.join(fixed.PATHWAY_DEFAULT_ACTIONS)))} AS actions FROM risk""")
def pathways(spark, sf):
    return triage.assess(patients(spark, sf), cancer="cancer").select(
        "patient_id", "cancer", "urgency", "pathway.pathway", "pathway.timeline", F.array_join("pathway.actions", ";").alias("actions"))


@query("triage_report", f"""WITH {RISK_CTE} SELECT risk_level, urgency, count(*) AS patients, CAST(sum(score) AS BIGINT) AS total_score,
  CAST(sum(n_flags) AS BIGINT) AS red_flags FROM risk GROUP BY risk_level, urgency""")
def triage_report(spark, sf):
    return triage.report(triage.assess(patients(spark, sf)))


@query("level_map", f"""WITH {PATIENTS_SQL} SELECT patient_id, CASE WHEN lower(stated_urgency) IN ('critical','high','moderate','low','insufficient_info')
  THEN lower(stated_urgency) ELSE 'insufficient_info' END AS level,
  CASE WHEN lower(stated_urgency) IN ('immediate','urgent_2_week','urgent','soon','routine','monitor') THEN lower(stated_urgency) ELSE 'routine' END AS assessment_urgency,
  CASE WHEN lower(stated_urgency) IN ('immediate','urgent_2_week','urgent','soon','routine') THEN lower(stated_urgency) ELSE 'routine' END AS agent_urgency FROM patients""")
def level_map(spark, sf):
    u = F.col("stated_urgency")
    return patients(spark, sf).select("patient_id", R.normal_level(u).alias("level"), R.normal_urgency(u).alias("assessment_urgency"),
                                      R.normal_urgency(u, fixed.AGENT_URGENCIES).alias("agent_urgency"))


@query("patient_query", f"""WITH {PATIENTS_SQL} SELECT patient_id, {sql_patient_query('presenting_complaint', 'age', 'symptoms', 'cancer')} AS patient_query,
  coalesce(nullif(concat_ws(' ', nullif(presenting_complaint, ''), array_to_string(list_slice(symptoms, 1, 5), ' '), CASE WHEN age >= 40 THEN 'aged 40 and over' END,
    CASE WHEN age >= 50 THEN 'aged 50 and over' END, CASE WHEN len(risk_factors) > 0 THEN array_to_string(list_slice(risk_factors, 1, 3), ' ') END), ''),
    'cancer referral criteria') AS assessment_query FROM patients""")
def patient_query(spark, sf):
    p = patients(spark, sf)
    return p.select("patient_id",
                    Q.patient_query(F.col("presenting_complaint"), F.col("age"), F.col("symptoms"), F.col("cancer")).alias("patient_query"),
                    Q.assessment_query(F.col("presenting_complaint"), F.col("symptoms"), F.col("age"), F.col("risk_factors")).alias("assessment_query"))


@query("request_contexts", f"""WITH {PATIENTS_SQL} SELECT patient_id, {sql_patient_query('presenting_complaint', 'age', 'symptoms', 'cancer')} AS expanded_query,
  concat_ws(';', CASE WHEN age <> 0 THEN 'age=' || age END, 'symptoms=' || array_to_string(symptoms, ', '), 'cancer_type=' || cancer,
    CASE WHEN patient_id % 5 = 0 THEN 'urgent_only=true' END) AS filters FROM patients""")
def request_contexts(spark, sf):
    out = retrieval.request_contexts(patient_requests(spark, sf))
    pairs = F.transform(F.map_entries("filters_applied"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.select(F.col("query_id").alias("patient_id"), "expanded_query", F.array_join(pairs, ";").alias("filters"))


ASSESSMENT_TEXT = """coalesce(nullif(concat_ws(' ', nullif(presenting_complaint, ''), array_to_string(list_slice(symptoms, 1, 5), ' '), CASE WHEN age >= 40 THEN 'aged 40 and over' END,
    CASE WHEN age >= 50 THEN 'aged 50 and over' END, CASE WHEN len(risk_factors) > 0 THEN array_to_string(list_slice(risk_factors, 1, 3), ' ') END), ''), 'cancer referral criteria')"""


@query("assess_patients", f"""WITH {CHUNK_VECTORS_SQL}, {RISK_CTE}, q AS (SELECT patient_id AS query_id, {sql_vector(ASSESSMENT_TEXT, 32)} AS e FROM patients), """
       + ranked_sql("wide", f"SELECT query_id, chunk_id, {SCORE} AS score FROM q, c", 3)
       + f""", ev AS (SELECT query_id AS patient_id, string_agg({CITATION_SQL}, ';' ORDER BY rank) AS citations FROM wide JOIN flat USING (chunk_id) WHERE score >= 0.55 GROUP BY query_id)
SELECT patient_id, score, CASE WHEN citations IS NULL THEN 'insufficient_info' ELSE risk_level END AS risk_level, CASE WHEN citations IS NULL THEN 'routine' ELSE urgency END AS urgency,
  CASE WHEN citations IS NULL THEN 'Gather additional clinical information' ELSE recommendation END AS action, coalesce(citations, '') AS citations FROM risk LEFT JOIN ev USING (patient_id)""")
def assess_patients(spark, sf):
    """Rules, evidence and citations for every patient."""
    out = assess.assess_patients(spread(patients(spark, sf)), search_chunks(spark, sf), flat_notes(spark, sf), embed, k=3, threshold=0.55)
    return out.select("patient_id", "score", "risk_level", "urgency", F.get("recommended_actions", F.lit(0)).alias("action"),
                      F.coalesce(F.array_join("citations", ";"), F.lit("")).alias("citations"))


LINE = "CASE WHEN {} THEN '{}' || {} || '{}' END"
AGE, SEX = LINE.format("age <> 0", "- Age: ", "age", " years"), LINE.format("sex <> ''", "- Sex: ", "sex", "")
COMPLAINT = LINE.format("presenting_complaint <> ''", "- Presenting complaint: ", "presenting_complaint", "")
SYMPTOMS = LINE.format("len(symptoms) > 0", "- Symptoms: ", "array_to_string(symptoms, ', ')", "")
DURATION = LINE.format("symptom_duration <> ''", "- Duration: ", "symptom_duration", "")
RISK = LINE.format("len(risk_factors) > 0", "- Risk factors: ", "array_to_string(risk_factors, ', ')", "")
FAMILY = LINE.format("len(family_history) > 0", "- Family history: ", "array_to_string(family_history, ', ')", "")


@query("patient_texts", f"""WITH {PATIENTS_SQL} SELECT patient_id, concat_ws(chr(10), {AGE}, {SEX}, {COMPLAINT}, {SYMPTOMS}, {DURATION}, {RISK}, {FAMILY}) AS lines,
  md5(concat_ws(chr(10), 'Assess this patient for potential cancer referral according to NG12 guidelines:', {AGE}, {SEX}, {COMPLAINT}, {SYMPTOMS}, {DURATION}, {RISK}, {FAMILY},
    chr(10) || 'Provide: risk level, urgency, recommended actions, and cite relevant NG12 sections.')) AS task_md5,
  concat_ws('; ', CASE WHEN age <> 0 THEN 'Age: ' || age END, 'Sex: ' || sex, 'Symptoms: ' || array_to_string(symptoms, ', '), 'Duration: ' || symptom_duration,
    CASE WHEN len(risk_factors) > 0 THEN 'Risk factors: ' || array_to_string(risk_factors, ', ') END) AS summary FROM patients""")
def patient_texts(spark, sf):
    return patients(spark, sf).select("patient_id", Q.patient_lines().alias("lines"), F.md5(Q.task_description()).alias("task_md5"),
                                      Q.patient_summary().alias("summary"))


@query("symptoms_only", f"""WITH {PATIENTS_SQL} SELECT patient_id, array_to_string(symptoms, ', ') || ' ' || array_to_string(list_slice(symptoms, 1, 5), ' ')
  || CASE WHEN age >= 40 THEN ' aged 40 and over' ELSE '' END || CASE WHEN age >= 50 THEN ' aged 50 and over' ELSE '' END AS assessment_query FROM patients""")
def symptoms_only(spark, sf):
    p = triage.symptoms_only(patients(spark, sf).select("patient_id", "age", "sex", "symptoms"))
    return p.select("patient_id", Q.assessment_query(F.col("presenting_complaint"), F.col("symptoms"), F.col("age"), F.col("risk_factors")).alias("assessment_query"))


def requests(spark, sf):
    """Documents as requests with good and bad values."""
    n = F.col("doc_id")
    return texts(spark, sf, "documents").select(
        n.alias("request_id"), (n % 140 - 10).cast("int").alias("age"),
        F.when(n % 4 == 0, "Male").when(n % 4 == 1, "F").when(n % 4 == 2, "robot").alias("sex"),
        F.when(n % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("cough"))).alias("symptoms"),
        F.col("text").alias("query"), F.col("text").alias("message"), "text", (n % 25).cast("int").alias("top_k"),
        (n % 7).cast("int").alias("rating"), (n % 13 / 10.0).alias("confidence"))


REQUESTS_SQL = """requests AS (SELECT n AS request_id, n % 140 - 10 AS age, CASE n % 4 WHEN 0 THEN 'Male' WHEN 1 THEN 'F' WHEN 2 THEN 'robot' END AS sex,
  n % 5 = 0 AS no_symptoms, text_len AS query_len, text_len, n % 25 AS top_k, n % 7 AS rating, n % 13 / 10.0 AS confidence
  FROM (SELECT doc_id AS n, length(text) AS text_len FROM documents))"""


@query("validate_rows", f"""WITH {REQUESTS_SQL} SELECT request_id, concat_ws(';', CASE WHEN age < 0 OR age > 120 THEN 'age_range' END,
  CASE WHEN lower(sex) NOT IN ('male','female','other','m','f') THEN 'sex_known' END, CASE WHEN no_symptoms THEN 'symptoms_required' END,
  CASE WHEN query_len < 1 OR query_len > 5000 THEN 'message_length' END, CASE WHEN query_len < 1 OR query_len > 1000 THEN 'query_length' END,
  CASE WHEN top_k < 1 OR top_k > 20 THEN 'top_k_range' END, CASE WHEN text_len < 10 OR text_len > 10000 THEN 'text_length' END,
  CASE WHEN rating < 1 OR rating > 5 THEN 'rating_range' END, CASE WHEN confidence > 1 THEN 'confidence_range' END) AS violations FROM requests""")
def validate_rows(spark, sf):
    rules = {"age_range": validation.RULES["patient"]["age_range"], "sex_known": validation.RULES["patient"]["sex_known"],
             "symptoms_required": validation.RULES["quick"]["symptoms_required"]}
    for form in ("chat", "search", "extract", "feedback", "assessment"):
        rules.update(validation.RULES[form])
    return validation.check(requests(spark, sf), rules).select("request_id", F.array_join("violations", ";").alias("violations"))


@query("quarantine", f"""WITH {REQUESTS_SQL}, v AS (SELECT age >= 0 AND age <= 120 AND coalesce(lower(sex) IN ('male','female','other','m','f'), true) AS ok FROM requests)
SELECT ok, count(*) AS n FROM v GROUP BY ok""")
def quarantine(spark, sf):
    good, bad = validation.split(requests(spark, sf), validation.RULES["patient"])
    return (good.select(F.lit(True).alias("ok")).unionByName(bad.select(F.lit(False).alias("ok"))).groupBy("ok").agg(F.count(F.lit(1)).alias("n")))


@query("row_defaults", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'text' ELSE c_mktsegment END AS content_type, CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE CAST(c_custkey AS INTEGER) END AS token_count,
  '' AS urgency, false AS is_urgent FROM customer""")
def row_defaults(spark, sf):
    from .. import schemas
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select("c_custkey", F.when(k % 3 != 0, F.col("c_mktsegment")).alias("content_type"),
                                               F.when(k % 2 != 0, k.cast("int")).alias("token_count"))
    return validation.with_defaults(rows, {n: schemas.FLAT_DEFAULTS[n] for n in ("content_type", "token_count", "urgency", "is_urgent")})
