"""Query texts from questions, patients and conversations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .text import contains_any, non_empty, words


def synonyms(query: Column, table: dict[str, list[str]] | None = None, limit: int = 3) -> Column:
    """Synonyms of terms in the query that it does not hold already, in table order."""
    table = table or fixed.SYMPTOM_SYNONYMS
    low = F.lower(query)
    found = [F.when(F.contains(low, F.lit(term)) & ~F.contains(low, F.lit(s.lower())), F.lit(s))
             for term, entries in table.items() for s in entries]
    return F.slice(F.array_compact(F.array(*found)), 1, limit)


def expand_query(query: Column, table: dict[str, list[str]] | None = None, limit: int = 3) -> Column:
    extra = F.array_join(synonyms(query, table, limit), " ")
    return F.when(extra != "", F.concat(query, F.lit(" "), extra)).otherwise(query)


def _joined(items: Column, first: int) -> Column:
    return F.when(F.size(items) > 0, F.array_join(F.slice(items, 1, first), " "))


def patient_query(query: Column, age: Column, symptom_list: Column, cancer: Column,
                  keywords: dict[str, list[str]] | None = None) -> Column:
    """Query, age phrase from 40 up, three symptoms, first keyword of the cancer type."""
    keywords = keywords or fixed.CANCER_KEYWORDS
    pairs = [F.lit(x) for name, words_ in keywords.items() for x in (name, words_[0])]
    return F.concat_ws(" ", query, F.when(age >= 40, F.lit("aged 40 and over")),
                       _joined(symptom_list, 3), F.create_map(*pairs)[F.lower(cancer)])


def assessment_query(complaint: Column, symptom_list: Column, age: Column, risk_factors: Column,
                     default: str = fixed.DEFAULT_ASSESSMENT_QUERY) -> Column:
    text = F.concat_ws(" ", non_empty(complaint), _joined(symptom_list, 5),
                       F.when(age >= 40, F.lit("aged 40 and over")), F.when(age >= 50, F.lit("aged 50 and over")),
                       _joined(risk_factors, 3))
    return F.when(text != "", text).otherwise(F.lit(default))


def _line(label: str, value: Column, tail: str = "") -> Column:
    return F.concat(F.lit(label), value, F.lit(tail))


def _listed(name: str) -> Column:
    return F.when(F.size(F.col(name)) > 0, F.array_join(name, ", "))


def _age() -> Column:
    return F.when(F.col("age") != 0, F.col("age").cast("string"))


PATIENT_FIELDS = ["age", "sex", "presenting_complaint", "symptoms", "symptom_duration",
                  "medical_history", "risk_factors", "family_history", "additional_notes"]


def patient_lines() -> Column:
    """Labelled lines of a patient row; empty fields are left out."""
    return F.concat_ws(
        "\n", _line("- Age: ", _age(), " years"), _line("- Sex: ", non_empty(F.col("sex"))),
        _line("- Presenting complaint: ", non_empty(F.col("presenting_complaint"))),
        _line("- Symptoms: ", _listed("symptoms")), _line("- Duration: ", non_empty(F.col("symptom_duration"))),
        _line("- Medical history: ", _listed("medical_history")), _line("- Risk factors: ", _listed("risk_factors")),
        _line("- Family history: ", _listed("family_history")),
        _line("- Additional notes: ", non_empty(F.col("additional_notes"))))


def task_description(label: str = fixed.GUIDELINE) -> Column:
    """The same lines as a task: risk factors before history, with opening and closing."""
    return F.concat_ws(
        "\n", F.lit(f"Assess this patient for potential cancer referral according to {label} guidelines:"),
        _line("- Age: ", _age(), " years"), _line("- Sex: ", non_empty(F.col("sex"))),
        _line("- Presenting complaint: ", non_empty(F.col("presenting_complaint"))),
        _line("- Symptoms: ", _listed("symptoms")), _line("- Duration: ", non_empty(F.col("symptom_duration"))),
        _line("- Risk factors: ", _listed("risk_factors")), _line("- Medical history: ", _listed("medical_history")),
        _line("- Family history: ", _listed("family_history")),
        _line("- Additional notes: ", non_empty(F.col("additional_notes"))),
        F.lit("\nProvide: risk level, urgency, recommended actions, and cite relevant "
              f"{label} sections."))


def patient_summary() -> Column:
    text = F.concat_ws(
        "; ", _line("Age: ", _age()), _line("Sex: ", non_empty(F.col("sex"))), _line("Symptoms: ", _listed("symptoms")),
        _line("Duration: ", non_empty(F.col("symptom_duration"))), _line("Risk factors: ", _listed("risk_factors")))
    return F.when(text != "", text).otherwise(F.lit("No patient information gathered yet."))


def session_summary(age: Column, sex: Column, symptom_list: Column, duration: Column, risk_factors: Column) -> Column:
    """One line for a conversation so far; ``?`` where nothing is known."""
    return F.concat(
        F.lit("Patient: "), F.coalesce(F.when(age != 0, age.cast("string")), F.lit("?")), F.lit("yo "),
        F.coalesce(non_empty(sex), F.lit("?")), F.lit(", symptoms: "),
        F.coalesce(F.when(F.size(symptom_list) > 0, F.array_join(symptom_list, ", ")), F.lit("unknown")),
        F.coalesce(F.concat(F.lit(" for "), non_empty(duration)), F.lit("")),
        F.coalesce(F.concat(F.lit(". Risk factors: "), F.when(F.size(risk_factors) > 0, F.array_join(risk_factors, ", "))),
                   F.lit("")))


def is_follow_up(text: Column) -> Column:
    """A follow-up phrase, or fewer than eight words not opening as a question."""
    low = F.lower(text)
    question = F.lit(False)
    for start in fixed.QUESTION_STARTS:
        question = question | low.startswith(start)
    return contains_any(low, fixed.FOLLOW_UP_PHRASES) | ((F.size(words(text)) < 8) & ~question)
