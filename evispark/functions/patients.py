"""Triage rules over a patient row: red flags, risk score, pathway, level maps.

Every rule table is small and fixed, so rules are evaluated inside the row: no
join, no explode, no shuffle, whatever the number of patients.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .text import contains_any, literal_array

FLAG = "struct<symptom:string,red_flag:string,urgency:string,condition:string,note:string>"


def red_flags(symptoms: Column, age: Column, rules: Sequence[tuple[str, str, str]] | None = None) -> Column:
    """All (symptom, rule) pairs where one text contains the other, then the age rule."""
    table = F.array(*[F.struct(F.lit(f).alias("flag"), F.lit(c).alias("condition"), F.lit(n).alias("note"))
                      for f, c, n in rules or fixed.RED_FLAGS])
    lowered = F.filter(F.transform(symptoms, F.lower), lambda s: s != "")
    age_flag, age_urgency, age_condition, age_note = fixed.AGE_RED_FLAG

    def hits(s: Column) -> Column:
        return F.transform(
            F.filter(table, lambda r: F.contains(s, r["flag"]) | F.contains(r["flag"], s)),
            lambda r: F.struct(s.alias("symptom"), r["flag"].alias("red_flag"), F.lit("urgent_2_week").alias("urgency"),
                               r["condition"].alias("condition"), r["note"].alias("note")))

    by_age = F.transform(
        F.filter(lowered, lambda s: F.contains(s, F.lit("cough")) & F.contains(s, F.lit("persistent"))),
        lambda s: F.struct(s.alias("symptom"), F.lit(age_flag).alias("red_flag"), F.lit(age_urgency).alias("urgency"),
                           F.lit(age_condition).alias("condition"), F.lit(age_note).alias("note")))
    none = F.array().cast(f"array<{FLAG}>")
    return F.coalesce(F.concat(F.flatten(F.transform(lowered, hits)), F.when(age >= 40, by_age).otherwise(none)), none)


def needs_urgent_action(flags: Column) -> Column:
    return F.exists(flags, lambda f: f["urgency"] == "urgent_2_week")


def risk(flags: Column, symptoms: Column, age: Column, risk_factors: Column,
         high_risk: Sequence[str] | None = None) -> Column:
    """``struct<score, risk_level, urgency, reasons, recommendation>``."""
    symptoms = F.coalesce(symptoms, F.array().cast("array<string>"))
    factors = F.filter(F.coalesce(risk_factors, F.array().cast("array<string>")),
                       lambda r: contains_any(F.lower(r), high_risk or fixed.HIGH_RISK_FACTORS))
    points = (F.when(age >= 40, 20).otherwise(0) + F.when(age >= 50, 10).otherwise(0)
              + F.when(F.size(symptoms) >= 3, 15).otherwise(0) + F.size(factors) * 20)
    a = age.cast("string")
    reasons = F.concat(
        F.array_compact(F.array(
            F.when(age >= 40, F.concat(F.lit("Patient age "), a, F.lit(" (≥40)"))),
            F.when(age >= 50, F.concat(F.lit("Patient age "), a, F.lit(" (≥50)"))),
            F.when(F.size(symptoms) >= 3,
                   F.concat(F.lit("Multiple symptoms ("), F.size(symptoms).cast("string"), F.lit(")"))))),
        F.transform(factors, lambda r: F.concat(F.lit("Risk factor: "), r)))

    def outcome(score: Column, level: str, urgency: str, why: Column, advice: str) -> Column:
        return F.struct(score.cast("int").alias("score"), F.lit(level).alias("risk_level"),
                        F.lit(urgency).alias("urgency"), why.alias("reasons"), F.lit(advice).alias("recommendation"))

    out = F.when(needs_urgent_action(flags), outcome(
        F.lit(100), "high", "urgent_2_week", F.transform(flags, lambda f: f["note"]), fixed.RED_FLAG_RECOMMENDATION))
    for lowest, level, urgency, advice in fixed.RISK_BANDS[:-1]:
        out = out.when(points >= lowest, outcome(points, level, urgency, reasons, advice))
    _, level, urgency, advice = fixed.RISK_BANDS[-1]
    return out.otherwise(outcome(points, level, urgency, reasons, advice))


def pathway(cancer: Column, urgency: Column, table: Sequence[tuple] | None = None) -> Column:
    """``struct<pathway, timeline, actions>`` by (cancer, urgency), with a default."""
    table = table or fixed.PATHWAYS

    def row(name: Column, timeline: Column, actions: Column) -> Column:
        return F.struct(name.alias("pathway"), timeline.alias("timeline"), actions.alias("actions"))

    low = F.lower(cancer)
    out = None
    for c, u, name, timeline, actions in table:
        hit, value = (low == c) & (urgency == u), row(F.lit(name), F.lit(timeline), literal_array(actions))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    default = row(F.concat(F.lit("Suspected "), cancer, F.lit(" cancer pathway")),
                  F.when(urgency == "urgent_2_week", F.lit("2 weeks")).otherwise(F.lit("Routine")),
                  literal_array(fixed.PATHWAY_DEFAULT_ACTIONS))
    return out.otherwise(default)


def normal_level(level: Column) -> Column:
    low = F.lower(level)
    return F.when(low.isin(*fixed.RISK_LEVELS), low).otherwise(F.lit("insufficient_info"))


def normal_urgency(urgency: Column, known: Sequence[str] | None = None) -> Column:
    low = F.lower(urgency)
    return F.when(low.isin(*(known or fixed.ASSESSMENT_URGENCIES)), low).otherwise(F.lit("routine"))
