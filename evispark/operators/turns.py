"""Conversations as a table of turns: ``(conv_id, turn, role, text)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intents, query_text, transcripts
from ..session import checkpointed
from .parts import SPAN, has_long, part_window, running, with_overlap

FACTS = ["age", "symptoms", "duration", "risk_factors"]


def intent_flags(turns: DataFrame, text: str = "text") -> DataFrame:
    """Three flags per turn; row-local."""
    c = F.col(text)
    return turns.withColumns({"wants_assessment": intents.wants_assessment(c),
                              "context_question": intents.asks_about_context(c),
                              "patient_data": intents.brings_patient_data(c)})


def recent_user_text(turns: DataFrame, back: int = 3, span: int = SPAN) -> DataFrame:
    """Add ``recent``: lower-cased user text of the last ``back + 1`` turns."""
    w = part_window("conv_id", "turn").rowsBetween(-back, 0)
    said = F.collect_list(F.when(F.col("role") == "user", F.col("text"))).over(w)
    return (with_overlap(turns, "conv_id", "turn", back, span).withColumn("recent", F.lower(F.array_join(said, " ")))
            .where("_own").drop("_part", "_own", "_pos"))


def extracted_facts(turns: DataFrame, span: int = SPAN) -> DataFrame:
    """Age, symptom bits and duration stated in the last four turns (user text)."""
    low = F.col("recent")
    return recent_user_text(turns, 3, span).withColumns({
        "stated_age": intents.stated_age(low), "symptom_bits": intents.symptom_mask(low),
        "stated_duration": intents.stated_duration(low)})


def conversation_state(turns: DataFrame, span: int = SPAN) -> DataFrame:
    """What is known after each user turn, what is missing, and what to do next.

    A question about the conversation itself adds nothing and changes no state.
    """
    long = has_long(turns, "turn", span)   # asked of the table, not of what is derived from it
    facts = extracted_facts(turns, span).withColumns({
        "context_question": intents.asks_about_context(F.col("text")),
        "wants_assessment": intents.wants_assessment(F.col("text"))})
    adds = (F.col("role") == "user") & ~F.col("context_question")
    known = running(facts, "conv_id", "turn", {
        "age": ("last", F.when(adds, F.col("stated_age"))),
        "bits": ("or", F.when(adds, F.col("symptom_bits")).otherwise(F.lit(0).cast("long"))),
        "duration": ("last", F.when(adds, F.col("stated_duration"))),
    }, span=span, long=long).where(F.col("role") == "user")
    has = {"age": F.col("age").isNotNull(), "symptoms": F.col("bits") != 0,
           "duration": F.col("duration").isNotNull(), "risk_factors": F.lit(False)}
    ask, ready = F.col("wants_assessment"), has["age"] & has["symptoms"] & has["duration"]
    decided = known.withColumns({
        "symptoms": intents.mask_to_symptoms(F.col("bits")),
        "missing": F.array_compact(F.array(*[F.when(~has[f], F.lit(f)) for f in FACTS])),
        "decision": F.when(F.col("context_question"), "answer_context")
                     .when(ask & has["symptoms"], "assess").when(ask, "ask_missing")
                     .when(ready, "confirm").otherwise("ask_missing")})
    to_state = (F.when(F.col("decision") == "assess", "complete").when(F.col("decision") == "confirm", "clarifying")
                .when(F.col("decision") == "ask_missing", "gathering"))
    out = running(decided, "conv_id", "turn", {"state": ("last", to_state)}, span=span, long=long)
    return out.withColumn("state", F.coalesce("state", F.lit("greeting"))).select(
        "conv_id", "turn", "age", "symptoms", "duration", "missing", "decision", "state")


def follow_up_queries(turns: DataFrame, span: int = SPAN) -> DataFrame:
    """Search text of every user turn; a follow-up is joined to the user text before it."""
    user = F.col("role") == "user"
    seen = running(turns, "conv_id", "turn", {
        "previous": ("last", F.when(user, F.col("text"))), "earlier": ("count", F.lit(1))}, inclusive=False, span=span)
    follow = query_text.is_follow_up(F.col("text")) & (F.col("earlier") >= 2) & F.col("previous").isNotNull()
    return seen.where(user).select(
        "conv_id", "turn", follow.alias("is_follow_up"),
        F.when(follow, F.concat("previous", F.lit(" "), "text")).otherwise(F.col("text")).alias("search_text"))


def _spoken() -> Column:
    return F.concat(F.when(F.col("role") == "user", F.lit("User: ")).otherwise(F.lit("Assistant: ")), F.col("text"))


def history_text(turns: DataFrame, last: int = 10, summary: str | None = None, summarise_after: int = 8,
                 short: int = 4, span: int = SPAN) -> DataFrame:
    """The last turns as text, per turn; with a summary column and enough turns, summary and fewer turns."""
    w = part_window("conv_id", "turn")
    lines = with_overlap(turns, "conv_id", "turn", last - 1, span).withColumn("_line", _spoken())
    out = lines.withColumn("_last", F.collect_list("_line").over(w.rowsBetween(-(last - 1), 0))).where("_own")
    text = F.array_join("_last", "\n\n")
    if summary is not None:
        recent = F.array_join(F.slice("_last", F.greatest(F.lit(1), F.size("_last") - short + 1), F.lit(short)), "\n\n")
        text = F.when((F.coalesce(F.col(summary), F.lit("")) != "") & (F.col("_pos") + 1 > summarise_after),
                      F.concat(F.lit("[Previous conversation summary: "), F.col(summary),
                               F.lit("]\n\nRecent conversation:\n"), recent)).otherwise(text)
    return out.select("conv_id", "turn", text.alias("history"))


def session_summaries(turns: DataFrame, span: int = SPAN) -> DataFrame:
    """One line per conversation from everything its user turns stated.

    The newest facts per conversation are an aggregate with a map-side part, so the
    running window is not needed here.
    """
    facts = extracted_facts(turns, span).withColumn("context_question", intents.asks_about_context(F.col("text")))
    adds = (F.col("role") == "user") & ~F.col("context_question")
    newest = lambda c: F.max_by(F.col(c), F.when(adds & F.col(c).isNotNull(), F.col("turn")))
    one = facts.groupBy("conv_id").agg(
        newest("stated_age").alias("age"), newest("stated_duration").alias("duration"),
        F.bit_or(F.when(adds, F.col("symptom_bits")).otherwise(F.lit(0).cast("long"))).alias("bits"))
    none = F.lit(None).cast("string")
    return one.select("conv_id", query_text.session_summary(
        F.col("age"), none, intents.mask_to_symptoms(F.col("bits")), F.col("duration"),
        F.array().cast("array<string>")).alias("summary"))


def last_citations(turns: DataFrame) -> DataFrame:
    """Citations of the newest assistant turn that has any; empty list if none has."""
    cited = turns.select("conv_id", "turn", F.when(
        F.col("role") == "assistant", transcripts.citations(F.col("text"))).alias("c"))
    return cited.groupBy("conv_id").agg(F.coalesce(
        F.max_by("c", F.when(F.size("c") > 0, F.col("turn"))),
        F.array().cast("array<string>")).alias("citations"))


def extract_with_negation(notes: DataFrame, text: str = "text", terms: list[str] | None = None,
                          risk_terms: list[str] | None = None) -> DataFrame:
    """Symptoms, negated symptoms, duration, risk factors, age and sex of free text.

    Rule-based (lexicon and negation cues); it does not claim the result of a model.
    """
    from .. import fixed
    c, terms = F.col(text), terms or fixed.SYMPTOMS
    risk_terms = risk_terms or fixed.RISK_FACTORS
    low = F.lower(c)
    out = notes.withColumns({"negated": intents.negated_terms(c, terms),
                             "_negated_risk": intents.negated_terms(c, risk_terms)})
    return out.withColumns({
        "symptoms": intents.affirmed_terms(c, terms, F.col("negated")),
        "risk_factors": intents.affirmed_terms(c, risk_terms, F.col("_negated_risk")),
        "duration": intents.stated_duration(low), "age": intents.stated_age(low), "sex": intents.stated_sex(c),
    }).drop("_negated_risk")


def number_turns(turns: DataFrame, order: str) -> DataFrame:
    """Give turns 0-based places when they only have an order column.

    Rows are sorted by range over (conversation, order), written once with the number of their range,
    numbered inside each range, and shifted by the counts of the ranges before: no task holds a whole
    conversation, and both sides of the join see the same ranges.
    """
    ranged = checkpointed(turns.repartitionByRange(F.col("conv_id"), F.col(order)).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("conv_id", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("conv_id").alias("_conv"), F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("conv_id", "_range").orderBy(order)
    numbered = ranged.withColumn("_i", F.row_number().over(inside) - 1).join(
        base, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_range") == F.col("_of")))
    return numbered.withColumn("turn", (F.col("_base") + F.col("_i")).cast("long")).drop("_range", "_i", "_base", "_conv", "_of")
