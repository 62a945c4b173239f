"""Columns from stored agent transcripts and answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .text import cut, pattern, strip


def valid_json(text: Column) -> Column:
    """The text if it is one whole JSON value, else null.

    Spark's parser stops after the first value, so text behind it would go unseen.  It
    cannot do so inside both an array and an object: the text has to parse in each.
    """
    in_array, in_object = F.concat(F.lit("["), text, F.lit("]")), F.concat(F.lit('{"v":'), text, F.lit("}"))
    return F.when(F.try_parse_json(in_array).isNotNull() & F.try_parse_json(in_object).isNotNull()
                  & (F.json_array_length(in_array) == 1), text)


def _matched(text: Column, regex: str, group: int, flags: str) -> Column:
    rx = pattern(regex, flags)
    return F.when(text.rlike(rx), strip(F.regexp_extract(text, rx, group)))


def step_fields(text: Column) -> dict[str, Column]:
    """Thought, action, input and final answer of one raw response.

    A final answer overrides an action; input that is not JSON becomes ``{}``.
    """
    final = _matched(text, fixed.FINAL_ANSWER_PATTERN, 1, "si")
    rx = pattern(fixed.ACTION_INPUT_PATTERN, "si")
    raw = F.regexp_extract(text, rx, 1)
    return {
        "thought": F.coalesce(_matched(text, fixed.THOUGHT_PATTERN, 1, "si"), F.lit("")),
        "action": F.when(final.isNull(), _matched(text, fixed.ACTION_NAME_PATTERN, 1, "i")),
        "action_input": F.when(final.isNull() & text.rlike(rx), F.coalesce(valid_json(raw), F.lit("{}"))),
        "final_answer": final,
    }


def lenient_json(text: Column) -> Column:
    """The whole text, a fenced block or the outermost braces: whichever is JSON first."""
    fence, braces = pattern(fixed.FENCED_JSON_PATTERN), pattern(fixed.BRACED_JSON_PATTERN)
    return F.coalesce(valid_json(text),
                      F.when(text.rlike(fence), valid_json(F.regexp_extract(text, fence, 1))),
                      F.when(F.contains(text, F.lit("{")), valid_json(F.nullif(F.regexp_extract(text, braces, 0), F.lit("")))))


def citations(text: Column, regex: str = fixed.CITATION_PATTERN) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern(regex)), 0)


def observation_cut(text: Column) -> Column:
    return cut(text, 200)


def step_block() -> Column:
    """A step in prompt form."""
    n = F.col("step").cast("string")
    action = F.col("action").isNotNull() & (F.col("action") != "")
    has_input = action & F.col("action_input").isNotNull() & ~F.col("action_input").isin("", "{}")
    return F.concat_ws(
        "\n", F.concat(F.lit("Thought "), n, F.lit(": "), F.coalesce("thought", F.lit(""))),
        F.when(action, F.concat(F.lit("Action "), n, F.lit(": "), F.col("action"))),
        F.when(has_input, F.concat(F.lit("Action Input "), n, F.lit(": "), F.col("action_input"))),
        F.when(F.col("observation") != "", F.concat(F.lit("Observation "), n, F.lit(": "), F.col("observation"))))


def step_display() -> Column:
    """A step for readers: cut thought, action label, cleaned observation."""
    n = F.col("step").cast("string")
    action = F.col("action").isNotNull() & (F.col("action") != "")
    label = F.coalesce(F.create_map(*[F.lit(x) for kv in fixed.ACTION_LABELS.items() for x in kv])[F.col("action")],
                       F.concat(F.lit("🔧 "), F.col("action")))
    seen = F.translate(cut(F.col("observation"), 100), '{}"', "")
    return F.concat_ws(
        "\n", F.concat(F.lit("\n**Step "), n, F.lit(":** "), cut(F.col("thought"), 150)),
        F.when(action, F.concat(F.lit("   → "), label)),
        F.when(action & (F.col("observation") != ""), F.concat(F.lit("   ✓ Found: "), seen)))


def reasoning_line() -> Column:
    """A step in the short summary of an assessment."""
    return F.concat(
        F.lit("Step "), F.col("step").cast("string"), F.lit(": "), F.left("thought", F.lit(100)), F.lit("...\n"),
        F.when(F.col("action").isNotNull(), F.concat(F.lit("  → Used tool: "), F.col("action"), F.lit("\n"))
               ).otherwise(F.lit("")))
