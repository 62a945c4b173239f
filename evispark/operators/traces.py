"""Stored agent transcripts: ``(run_id, step, raw_text)`` and parsed traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import transcripts as X
from .sizes import join_checked

STEPS_PER_PART = 256


def parse_steps(raw: DataFrame, text: str = "raw_text") -> DataFrame:
    return raw.withColumns(X.step_fields(F.col(text)))


def tools_used(trace: DataFrame) -> DataFrame:
    """Actions in step order, one row each: nothing to group, nothing to shuffle."""
    return trace.where((F.col("action").isNotNull()) & (F.col("action") != "")).select("run_id", "step", "action")


def run_totals(trace: DataFrame) -> DataFrame:
    """Steps and tool calls per run (counts combine before the shuffle)."""
    return trace.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("steps"), F.count(F.nullif("action", F.lit(""))).alias("tool_calls"),
        F.count_distinct(F.nullif("action", F.lit(""))).alias("tools"))


def render(trace: DataFrame, form: str = "prompt", per_part: int = STEPS_PER_PART) -> DataFrame:
    """One text per run.  Steps are joined ``per_part`` at a time first, so that no task sorts all steps of a long run.

    ``form`` is ``prompt`` (full), ``display`` (labels and cuts) or ``reasoning`` (short).
    """
    block, gap = {"prompt": (X.step_block(), "\n\n"), "display": (X.step_display(), "\n"),
                  "reasoning": (X.reasoning_line(), "")}[form]

    def joined(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
        texts = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), "text")))
        return rows.groupBy(*keys).agg(F.array_join(F.transform(texts, lambda s: s["text"]), gap).alias("text"))
    lines = trace.select("run_id", F.floor((F.col("step") - 1) / per_part).alias("part"), "step", block.alias("text"))
    return joined(joined(lines, ["run_id", "part"], "step"), ["run_id"], "part")


def step_table(trace: DataFrame) -> DataFrame:
    """The stored form of a trace: observations cut at 200 characters."""
    return trace.withColumn("observation", X.observation_cut(F.col("observation")))


def trace_by_id(trace: DataFrame, wanted: DataFrame) -> DataFrame:
    """Trace rows of the wanted runs; a run without trace gives one row, ``found`` false."""
    ids = wanted.select("run_id").distinct()
    rows = join_checked(trace, ids, "run_id", "left_semi").withColumn("found", F.lit(True))
    return ids.join(rows, "run_id", "left").fillna(False, ["found"])


def citation_rows(answers: DataFrame, text: str = "answer", key: str = "query_id") -> DataFrame:
    return answers.select(key, F.explode(F.array_distinct(X.citations(F.col(text)))).alias("citation"))


def groundedness(answers: DataFrame, hits: DataFrame, threshold: float = fixed.GROUNDED_THRESHOLD,
                 min_supporting: int = 1) -> DataFrame:
    """Grounded if enough hits reach the threshold and every citation was retrieved.

    ``hits`` has ``query_id, score, citation``.
    """
    support = hits.groupBy("query_id").agg(
        F.max("score").alias("best_score"),
        F.sum((F.col("score") >= threshold).cast("int")).alias("supporting"))
    cited = citation_rows(answers)
    unsupported = (cited.join(hits.select("query_id", "citation").distinct(), ["query_id", "citation"], "left_anti")
                   .groupBy("query_id").agg(F.count(F.lit(1)).alias("unsupported")))
    totals = cited.groupBy("query_id").agg(F.count(F.lit(1)).alias("cited"))
    out = (answers.select("query_id").distinct().join(support, "query_id", "left").join(totals, "query_id", "left")
           .join(unsupported, "query_id", "left").fillna(0, ["supporting", "cited", "unsupported"]))
    return out.withColumn("grounded", (F.col("supporting") >= min_supporting) & (F.col("unsupported") == 0))
