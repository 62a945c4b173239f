"""Full retrieval evaluation: truth from tags, search, metrics, gates, missed chunks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tagging import parse_tag_field
from ..operators import evaluation as E
from ..operators.retrieval import Embed, retrieve
from ..session import checkpointed


@dataclass
class Evaluation:
    qrels: DataFrame
    run: DataFrame
    per_query: DataFrame
    mean: DataFrame
    gates: DataFrame
    missed: DataFrame


def evaluate(queries: DataFrame, chunks: DataFrame, flat: DataFrame, embed: Embed, k: int = 5,
             threshold: float = 0.5) -> Evaluation:
    """``queries``: ``query_id, query, cancers, symptoms, urgency``; ``flat`` has comma-string tags."""
    tagged = flat.select("chunk_id", parse_tag_field(F.col("cancer_types")).alias("cancer_types"),
                         parse_tag_field(F.col("symptoms")).alias("symptoms"), "urgency")
    run = checkpointed(retrieve(queries.select("query_id", "query"), chunks, embed, k, threshold=threshold))
    # Metrics need the grades of the run and counts of the rest; the table of all relevant pairs is only a report.
    per_query = E.graded_metrics(E.grade_run(run, queries, tagged), E.grade_counts(queries, tagged), queries, k)
    mean = E.mean_metrics(per_query)
    qrels = E.build_qrels(queries, tagged)
    return Evaluation(qrels, run, per_query, mean, E.quality_gates(mean), E.missed_chunks(run, qrels, k))
