"""Retrieval over tables of queries: expansion, patient context, threshold, sections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import query_text
from ..session import checkpointed
from .keywords import KeywordIndex, fuse, keyword_search
from .lookups import with_citations
from .search import Names, rank_hits, top_k
from .sizes import join_checked

Embed = Callable[[Column], Column]


def finish(hits: DataFrame, k: int, threshold: float) -> DataFrame:
    """Count candidates per query, apply the threshold, keep the first k."""
    total = F.count(F.lit(1)).over(Window.partitionBy("query_id"))   # at most the search horizon per query
    kept = hits.withColumn("total_candidates", total).where(F.col("score") >= threshold)
    return rank_hits(kept.drop("rank"), k)


def hit_rows(hits: DataFrame, flat: DataFrame) -> DataFrame:
    """Hits with the fields a reader needs.

    The hits are written to the shared folder first: measuring them is then free of
    the search, and where they fit they are broadcast, so the chunk texts stay put.
    """
    fields = with_citations(flat).select("chunk_id", "text", F.col("page_start").alias("page"), "page_start", "page_end",
                                         "section", "urgency", "cancer_types", "citation")
    return join_checked(fields, checkpointed(hits), "chunk_id")


def retrieve(queries: DataFrame, chunks: DataFrame, embed: Embed, k: int = fixed.DEFAULT_TOP_K, expand: bool = True,
             threshold: float = fixed.SIMILARITY_THRESHOLD, names: Names = Names()) -> DataFrame:
    """``queries``: ``query_id, query``.  Expand, embed, search 2k, threshold, first k."""
    text = query_text.expand_query(F.col("query")) if expand else F.col("query")
    vectors = queries.select("query_id", embed(text).alias("embedding"))
    hits = top_k(vectors, chunks, 2 * k, names=names)
    return finish(hits, k, threshold)


def retrieve_hybrid(queries: DataFrame, chunks: DataFrame, index: KeywordIndex, embed: Embed, k: int = fixed.DEFAULT_TOP_K,
                    expand: bool = True, threshold: float = fixed.SIMILARITY_THRESHOLD, names: Names = Names()) -> DataFrame:
    """Vector and keyword hits of the same text, 2k of each, fused by their ranks; the threshold holds for vector hits.

    Returns ``query_id, rank, chunk_id, score, total_candidates, semantic_rank, keyword_rank``.
    """
    text = query_text.expand_query(F.col("query")) if expand else F.col("query")
    asked = checkpointed(queries.select("query_id", text.alias("query")))
    near = top_k(asked.select("query_id", embed(F.col("query")).alias("embedding")), chunks, 2 * k, min_score=threshold, names=names)
    return fuse({"semantic": near, "keyword": keyword_search(asked, index, 2 * k)}, k)


def retrieve_for_patients(requests: DataFrame, chunks: DataFrame, embed: Embed, k: int = fixed.DEFAULT_TOP_K,
                          threshold: float = fixed.SIMILARITY_THRESHOLD, mode: str = "pre", overfetch: int = 3,
                          names: Names = Names()) -> DataFrame:
    """``requests``: ``query_id, query, age, symptoms, cancer, urgent_only``.

    Urgent requests see urgent chunks, else requests with a cancer type see chunks
    tagged with it, else all.  ``pre`` filters before the search (exact); ``post``
    searches ``overfetch`` times as far and filters the hits by cancer type.
    """
    text = query_text.patient_query(F.col("query"), F.col("age"), F.col("symptoms"), F.col("cancer"))
    vectors = requests.select("query_id", embed(text).alias("embedding"),
                              F.coalesce("urgent_only", F.lit(False)).alias("urgent_only"), "cancer")
    if mode == "pre":
        return finish(top_k(vectors, chunks, 2 * k, names=names, routed=True), k, threshold)
    wide = vectors.withColumn("_cancer", F.when(~F.col("urgent_only"), F.col("cancer"))).drop("cancer").withColumn(
        "cancer", F.lit(None).cast("string"))
    hits = top_k(wide, chunks, 2 * k * overfetch, names=names, routed=True, carry=["cancer_types"])
    horizon = join_checked(hits, wide.select("query_id", "_cancer"), "query_id")
    seen = F.col("_cancer").isNull() | F.contains(F.lower("cancer_types"), F.lower("_cancer"))
    cut = rank_hits(horizon.where(seen).drop("rank"), 2 * k).drop("_cancer", "cancer_types")
    return finish(cut, k, threshold)


def request_contexts(requests: DataFrame) -> DataFrame:
    """What was searched for each patient request: enhanced query and the filters it named."""
    text = query_text.patient_query(F.col("query"), F.col("age"), F.col("symptoms"), F.col("cancer"))

    def entry(name: str, given: Column, value: Column) -> Column:
        return F.when(given, F.struct(F.lit(name).alias("key"), value.cast("string").alias("value")))

    applied = F.map_from_entries(F.array_compact(F.array(
        entry("age", F.col("age") != 0, F.col("age")),
        entry("symptoms", F.size("symptoms") > 0, F.array_join("symptoms", ", ")),
        entry("cancer_type", F.col("cancer") != "", F.col("cancer")),
        entry("urgent_only", F.col("urgent_only"), F.lit("true")))))
    return requests.select("query_id", "query", text.alias("expanded_query"), applied.alias("filters_applied"))


def dispatch(requests: DataFrame, chunks: DataFrame, embed: Embed, k: int = fixed.DEFAULT_TOP_K,
             threshold: float = fixed.SIMILARITY_THRESHOLD, names: Names = Names()) -> DataFrame:
    """Search requests (``query_id, query, cancer, urgent_only``): with a filter the query
    gets patient context, without one it is expanded.  One pass serves both kinds."""
    filtered = F.coalesce("urgent_only", F.lit(False)) | F.col("cancer").isNotNull()
    none = F.lit(None)
    cancer = F.when(~F.coalesce("urgent_only", F.lit(False)), F.col("cancer"))
    text = F.when(filtered, query_text.patient_query(
        F.col("query"), none.cast("int"), F.array().cast("array<string>"), cancer)
    ).otherwise(query_text.expand_query(F.col("query")))
    vectors = requests.select("query_id", embed(text).alias("embedding"),
                              F.coalesce("urgent_only", F.lit(False)).alias("urgent_only"), "cancer")
    return finish(top_k(vectors, chunks, 2 * k, names=names, routed=True), k, threshold)


def cancer_criteria(cancers: DataFrame, chunks: DataFrame, flat: DataFrame, embed: Embed,
                    k: int = 5, threshold: float = fixed.SIMILARITY_THRESHOLD) -> DataFrame:
    """Criteria text per cancer type (``cancer_type``): top five chunks, or a fixed sentence."""
    queries = cancers.select(F.col("cancer_type").alias("query_id"),
                             F.concat("cancer_type", F.lit(" cancer referral criteria symptoms")).alias("query"))
    hits = hit_rows(retrieve(queries, chunks, embed, k, threshold=threshold), flat)
    parts = F.array_sort(F.collect_list(F.struct("rank", "text")))   # at most k per query
    found = hits.groupBy(F.col("query_id").alias("cancer_type")).agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("criteria"))
    fallback = F.concat(F.lit("No specific criteria found for "), F.col("cancer_type"))
    return (cancers.select("cancer_type").distinct().join(found, "cancer_type", "left")
            .select("cancer_type", F.coalesce("criteria", fallback).alias("criteria")))


def without_evidence(patients: DataFrame, hits: DataFrame, key: str = "query_id",
                     reason: str = "No matching guidelines found") -> DataFrame:
    """Result rows for patients that no hit was found for."""
    none = patients.select(key).join(hits.select(key).distinct(), key, "left_anti")
    return none.select(key, F.lit("insufficient_info").alias("risk_level"), F.lit("routine").alias("urgency"),
                       F.lit(f"Unable to complete assessment: {reason}").alias("summary"),
                       F.array(F.lit("Gather additional clinical information")).alias("recommended_actions"),
                       F.lit(reason).alias("reasoning"), F.lit(0.0).alias("confidence"))
