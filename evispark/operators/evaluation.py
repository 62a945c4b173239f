"""Retrieval quality: graded truth from tags, ranking metrics, gates, reports.

``run`` is ``(query_id, rank, chunk_id)``; ``qrels`` is ``(query_id, chunk_id, grade)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..session import checkpointed
from .sizes import fits, join_checked

SALT_ROWS = 100_000   # chunks of one tag that one salt holds


def relevance_grade(cancer_hits: Column, symptom_hits: Column, query_urgency: Column, chunk_urgency: Column) -> Column:
    base = (F.when((cancer_hits > 0) & (symptom_hits >= 2), 3).when(cancer_hits > 0, 2)
            .when(symptom_hits > 0, 1).otherwise(0))
    differs = ((F.coalesce(query_urgency, F.lit("")) != "") & (F.coalesce(chunk_urgency, F.lit("")) != "")
               & (query_urgency != chunk_urgency))
    return F.greatest(F.lit(0), base - F.coalesce(differs, F.lit(False)).cast("int"))


def build_qrels(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Grade every (query, chunk) pair that shares a tag; other pairs are grade 0 anyway.

    ``queries``: ``query_id, cancers, symptoms, urgency``; ``chunks``: ``chunk_id,
    cancer_types, symptoms, urgency`` (tags as arrays).  An equi-join on the tag
    replaces the all-pairs comparison.  Where the query tags cannot be broadcast, tags
    are salted by chunk, in as many parts as the tag has chunks for.
    """
    def tags(cancers: str, symptoms: str) -> Column:
        def kind(col: str, name: str) -> Column:
            return F.transform(F.array_distinct(col), lambda t: F.struct(F.lit(name).alias("kind"), t.alias("tag")))
        return F.explode(F.concat(kind(cancers, "c"), kind(symptoms, "s")))

    q = queries.select("query_id", F.coalesce("urgency", F.lit("")).alias("qu"), tags("cancers", "symptoms").alias("t"))
    c = chunks.select("chunk_id", F.coalesce("urgency", F.lit("")).alias("cu"), tags("cancer_types", "symptoms").alias("t"))
    if fits(q):
        pairs = c.join(F.broadcast(q), "t")
    else:
        share = checkpointed(c.groupBy("t").agg(F.ceil(F.count(F.lit(1)) / F.lit(SALT_ROWS)).cast("int").alias("_n")))
        side = F.broadcast(share) if fits(share) else share
        salted = q.join(side, "t").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
        pairs = c.join(side, "t").withColumn("_salt", F.pmod(F.xxhash64("chunk_id"), F.col("_n")).cast("int")).join(salted, ["t", "_salt"])
    counted = pairs.groupBy("query_id", "chunk_id").agg(
        F.sum((F.col("t.kind") == "c").cast("int")).alias("nc"), F.sum((F.col("t.kind") == "s").cast("int")).alias("ns"),
        F.max("qu").alias("qu"), F.max("cu").alias("cu"))
    grade = relevance_grade(F.col("nc"), F.col("ns"), F.col("qu"), F.col("cu"))
    return counted.select("query_id", "chunk_id", grade.alias("grade")).where("grade > 0")


def default_queries(spark) -> DataFrame:
    """The default evaluation queries as a table."""
    rows = [(i, *r) for i, r in enumerate(fixed.EVALUATION_QUERIES)]
    return spark.createDataFrame(rows, "query_id int, query string, cancers array<string>, "
                                       "symptoms array<string>, urgency string")


def _tags(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", *(F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>")))).alias(a) for c, a in (
        ("cancer_types", "cc"), ("symptoms", "cs"))), F.coalesce("urgency", F.lit("")).alias("cu"))


def _wanted(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", *(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))).alias(a) for c, a in (
        ("cancers", "qc"), ("symptoms", "qs"))), F.coalesce("urgency", F.lit("")).alias("qu"))


def grade_run(run: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Run rows with their grade (null if not relevant), from the tags of the chunks in the run: no other pair is looked at."""
    met = join_checked(_tags(chunks), run.select("chunk_id").distinct(), "chunk_id", "left_semi")
    rows = run.join(met, "chunk_id", "left").join(_wanted(queries), "query_id", "left")
    grade = relevance_grade(F.size(F.array_intersect("qc", "cc")), F.size(F.array_intersect("qs", "cs")), F.col("qu"), F.col("cu"))
    return rows.select(*run.columns, F.when(grade > 0, grade).alias("grade"))


def _signatures(chunks: DataFrame) -> DataFrame:
    """Chunks of the same tags and urgency are graded alike: one row for all of them."""
    return _tags(chunks).groupBy("cc", "cs", "cu").agg(F.count(F.lit(1)).alias("n")).select(
        F.struct("cc", "cs", "cu").alias("chunk_id"), F.col("cc").alias("cancer_types"), F.col("cs").alias("symptoms"),
        F.col("cu").alias("urgency"), "n")


def grade_counts(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """``query_id, grade, n``: how many chunks have each grade; worked out per tag signature, not per chunk."""
    signatures = checkpointed(_signatures(chunks))
    graded = build_qrels(queries, signatures)
    return graded.join(signatures.select("chunk_id", "n"), "chunk_id").groupBy("query_id", "grade").agg(F.sum("n").alias("n"))


def best_chunks(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, chunk_id``: the k best graded chunks of every query (ties by id), from the k first ids of each signature."""
    tags = _tags(chunks)
    first = Window.partitionBy("cc", "cs", "cu").orderBy("chunk_id")
    few = tags.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k).select(
        F.struct("cc", "cs", "cu").alias("signature"), F.col("chunk_id").alias("id"))
    graded = build_qrels(queries, _signatures(chunks)).withColumnRenamed("chunk_id", "signature")
    best = Window.partitionBy("query_id").orderBy(F.desc("grade"), "id")
    return graded.join(few, "signature").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias("chunk_id"))


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Run rows with their grade (null if not relevant); only judged pairs of the run are kept."""
    pairs = run.select("query_id", "chunk_id").distinct()
    used = join_checked(qrels, pairs, ["query_id", "chunk_id"], "left_semi")
    return run.join(used, ["query_id", "chunk_id"], "left")


def per_query_metrics(run: DataFrame, qrels: DataFrame, k: int = 5, graded: bool = True,
                      queries: DataFrame | None = None) -> DataFrame:
    """Metrics by a given table of graded pairs."""
    counts = qrels.groupBy("query_id", "grade").agg(F.count(F.lit(1)).alias("n"))
    if queries is None:
        queries = run.select("query_id").union(qrels.select("query_id")).distinct()
    return graded_metrics(judged(run, qrels), counts, queries, k, graded)


def graded_metrics(first: DataFrame, counts: DataFrame, queries: DataFrame, k: int = 5, graded: bool = True) -> DataFrame:
    """One row of metrics per query, including queries with no hit or no relevant chunk.

    ``first``: the run with ``grade`` (``judged`` or ``grade_run``); ``counts``: relevant chunks per query and grade.  The ideal
    order follows from the counts.
    """
    gain = (lambda c: F.col(c).cast("double")) if graded else (lambda c: F.lit(1.0))
    discount = lambda r: F.log2(F.col(r) + F.lit(1.0))
    hit = F.col("grade").isNotNull()
    by_rank = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    top = F.col("rank") <= k
    # A run holds few ranks per query; one running count serves the first k, and the reciprocal rank needs the whole list.
    found = first.withColumn("_hits", F.sum(hit.cast("int")).over(by_rank)).groupBy("query_id").agg(
        F.count(F.when(top, 1)).alias("num_retrieved"), F.sum((hit & top).cast("int")).alias("num_relevant_retrieved"),
        F.sum(F.when(hit & top, gain("grade") / discount("rank")).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(hit & top, F.col("_hits") / F.col("rank")).otherwise(0.0)).alias("ap"),
        F.min(F.when(hit, F.col("rank"))).alias("first_rank"))
    of = counts.groupBy("query_id").agg(F.sum("n").alias("num_relevant"), *(
        F.sum(F.when(F.col("grade") >= g, F.col("n")).otherwise(0)).alias(f"_n{g}") for g in (1, 2, 3)))
    ideal = F.lit(0.0)
    for r in range(1, k + 1):
        best = (F.when(F.col("_n3") >= r, 3.0).when(F.col("_n2") >= r, 2.0) if graded else F.when(F.lit(False), 0.0)).when(
            F.col("_n1") >= r, 1.0).otherwise(0.0)
        ideal = ideal + best / F.log2(F.lit(r + 1.0))
    out = queries.select("query_id").join(found, "query_id", "left").join(
        of.select("query_id", "num_relevant", ideal.alias("idcg")), "query_id", "left")
    out = out.fillna(0, ["num_retrieved", "num_relevant_retrieved", "num_relevant", "dcg", "ap", "idcg"])
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return out.select(
        "query_id", F.lit(k).alias("k"), "num_retrieved", "num_relevant", "num_relevant_retrieved",
        share("num_relevant_retrieved", "num_relevant").alias("recall"),
        (F.col("num_relevant_retrieved") / F.lit(float(k)) if k else F.lit(0.0)).alias("precision"),
        F.coalesce(F.lit(1.0) / F.col("first_rank"), F.lit(0.0)).alias("mrr"),
        share("dcg", "idcg").alias("ndcg"), share("ap", "num_relevant").alias("average_precision"),
        F.when(F.col("num_relevant_retrieved") > 0, 1.0).otherwise(0.0).alias("hit_rate"))


METRICS = ["recall", "precision", "mrr", "ndcg", "average_precision", "hit_rate"]


def mean_metrics(per_query: DataFrame) -> DataFrame:
    """Unweighted means over queries; of no queries, nulls."""
    return per_query.agg(*[F.avg(m).alias("map" if m == "average_precision" else m) for m in METRICS],
                         F.max("k").alias("k"), F.count(F.lit(1)).alias("num_queries"))


def quality_gates(mean: DataFrame, gates: dict[str, float] | None = None) -> DataFrame:
    gates = gates or fixed.QUALITY_GATES
    checks = {f"{m}_ok": F.col(m) >= floor for m, floor in gates.items()}
    out = mean.withColumns(checks)
    passed = F.lit(True)
    for name in checks:
        passed = passed & F.col(name)
    return out.withColumn("all_passed", passed)


def missed_chunks(run: DataFrame, qrels: DataFrame, k: int = 5) -> DataFrame:
    """Relevant chunks that are not among the first k, one row each."""
    top = run.where(F.col("rank") <= k).select("query_id", "chunk_id")
    return join_checked(qrels, top, ["query_id", "chunk_id"], "left_anti")


def compare_runs(first: DataFrame, second: DataFrame, qrels: DataFrame, k: int = 5) -> DataFrame:
    """The comparison by a given table of graded pairs."""
    return compare_graded(*(judged(run.where(F.col("rank") <= k).select("query_id", "rank", "chunk_id"), qrels) for run in (first, second)), k)


def compare_graded(first: DataFrame, second: DataFrame, k: int = 5) -> DataFrame:
    """Per query: relevant hits of two graded runs and which has more (ties go to the first).

    A report only; it looks at the labels, so it must not choose the run that is scored.
    """
    def hits(run: DataFrame, name: str) -> DataFrame:
        return run.where(F.col("rank") <= k).groupBy("query_id").agg(F.count("grade").alias(name))
    out = hits(first, "first_hits").join(hits(second, "second_hits"), "query_id", "full").fillna(
        0, ["first_hits", "second_hits"])
    return out.withColumn("better", F.when(F.col("second_hits") > F.col("first_hits"), "second").otherwise("first"))
