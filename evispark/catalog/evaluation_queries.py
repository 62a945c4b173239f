"""Graded truth, ranking metrics, gates, reports, groundedness."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..operators import chunking, traces
from ..operators import evaluation as E
from ..session import checkpointed
from . import query
from .derived import notes, nth, sql_nth, table
from .lookup_queries import HITS_CTE, shown_hits
from .search_queries import RETRIEVE_CTE, retrieved

Q_CANCERS = ["lung_cancer", "colorectal_cancer", "breast_cancer", "bladder_cancer"]
Q_SYMPTOMS = ["haemoptysis", "weight_loss", "fatigue", "rectal_bleeding", "persistent", "cough", "back_pain"]
Q_URGENCIES = ["urgent_2_week", "", "consider", "routine", "unknown"]


def queries(spark, sf):
    i = F.col("item_id")
    return table(spark, sf, "benchmark").select(
        i.alias("query_id"), F.array(nth(Q_CANCERS, i)).alias("cancers"),
        F.array(nth(Q_SYMPTOMS, i), nth(Q_SYMPTOMS, i * 3 + 1), nth(Q_SYMPTOMS, i + 4)).alias("symptoms"),
        F.nullif(nth(Q_URGENCIES, i), F.lit("")).alias("urgency"))


def tags(spark, sf):
    """The tags of all chunks, written once: narrow, and read by several steps."""
    return checkpointed(chunking.enrich(notes(spark, sf)).select("chunk_id", "cancer_types", "symptoms", "urgency"))


def qrels(spark, sf):
    return E.build_qrels(queries(spark, sf), chunking.enrich(notes(spark, sf)))


QRELS_CTE = f"""{RETRIEVE_CTE}, eq AS (SELECT item_id AS query_id, [{sql_nth(Q_CANCERS, "item_id")}] AS qc,
  list_distinct([{sql_nth(Q_SYMPTOMS, "item_id")}, {sql_nth(Q_SYMPTOMS, "item_id * 3 + 1")}, {sql_nth(Q_SYMPTOMS, "item_id + 4")}]) AS qs, {sql_nth(Q_URGENCIES, "item_id")} AS qu FROM benchmark),
pairs AS (SELECT query_id, chunk_id, len(list_intersect(qc, string_split(cancer_types, ','))) AS nc, len(list_intersect(qs, string_split(symptoms, ','))) AS ns, qu, urgency FROM eq, flat),
qrels AS (SELECT * FROM (SELECT query_id, chunk_id, CAST(greatest(0, CASE WHEN nc > 0 AND ns >= 2 THEN 3 WHEN nc > 0 THEN 2 WHEN ns > 0 THEN 1 ELSE 0 END
  - CASE WHEN qu <> '' AND urgency <> '' AND qu <> urgency THEN 1 ELSE 0 END) AS INTEGER) AS grade FROM pairs) WHERE grade > 0)"""


@query("qrels_graded", f"WITH {QRELS_CTE} SELECT query_id, chunk_id, grade FROM qrels")
def qrels_graded(spark, sf):
    return qrels(spark, sf)


METRICS_CTE = f"""{QRELS_CTE}, j AS (SELECT h.query_id, h.rank, q.grade, q.grade IS NOT NULL AS hit,
  count(q.grade) OVER (PARTITION BY h.query_id ORDER BY h.rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hits FROM hits h LEFT JOIN qrels q USING (query_id, chunk_id)),
found AS (SELECT query_id, count(*) FILTER (rank <= 3) AS num_retrieved, count(*) FILTER (hit AND rank <= 3) AS nrr, sum(CASE WHEN hit AND rank <= 3 THEN grade / log2(rank + 1) ELSE 0 END) AS dcg,
  sum(CASE WHEN hit AND rank <= 3 THEN hits / rank ELSE 0 END) AS ap, min(CASE WHEN hit THEN rank END) AS first_rank FROM j GROUP BY query_id),
rel AS (SELECT query_id, count(*) AS num_relevant FROM qrels GROUP BY query_id),
ideal AS (SELECT query_id, sum(grade / log2(r + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, chunk_id) AS r FROM qrels) WHERE r <= 3 GROUP BY query_id),
m AS (SELECT query_id, coalesce(num_retrieved, 0) AS num_retrieved, coalesce(num_relevant, 0) AS num_relevant, coalesce(nrr, 0) AS num_relevant_retrieved,
  CASE WHEN num_relevant > 0 THEN coalesce(nrr, 0) / num_relevant ELSE 0.0 END AS recall, coalesce(nrr, 0) / 3.0 AS precision, coalesce(1.0 / first_rank, 0.0) AS mrr,
  CASE WHEN idcg > 0 THEN coalesce(dcg, 0) / idcg ELSE 0.0 END AS ndcg, CASE WHEN num_relevant > 0 THEN coalesce(ap, 0) / num_relevant ELSE 0.0 END AS average_precision,
  CAST(CASE WHEN nrr > 0 THEN 1 ELSE 0 END AS DOUBLE) AS hit_rate FROM eq LEFT JOIN found USING (query_id) LEFT JOIN rel USING (query_id) LEFT JOIN ideal USING (query_id))"""


def per_query(spark, sf):
    run = checkpointed(retrieved(spark, sf).select("query_id", "rank", "chunk_id"))
    asked, tagged = queries(spark, sf), tags(spark, sf)
    return E.graded_metrics(E.grade_run(run, asked, tagged), E.grade_counts(asked, tagged), asked, 3)


@query("eval_per_query", f"""WITH {METRICS_CTE} SELECT query_id, num_retrieved, num_relevant, num_relevant_retrieved, {", ".join(f"round({c}, 6) AS {c}" for c in E.METRICS)} FROM m""")
def eval_per_query(spark, sf):
    return per_query(spark, sf).select("query_id", "num_retrieved", "num_relevant", "num_relevant_retrieved",
                                       *[F.round(c, 6).alias(c) for c in E.METRICS])


@query("eval_gate", f"""WITH {METRICS_CTE}, a AS (SELECT avg(recall) AS recall, avg(precision) AS precision, avg(mrr) AS mrr, avg(ndcg) AS ndcg, avg(average_precision) AS map, avg(hit_rate) AS hit_rate, count(*) AS num_queries FROM m)
SELECT round(recall, 6) AS recall, round(precision, 6) AS precision, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg, round(map, 6) AS map, round(hit_rate, 6) AS hit_rate, num_queries,
  recall >= 0.6 AS recall_ok, hit_rate >= 0.8 AS hit_rate_ok, mrr >= 0.4 AS mrr_ok, ndcg >= 0.5 AS ndcg_ok, recall >= 0.6 AND hit_rate >= 0.8 AND mrr >= 0.4 AND ndcg >= 0.5 AS all_passed FROM a""")
def eval_gate(spark, sf):
    out = E.quality_gates(E.mean_metrics(per_query(spark, sf)))
    return out.select(*[F.round(c, 6).alias(c) for c in ("recall", "precision", "mrr", "ndcg", "map", "hit_rate")], "num_queries",
                      *[f"{g}_ok" for g in fixed.QUALITY_GATES], "all_passed")


@query("eval_missed", f"WITH {QRELS_CTE} SELECT query_id, chunk_id, grade FROM qrels ANTI JOIN (SELECT query_id, chunk_id FROM hits WHERE rank <= 3) USING (query_id, chunk_id)")
def eval_missed(spark, sf):
    return E.missed_chunks(checkpointed(retrieved(spark, sf)), qrels(spark, sf), 3)


@query("compare_runs", f"""WITH {QRELS_CTE}, b AS (SELECT query_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, chunk_id) AS r FROM qrels) WHERE r <= 2),
x AS (SELECT query_id, count(*) AS n FROM hits JOIN qrels USING (query_id, chunk_id) WHERE rank <= 3 GROUP BY query_id), y AS (SELECT query_id, count(*) AS n FROM b GROUP BY query_id),
z AS (SELECT query_id FROM hits WHERE rank <= 3 UNION SELECT query_id FROM b)
SELECT query_id, coalesce(x.n, 0) AS first_hits, coalesce(y.n, 0) AS second_hits, CASE WHEN coalesce(y.n, 0) > coalesce(x.n, 0) THEN 'second' ELSE 'first' END AS better
FROM z LEFT JOIN x USING (query_id) LEFT JOIN y USING (query_id)""")
def compare_runs(spark, sf):
    """The search run against a run that returns the two best graded chunks."""
    asked, tagged = queries(spark, sf), tags(spark, sf)
    run = retrieved(spark, sf).select("query_id", "rank", "chunk_id").where("rank <= 3")
    return E.compare_graded(*(E.grade_run(checkpointed(r), asked, tagged) for r in (run, E.best_chunks(asked, tagged, 2))), 3)


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]::VARCHAR[]"


_DEFAULT_VALUES = ", ".join(f"({i}, {_sql_list(r[1])}, {_sql_list(r[2])}, '{r[3] or ''}')" for i, r in enumerate(fixed.EVALUATION_QUERIES))


@query("eval_default_queries", f"""WITH {HITS_CTE}, dq(query_id, qc, qs, qu) AS (VALUES {_DEFAULT_VALUES}),
p AS (SELECT query_id, len(list_intersect(qc, string_split(cancer_types, ','))) AS nc, len(list_intersect(qs, string_split(symptoms, ','))) AS ns, qu, urgency FROM dq, flat),
g AS (SELECT query_id, greatest(0, CASE WHEN nc > 0 AND ns >= 2 THEN 3 WHEN nc > 0 THEN 2 WHEN ns > 0 THEN 1 ELSE 0 END - CASE WHEN qu <> '' AND urgency <> '' AND qu <> urgency THEN 1 ELSE 0 END) AS grade FROM p)
SELECT query_id, CAST(grade AS INTEGER) AS grade, count(*) AS n FROM g WHERE grade > 0 GROUP BY query_id, grade""")
def eval_default_queries(spark, sf):
    """How many chunks are relevant to each of the default evaluation queries, by grade."""
    return E.grade_counts(E.default_queries(spark), tags(spark, sf))


@query("groundedness", f"""WITH {HITS_CTE}, ans AS (SELECT query_id, string_agg(citation, ' and ' ORDER BY rank) || CASE WHEN query_id % 3 = 0 THEN ' [NG12 Section 99.9, p.1]' ELSE '' END AS answer FROM shown GROUP BY query_id),
cit AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(answer, '\\[NG12[^\\]]+\\]')) AS citation FROM ans),
s AS (SELECT query_id, max(score) AS best_score, count(*) FILTER (score >= 0.45) AS supporting FROM shown GROUP BY query_id),
u AS (SELECT query_id, count(*) AS cited, count(*) FILTER (NOT EXISTS (SELECT 1 FROM shown h WHERE h.query_id = cit.query_id AND h.citation = cit.citation)) AS unsupported FROM cit GROUP BY query_id)
SELECT query_id, best_score, supporting, cited, unsupported, supporting >= 1 AND unsupported = 0 AS grounded FROM ans JOIN s USING (query_id) JOIN u USING (query_id)""")
def groundedness(spark, sf):
    hits = checkpointed(shown_hits(spark, sf).select("query_id", "rank", "score", "citation"))
    parts = F.array_sort(F.collect_list(F.struct("rank", "citation")))   # at most k per query
    cited = hits.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda p: p["citation"]), " and ").alias("answer"))
    answers = cited.withColumn("answer", F.concat("answer", F.when(F.col("query_id") % 3 == 0, F.lit(" [NG12 Section 99.9, p.1]")).otherwise(F.lit(""))))
    return traces.groundedness(answers, hits, threshold=0.45)
