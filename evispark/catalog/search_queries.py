"""Vectors, similarity search and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import query_text
from ..functions import vectors as V
from ..functions.predicates import clinical_filter, compile_filter
from ..operators import embedding, keywords, retrieval
from ..operators import search as S
from ..operators.sizes import spread
from . import query
from .derived import PATIENTS_SQL, nth, patients, sql_nth, table, texts
from .text_queries import FLAT_SQL, flat_notes

DIM = 32
TAGS = ["lung_cancer", "breast_cancer", "lung_cancer,skin_cancer", "", "Bladder_cancer"]


def vectors(spark, sf):
    """Embeddings as queries and as chunks with metadata."""
    e = table(spark, sf, "embeddings")
    v, label = F.col("vec_id"), F.col("label")
    q = e.select(v.alias("query_id"), "embedding", (v % 3 == 0).alias("urgent_only"),
                 F.when(v % 3 == 1, F.lit("Lung")).alias("cancer"))
    c = e.select(v.alias("chunk_id"), "embedding", "label", (label % 2 == 0).alias("is_urgent"),
                 nth(TAGS, label + v).alias("cancer_types"))
    return q, c


VECTORS_SQL = f"""q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e, vec_id % 3 = 0 AS urgent_only,
  CASE WHEN vec_id % 3 = 1 THEN 'Lung' END AS cancer FROM embeddings),
c AS (SELECT vec_id AS chunk_id, CAST(embedding AS DOUBLE[]) AS e, label, label % 2 = 0 AS is_urgent, {sql_nth(TAGS, "label + vec_id")} AS cancer_types FROM embeddings)"""
SCORE = "round(list_cosine_similarity(q.e, c.e), 6)"


def ranked_sql(name: str, source: str, k: int) -> str:
    return (f"{name} AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank "
            f"FROM ({source})) WHERE rank <= {k})")


TOPK_SQL = (f"WITH {VECTORS_SQL}, " + ranked_sql("r", f"SELECT query_id, chunk_id, {SCORE} AS score FROM q, c", 5)
            + " SELECT query_id, rank, chunk_id, score FROM r")


@query("topk_cosine", TOPK_SQL)
def topk_cosine(spark, sf):
    """Every vector against all vectors, exact."""
    return S.top_k(*vectors(spark, sf), k=5)


@query("topk_cosine_grid", TOPK_SQL)
def topk_cosine_grid(spark, sf):
    """The same by pruned cells and bounded blocks, as used beyond the broadcast size."""
    return S.top_k_grid(*vectors(spark, sf), k=5, pivots=32)


@query("topk_filtered", f"WITH {VECTORS_SQL}, " + ranked_sql(
    "r", f"SELECT query_id, chunk_id, {SCORE} AS score FROM q, c WHERE label >= 2 AND (label <= 6 OR label = 9) AND is_urgent = false", 5)
    + " SELECT query_id, rank, chunk_id, score FROM r")
def topk_filtered(spark, sf):
    q, c = vectors(spark, sf)
    where = {"$and": [{"label": {"$gte": 2}}, {"$or": [{"label": {"$lte": 6}}, {"label": {"$eq": 9}}]}], "is_urgent": False}
    return S.top_k(q, c, 5, where=compile_filter(where, c.columns))


@query("topk_clinical_filter", f"WITH {VECTORS_SQL}, " + ranked_sql(
    "r", f"SELECT query_id, chunk_id, {SCORE} AS score FROM q, c WHERE is_urgent AND contains(cancer_types, 'lung')", 5)
    + " SELECT query_id, rank, chunk_id, score FROM r")
def topk_clinical_filter(spark, sf):
    q, c = vectors(spark, sf)
    return S.top_k(q, c, 5, where=compile_filter(clinical_filter(cancer_type="lung", is_urgent=True), c.columns))


@query("topk_overfetch", f"WITH {VECTORS_SQL}, " + ranked_sql("wide", f"SELECT query_id, chunk_id, cancer_types, {SCORE} AS score FROM q, c", 15) + ", "
       + ranked_sql("r", "SELECT query_id, chunk_id, cancer_types, score FROM wide WHERE contains(lower(cancer_types), 'bladder')", 5)
       + " SELECT query_id, rank, chunk_id, score, cancer_types FROM r")
def topk_overfetch(spark, sf):
    q, c = vectors(spark, sf)
    return S.filtered_after(q, c, "cancer_types", "bladder", 5)


FIELDS = ["symptoms", "investigations"]
FIELD_TAGS = {"symptoms": ["cough", "weight_loss,cough", "", "Back_Pain"], "investigations": ["ct", "x_ray,ct", "", "Ultrasound", "fit"]}
WANTED = {"symptoms": "back_pain", "investigations": "ultrasound"}


@query("topk_overfetch_fields", f"WITH {VECTORS_SQL}, c2 AS (SELECT c.*, {sql_nth(FIELD_TAGS['symptoms'], 'label * 3 + chunk_id')} AS symptoms, "
       f"{sql_nth(FIELD_TAGS['investigations'], 'label + chunk_id * 2')} AS investigations FROM c), "
       + ranked_sql("wide", f"SELECT query_id, chunk_id, symptoms, investigations, {SCORE.replace('c.e', 'c2.e')} AS score FROM q, c2", 15) + ", "
       + ", ".join(ranked_sql(f"r_{f}", f"SELECT query_id, chunk_id, score FROM wide WHERE contains(lower({f}), '{WANTED[f]}')", 5) for f in FIELDS)
       + " " + " UNION ALL ".join(f"SELECT '{f}' AS field, query_id, rank, chunk_id, score FROM r_{f}" for f in FIELDS))
def topk_overfetch_fields(spark, sf):
    """Over-fetch and filter by a symptom and by an investigation."""
    q, c = vectors(spark, sf)
    c = c.withColumns({"symptoms": nth(FIELD_TAGS["symptoms"], F.col("label") * 3 + F.col("chunk_id")),
                       "investigations": nth(FIELD_TAGS["investigations"], F.col("label") + F.col("chunk_id") * 2)})
    one, two = (S.filtered_after(q, c, f, WANTED[f], 5).select(F.lit(f).alias("field"), "query_id", "rank", "chunk_id", "score") for f in FIELDS)
    return one.union(two)


@query("topk_min_score", f"WITH {VECTORS_SQL}, " + ranked_sql("r", f"SELECT query_id, chunk_id, {SCORE} AS score FROM q, c", 5)
       + " SELECT query_id, rank, chunk_id, score FROM r WHERE score >= 0.3")
def topk_min_score(spark, sf):
    return S.top_k(*vectors(spark, sf), k=5, min_score=0.3)


ROUTED = """CASE WHEN q.urgent_only THEN c.is_urgent WHEN q.cancer IS NOT NULL THEN contains(lower(c.cancer_types), lower(q.cancer)) ELSE true END"""


@query("topk_routed", f"WITH {VECTORS_SQL}, " + ranked_sql("r", f"SELECT query_id, chunk_id, {SCORE} AS score FROM q, c WHERE {ROUTED}", 5)
       + " SELECT query_id, rank, chunk_id, score FROM r")
def topk_routed(spark, sf):
    """Each query searches its own part of the chunks: urgent, of a cancer type, or all."""
    return S.top_k(*vectors(spark, sf), k=5, routed=True)


#: Of the approximate search and of the check of its recall.
ANN = {"bands": 26, "bits": 5}


@query("ann_bucketed")
def ann_bucketed(spark, sf):
    """Approximate neighbours by shared hyperplane signatures."""
    return S.approximate_top_k(*vectors(spark, sf), k=5, **ANN)


@query("vector_norms", """SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm,
  round(CASE WHEN n.vec IS NULL THEN 0 ELSE list_cosine_similarity(CAST(embedding AS DOUBLE[]), n.vec) END, 6) AS next_cosine, CAST(1 AS DOUBLE) AS unit_norm
FROM embeddings LEFT JOIN (SELECT vec_id - 1 AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings) n ON n.id = vec_id""")
def vector_norms(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", V.norm(F.col("embedding")).alias("n"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("v2"), F.col("n").alias("n2"))
    cos = V.cosine(F.col("embedding"), F.col("v2"), F.col("n"), F.col("n2"))
    scaled = F.transform("embedding", lambda x: x.cast("double") * 3)
    return e.join(nxt, "vec_id", "left").select(
        "vec_id", F.round("n", 6).alias("norm"), F.round(F.coalesce(cos, F.lit(0.0)), 6).alias("next_cosine"),
        F.round(V.norm(V.normalise(scaled)), 6).alias("unit_norm"))


def sql_vector(text: str, dim: int) -> str:
    raw = (f"list_transform(range(1, {dim + 1}), lambda i: CAST('0x' || left(md5(md5({text}) || '#' || i), 8) AS BIGINT) / 2147483647.5 - 1.0)")
    return f"(SELECT list_transform(w.v, lambda x: x / sqrt(list_sum(list_transform(w.v, lambda y: y * y)))) FROM (SELECT {raw} AS v) w)"


@query("text_vectors", f"""WITH v AS (SELECT doc_id, {sql_vector('text', 16)} AS v FROM documents)
SELECT doc_id, CAST(i AS INTEGER) AS i, round(v[i], 6) AS value FROM (SELECT doc_id, v, unnest(range(1, 17)) AS i FROM v)""")
def text_vectors(spark, sf):
    v = texts(spark, sf, "documents").select("doc_id", V.text_vector(F.col("text"), 16).alias("v"))
    return v.select("doc_id", F.posexplode_outer("v").alias("i", "value")).select(
        "doc_id", (F.col("i") + 1).alias("i"), F.round("value", 6).alias("value"))


@query("embed_provider", """SELECT doc_id, CAST(length(text) AS DOUBLE) AS chars, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS spaces,
  '' AS error FROM documents""")
def embed_provider(spark, sf):
    """Vectors from a user's provider, called per token-limited batch."""
    def provider(batch: list[str], mode: str) -> list[list[float]]:
        return [[float(len(t)), float(t.count(" "))] for t in batch]

    out = embedding.attach(texts(spark, sf, "documents").select("doc_id", "text"), "text", provider)
    return out.select("doc_id", F.get("embedding", F.lit(0)).alias("chars"), F.get("embedding", F.lit(1)).alias("spaces"),
                      F.coalesce("embedding_error", F.lit("")).alias("error"))


def embed(text):
    return V.text_vector(text, DIM)


def embedded_notes(spark, sf):
    return flat_notes(spark, sf).withColumn("embedding", embed(F.col("text")))


def search_chunks(spark, sf):
    """Chunk side of text search: only what the search reads."""
    return embedded_notes(spark, sf).select("chunk_id", "embedding", "is_urgent", "cancer_types")


def sql_expand(text: str) -> str:
    from .. import fixed
    from .derived import quoted
    parts = ", ".join(f"CASE WHEN contains(lower({text}), {quoted(t)}) AND NOT contains(lower({text}), {quoted(s)}) THEN {quoted(s)} END"
                      for t, ss in fixed.SYMPTOM_SYNONYMS.items() for s in ss)
    return f"rtrim({text} || ' ' || array_to_string(list_slice(list_filter([{parts}], lambda x: x IS NOT NULL), 1, 3), ' '))"


def sql_patient_query(q: str, age: str, symptoms: str, cancer: str) -> str:
    from .. import fixed
    words = " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in fixed.CANCER_KEYWORDS.items())
    return (f"concat_ws(' ', {q}, CASE WHEN {age} >= 40 THEN 'aged 40 and over' END, "
            f"CASE WHEN len({symptoms}) > 0 THEN array_to_string(list_slice({symptoms}, 1, 3), ' ') END, CASE lower({cancer}) {words} END)")


BENCH_TEXT = f"text || ' ' || {sql_nth(['cough and weight loss', 'a lump', 'pain', 'nothing'], 'item_id')}"


def bench_queries(spark, sf):
    text = F.concat("text", F.lit(" "), nth(["cough and weight loss", "a lump", "pain", "nothing"], F.col("item_id")))
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), text.alias("query"))


CHUNK_VECTORS_SQL = f"{FLAT_SQL}, c AS (SELECT chunk_id, text, cancer_types, is_urgent, {sql_vector('text', DIM)} AS e FROM flat)"
RETRIEVE_CTE = (f"{CHUNK_VECTORS_SQL}, q AS (SELECT query_id, {sql_vector(sql_expand('query'), DIM)} AS e FROM "
                f"(SELECT item_id AS query_id, {BENCH_TEXT} AS query FROM benchmark)), "
                + ranked_sql("wide", f"SELECT query_id, chunk_id, {SCORE} AS score FROM q, c", 10)
                + ", hits AS (SELECT query_id, chunk_id, score, rank, CAST(10 AS BIGINT) AS total_candidates FROM wide WHERE rank <= 5 AND score >= 0.2)")


def retrieved(spark, sf):
    return retrieval.retrieve(bench_queries(spark, sf), search_chunks(spark, sf), embed, 5, threshold=0.2)


@query("retrieve_texts", f"WITH {RETRIEVE_CTE} SELECT query_id, rank, chunk_id, score, total_candidates FROM hits")
def retrieve_texts(spark, sf):
    """Expanded questions against embedded notes: search 2k, threshold, first k."""
    return retrieved(spark, sf).select("query_id", "rank", "chunk_id", "score", "total_candidates")


_TERMS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
KEYWORD_CTE = f"""ct AS (SELECT chunk_id, {_TERMS.format("coalesce(text, '')")} AS w FROM flat),
size AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM ct),
tf AS (SELECT term, chunk_id, len(w) AS length, count(*) AS tf FROM (SELECT chunk_id, w, unnest(w) AS term FROM ct) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
imp AS (SELECT term, chunk_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) AS impact FROM tf JOIN df USING (term), size),
qt AS (SELECT DISTINCT query_id, unnest({_TERMS.format("query")}) AS term FROM asked),
""" + ranked_sql("kw", "SELECT query_id, chunk_id, round(sum(impact), 6) AS score FROM qt JOIN imp USING (term) GROUP BY ALL", 10)
ASKED_CTE = f"asked AS (SELECT query_id, {sql_expand('query')} AS query FROM (SELECT item_id AS query_id, {BENCH_TEXT} AS query FROM benchmark))"


def keyword_index(spark, sf):
    return keywords.build_index(flat_notes(spark, sf).select("chunk_id", "text"))


@query("keyword_search", f"WITH {FLAT_SQL}, {ASKED_CTE}, {KEYWORD_CTE} SELECT query_id, rank, chunk_id, score FROM kw")
def keyword_search(spark, sf):
    """BM25 over all chunks for every expanded question."""
    asked = bench_queries(spark, sf).select("query_id", query_text.expand_query(F.col("query")).alias("query"))
    return keywords.keyword_search(asked, keyword_index(spark, sf), 10)


@query("retrieve_hybrid", f"WITH {RETRIEVE_CTE}, {ASKED_CTE}, {KEYWORD_CTE}, sem AS (SELECT * FROM wide WHERE score >= 0.2), "
       + ranked_sql("fused", """SELECT query_id, chunk_id, round(coalesce(1 / (60 + s.rank), 0) + coalesce(1 / (60 + k.rank), 0), 9) AS score,
         count(*) OVER (PARTITION BY query_id) AS total_candidates, s.rank AS semantic_rank, k.rank AS keyword_rank
         FROM (SELECT query_id, chunk_id, rank FROM sem) s FULL JOIN (SELECT query_id, chunk_id, rank FROM kw) k USING (query_id, chunk_id)""", 5)
       + " SELECT query_id, rank, chunk_id, score, total_candidates, semantic_rank, keyword_rank FROM fused")
def retrieve_hybrid(spark, sf):
    """Vector and keyword hits of the expanded questions, fused by rank."""
    return retrieval.retrieve_hybrid(bench_queries(spark, sf), search_chunks(spark, sf), keyword_index(spark, sf), embed, 5, threshold=0.2)


PATIENT_QUERY_CTE = (f"{CHUNK_VECTORS_SQL}, {PATIENTS_SQL}, q AS (SELECT patient_id AS query_id, patient_id % 5 = 0 AS urgent_only, cancer, "
                     f"{sql_vector(sql_patient_query('presenting_complaint', 'age', 'symptoms', 'cancer'), DIM)} AS e FROM patients)")


def patient_requests(spark, sf):
    return spread(patients(spark, sf)).select(F.col("patient_id").alias("query_id"), F.col("presenting_complaint").alias("query"), "age",
                                      "symptoms", "cancer", (F.col("patient_id") % 5 == 0).alias("urgent_only"))


@query("retrieve_for_patients", f"WITH {PATIENT_QUERY_CTE}, " + ranked_sql("wide", f"SELECT query_id, chunk_id, {SCORE} AS score FROM q, c WHERE {ROUTED}", 6)
       + ", t AS (SELECT query_id, count(*) AS total_candidates FROM wide GROUP BY query_id) "
       "SELECT query_id, rank, chunk_id, score, total_candidates FROM wide JOIN t USING (query_id) WHERE rank <= 3 AND score >= 0.1")
def retrieve_for_patients(spark, sf):
    """Patient requests, each filtered before the search."""
    return retrieval.retrieve_for_patients(patient_requests(spark, sf), search_chunks(spark, sf), embed, 3, threshold=0.1).select(
        "query_id", "rank", "chunk_id", "score", "total_candidates")


ROUTED_URGENT = "CASE WHEN q.urgent_only THEN c.is_urgent ELSE true END"


@query("retrieve_for_patients_overfetch", f"WITH {PATIENT_QUERY_CTE}, "
       + ranked_sql("wide", f"SELECT query_id, urgent_only, cancer, chunk_id, cancer_types, {SCORE} AS score FROM q, c WHERE {ROUTED_URGENT}", 18) + ", "
       + ranked_sql("cut", "SELECT query_id, chunk_id, score FROM wide WHERE urgent_only OR contains(lower(cancer_types), lower(cancer))", 6)
       + ", t AS (SELECT query_id, count(*) AS total_candidates FROM cut GROUP BY query_id) "
       "SELECT query_id, rank, chunk_id, score, total_candidates FROM cut JOIN t USING (query_id) WHERE rank <= 3 AND score >= 0.1")
def retrieve_for_patients_overfetch(spark, sf):
    """The same with the cancer filter after an over-fetched search."""
    return retrieval.retrieve_for_patients(patient_requests(spark, sf), search_chunks(spark, sf), embed, 3, threshold=0.1, mode="post").select(
        "query_id", "rank", "chunk_id", "score", "total_candidates")


@query("search_dispatch", f"""WITH {CHUNK_VECTORS_SQL}, q0 AS (SELECT item_id AS query_id, {BENCH_TEXT} AS query, item_id % 4 = 0 AS urgent_only,
    CASE WHEN item_id % 4 IN (0, 1) THEN 'lung' END AS cancer FROM benchmark),
q AS (SELECT query_id, urgent_only, cancer, {sql_vector("CASE WHEN urgent_only THEN query WHEN cancer IS NOT NULL THEN query || ' lung cancer' ELSE "
      + sql_expand('query') + " END", DIM)} AS e FROM q0), """
       + ranked_sql("wide", f"SELECT query_id, chunk_id, {SCORE} AS score FROM q, c WHERE {ROUTED}", 5)
       + " SELECT query_id, rank, chunk_id, score FROM wide WHERE score >= 0.1")
def search_dispatch(spark, sf):
    i = F.col("query_id")
    requests = bench_queries(spark, sf).withColumns({"urgent_only": i % 4 == 0, "cancer": F.when(i % 4 <= 1, F.lit("lung"))})
    return retrieval.dispatch(requests, search_chunks(spark, sf), embed, 5, threshold=0.1).select("query_id", "rank", "chunk_id", "score")


@query("expand_query", f"""SELECT item_id, md5({sql_expand(BENCH_TEXT)}) AS expanded_md5 FROM benchmark""")
def expand_query(spark, sf):
    return bench_queries(spark, sf).select(F.col("query_id").alias("item_id"), F.md5(query_text.expand_query(F.col("query"))).alias("expanded_md5"))
