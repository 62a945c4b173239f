"""Lookups over the flat chunk table, citations, contexts, exports, collections."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions import display
from ..functions.predicates import clinical_filter, compile_filter
from ..operators import lookups as L
from ..operators import retrieval
from ..sources import chunk_files, page_files
from ..sources import patients as patient_files
from . import query
from .derived import PATIENTS_SQL, notes, patients, quoted, table, texts
from .search_queries import CHUNK_VECTORS_SQL, RETRIEVE_CTE, SCORE, embed, ranked_sql, retrieved, search_chunks, sql_expand, sql_vector
from .text_queries import FLAT_SQL, PAGES_SQL, flat_notes, guideline_pages

NL = "chr(10)"
CITATION_SQL = """'[NG12 ' || CASE WHEN section_hierarchy <> '' THEN 'Section ' || string_split(section_hierarchy, '|')[-1] || ', '
  WHEN section <> '' THEN string_split(section, ' ')[1] || ', ' ELSE '' END || CASE WHEN page_start = page_end THEN 'p.' || page_start
  ELSE 'pp.' || page_start || '-' || page_end END || ']'"""


def wanted_pages(spark, sf):
    return table(spark, sf, "benchmark").select((F.col("item_id") % 45).cast("int").alias("page")).distinct()


@query("page_lookup", f"""WITH {FLAT_SQL}, w AS (SELECT DISTINCT CAST(item_id % 45 AS INTEGER) AS page FROM benchmark)
SELECT w.page, chunk_id, CAST(1 AS DOUBLE) AS score FROM flat JOIN w ON w.page BETWEEN page_start AND page_end""")
def page_lookup(spark, sf):
    return L.on_pages(flat_notes(spark, sf), wanted_pages(spark, sf)).select("page", "chunk_id", "score")


@query("section_lookup", f"""WITH {FLAT_SQL} SELECT chunk_id, section_hierarchy, starts_with(section_hierarchy, '2|2.2') AS by_prefix,
  contains('|' || section_hierarchy || '|', '|2.2|') AS by_element FROM flat WHERE starts_with(section_hierarchy, '2|2.2')""")
def section_lookup(spark, sf):
    return L.in_section(flat_notes(spark, sf), "2|2.2", exact=False).select(
        "chunk_id", "section_hierarchy", F.lit(True).alias("by_prefix"), L.section_hit("2.2").alias("by_element"))


WANTED_SECTIONS = """wanted AS (SELECT DISTINCT (o_orderkey % 5) || '.' || (o_custkey % 7) AS section_number FROM orders)"""


def wanted_sections(spark, sf):
    return table(spark, sf, "orders").select(F.concat((F.col("o_orderkey") % 5).cast("string"), F.lit("."),
                                                      (F.col("o_custkey") % 7).cast("string")).alias("section_number")).distinct()


SECTION_HITS = f"""{FLAT_SQL}, {WANTED_SECTIONS},
lev AS (SELECT doc_id, chunk_index, chunk_id, text, unnest(string_split(section_hierarchy, '|')) AS section_number FROM flat),
sec AS (SELECT * FROM (SELECT l.*, CAST(row_number() OVER (PARTITION BY section_number ORDER BY doc_id, chunk_index, chunk_id) AS INTEGER) AS rank
  FROM lev l SEMI JOIN wanted USING (section_number)) WHERE rank <= 10)"""


@query("section_retrieval", f"WITH {SECTION_HITS} SELECT section_number, rank, chunk_id, CAST(1 AS DOUBLE) AS score FROM sec")
def section_retrieval(spark, sf):
    return L.sections_of(flat_notes(spark, sf), wanted_sections(spark, sf)).select("section_number", "rank", "chunk_id", "score")


@query("section_text", f"""WITH {SECTION_HITS}, j AS (SELECT section_number, string_agg(text, {NL} || {NL} ORDER BY rank) AS content, count(*) AS n
  FROM sec GROUP BY section_number)
SELECT section_number, coalesce(md5(content), '') AS content_md5, coalesce(n, 0) AS chunks_count,
  CASE WHEN content IS NULL THEN 'Section ' || section_number || ' not found' ELSE '' END AS error FROM wanted LEFT JOIN j USING (section_number)""")
def section_text(spark, sf):
    return L.section_texts(flat_notes(spark, sf), wanted_sections(spark, sf)).select(
        "section_number", F.coalesce(F.md5("content"), F.lit("")).alias("content_md5"), "chunks_count",
        F.coalesce("error", F.lit("")).alias("error"))


@query("chunk_by_id", f"""WITH {FLAT_SQL}, w AS (SELECT DISTINCT 'c' || (o_custkey * 2) AS chunk_id FROM orders)
SELECT w.chunk_id, flat.chunk_id IS NOT NULL AS found, coalesce(page_start, -1) AS page_start, coalesce(section, '') AS section
FROM w LEFT JOIN flat USING (chunk_id)""")
def chunk_by_id(spark, sf):
    wanted = table(spark, sf, "orders").select(F.concat(F.lit("c"), (F.col("o_custkey") * 2).cast("string")).alias("chunk_id"))
    return L.by_id(flat_notes(spark, sf), wanted).select(
        "chunk_id", F.col("page_start").isNotNull().alias("found"), F.coalesce("page_start", F.lit(-1)).alias("page_start"),
        F.coalesce("section", F.lit("")).alias("section"))


@query("neighbour_context", f"""WITH {FLAT_SQL} SELECT a.chunk_id, coalesce(p.chunk_id, '') AS prev_id, coalesce(md5(p.text), '') AS prev_md5,
  coalesce(md5(n.text), '') AS next_md5 FROM flat a LEFT JOIN flat p ON p.chunk_id = a.prev_chunk_id LEFT JOIN flat n ON n.chunk_id = a.next_chunk_id
WHERE a.is_urgent""")
def neighbour_context(spark, sf):
    flat = flat_notes(spark, sf)
    hits = flat.where("is_urgent").select("chunk_id", "prev_chunk_id", "next_chunk_id")
    out = L.with_neighbours(hits, notes(spark, sf))
    return out.select("chunk_id", F.when(F.col("prev_text").isNotNull(), F.col("prev_chunk_id")).otherwise(F.lit("")).alias("prev_id"),
                      F.coalesce(F.md5("prev_text"), F.lit("")).alias("prev_md5"), F.coalesce(F.md5("next_text"), F.lit("")).alias("next_md5"))


@query("collection_stats", f"""WITH {FLAT_SQL} SELECT 'guidelines' AS collection_name, count(*) AS total_chunks, count(*) FILTER (is_urgent) AS urgent_chunks,
  count(*) FILTER (has_recommendation) AS recommendation_chunks, count(*) FILTER (has_table) AS table_chunks,
  (SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT DISTINCT unnest(string_split(cancer_types, ',')) AS t FROM flat WHERE cancer_types <> '')) AS cancer_types,
  (SELECT string_agg(u, ',' ORDER BY u) FROM (SELECT DISTINCT urgency AS u FROM flat WHERE urgency <> '')) AS urgency_levels FROM flat""")
def collection_stats(spark, sf):
    return L.statistics(flat_notes(spark, sf), values=True).withColumns({c: F.array_join(c, ",") for c in ("cancer_types", "urgency_levels")})


@query("cancer_type_facet", f"""WITH {FLAT_SQL} SELECT cancer_type, count(*) AS chunks FROM (SELECT unnest(string_split(cancer_types, ',')) AS cancer_type
  FROM flat WHERE cancer_types <> '') GROUP BY cancer_type""")
def cancer_type_facet(spark, sf):
    return L.cancer_type_facet(flat_notes(spark, sf))


@query("urgency_facet", f"""WITH {FLAT_SQL} SELECT urgency, count(*) AS chunks, CASE urgency
  {" ".join(f"WHEN '{k}' THEN {quoted(v)}" for k, v in fixed.URGENCY_DESCRIPTIONS.items())} END AS description FROM flat GROUP BY urgency""")
def urgency_facet(spark, sf):
    return L.urgency_facet(flat_notes(spark, sf))


def sql_labels(col: str, labels: dict[str, str]) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {quoted(v)}" for k, v in labels.items()) + f" ELSE {col} END"


@query("citations", f"""WITH {FLAT_SQL} SELECT chunk_id, {CITATION_SQL} AS citation,
  CASE WHEN section <> '' THEN '[NG12 Section ' || section || ', p.' || page_start || ']' ELSE '[NG12 p.' || page_start || ']' END AS chunk_citation,
  {sql_labels('urgency', fixed.HIT_URGENCY_LABELS)} AS hit_label, {sql_labels('urgency', fixed.ASSESSMENT_URGENCY_LABELS)} AS assessment_label,
  {sql_labels('urgency', fixed.AGENT_URGENCY_LABELS)} AS agent_label FROM flat""")
def citations(spark, sf):
    u = F.col("urgency")
    return L.with_citations(flat_notes(spark, sf)).select(
        "chunk_id", "citation", display.chunk_citation(F.col("page_start"), F.col("section")).alias("chunk_citation"),
        display.urgency_label(u).alias("hit_label"), display.urgency_label(u, fixed.ASSESSMENT_URGENCY_LABELS).alias("assessment_label"),
        display.urgency_label(u, fixed.AGENT_URGENCY_LABELS).alias("agent_label"))


HITS_CTE = f"""{RETRIEVE_CTE}, shown AS (SELECT h.*, f.text, f.page_start, {CITATION_SQL} AS citation FROM hits h JOIN flat f USING (chunk_id))"""


def shown_hits(spark, sf):
    return retrieval.hit_rows(retrieved(spark, sf), flat_notes(spark, sf))


@query("context_blocks", f"""WITH {HITS_CTE} SELECT query_id,
  md5(string_agg('[' || citation || ']' || {NL} || text, {NL} || {NL} || '---' || {NL} || {NL} ORDER BY rank)) AS context_md5,
  string_agg(citation, ';' ORDER BY rank) AS citations FROM shown GROUP BY query_id""")
def context_blocks(spark, sf):
    return L.context_texts(shown_hits(spark, sf)).select("query_id", F.md5("context").alias("context_md5"),
                                                         F.array_join("citations", ";").alias("citations"))


@query("context_passages", f"""WITH {HITS_CTE} SELECT query_id,
  md5(string_agg('[Passage ' || rank || '] (' || citation || '):' || {NL} || text, {NL} || {NL} ORDER BY rank)) AS context_md5 FROM shown GROUP BY query_id""")
def context_passages(spark, sf):
    return L.context_texts(shown_hits(spark, sf), form="passages").select("query_id", F.md5("context").alias("context_md5"))


@query("snippets", f"""WITH {HITS_CTE} SELECT query_id, rank, CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END AS text,
  round(score, 3) AS score FROM shown""")
def snippets(spark, sf):
    return L.snippets(shown_hits(spark, sf)).select("query_id", "rank", "text", "score")


@query("cancer_criteria", f"""WITH {CHUNK_VECTORS_SQL}, names AS (SELECT DISTINCT c_mktsegment AS cancer_type FROM customer),
q AS (SELECT cancer_type AS query_id, {sql_vector(sql_expand("cancer_type || ' cancer referral criteria symptoms'"), 32)} AS e FROM names), """
       + ranked_sql("wide", f"SELECT query_id, chunk_id, text, {SCORE} AS score FROM q, c", 5)
       + f""", j AS (SELECT query_id, string_agg(text, {NL} ORDER BY rank) AS criteria FROM wide WHERE score >= 0.45 GROUP BY query_id)
SELECT cancer_type, md5(coalesce(criteria, 'No specific criteria found for ' || cancer_type)) AS criteria_md5 FROM names LEFT JOIN j ON query_id = cancer_type""")
def cancer_criteria(spark, sf):
    names = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("cancer_type")).distinct()
    out = retrieval.cancer_criteria(names, search_chunks(spark, sf), flat_notes(spark, sf), embed, threshold=0.45)
    return out.select("cancer_type", F.md5("criteria").alias("criteria_md5"))


@query("no_evidence", f"""WITH {RETRIEVE_CTE} SELECT query_id, 'insufficient_info' AS risk_level, 'routine' AS urgency,
  'Unable to complete assessment: No matching guidelines found' AS summary, CAST(0 AS DOUBLE) AS confidence
FROM (SELECT item_id AS query_id FROM benchmark) WHERE query_id NOT IN (SELECT query_id FROM hits WHERE score >= 0.55)""")
def no_evidence(spark, sf):
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"))
    strong = retrieved(spark, sf).where("score >= 0.55")
    return retrieval.without_evidence(asked, strong).select("query_id", "risk_level", "urgency", "summary", "confidence")


BLOCK_SQL = f"""'---' || {NL} || {NL} || '## ' || chunk_id || {NL} || {NL} || '- **Section:** ' || CASE WHEN section <> '' THEN section ELSE 'N/A' END
  || {NL} || '- **Pages:** ' || page_start || '-' || page_end || {NL} || '- **Type:** ' || content_type || {NL} || '- **Tokens:** ' || token_count
  || {NL} || '- **Urgency:** ' || urgency || {NL} || '- **Citation:** ' || {CITATION_SQL}
  || CASE WHEN cancer_types <> '' THEN {NL} || '- **Cancers:** ' || replace(cancer_types, ',', ', ') ELSE '' END
  || CASE WHEN symptoms <> '' THEN {NL} || '- **Symptoms:** ' || replace(symptoms, ',', ', ') ELSE '' END
  || {NL} || {NL} || '```' || {NL} || text || {NL} || '```' || {NL}"""


@query("chunk_markdown", f"""WITH {FLAT_SQL} SELECT chunk_id, md5({BLOCK_SQL}) AS block_md5, replace(cancer_types, ',', ', ') AS cancer_types,
  replace(symptoms, ',', ', ') AS symptoms, urgency, CASE WHEN section <> '' THEN section ELSE 'N/A' END AS section FROM flat""")
def chunk_markdown(spark, sf):
    """Chunks as Markdown blocks, and the metadata read back from them."""
    blocks = flat_notes(spark, sf).select("chunk_id", chunk_files.chunk_block().alias("block"))
    return blocks.select("chunk_id", F.md5("block").alias("block_md5"),
                         *[c.alias(n) for n, c in chunk_files.markdown_fields(F.col("block")).items()])


CONDITIONS = {
    "cancer_type": ({"cancer_type": "lung_cancer"}, "contains(cancer_types, 'lung_cancer')"),
    "urgency": ({"urgency": "urgent_2_week"}, "urgency = 'urgent_2_week'"),
    "is_urgent": ({"is_urgent": True}, "is_urgent"),
    "has_recommendation": ({"has_recommendation": False}, "has_recommendation = false"),
    "symptom": ({"symptom": "cough"}, "contains(symptoms, 'cough')"),
    "has_table": ({"has_table": False}, "has_table = false"),
    "content_type": ({"content_type": "text"}, "content_type = 'text'"),
    "investigation": ({"investigation": "ct"}, "contains(investigations, 'ct')"),
    "all": ({"is_urgent": True, "has_recommendation": True, "symptom": "cough", "has_table": False},
            "is_urgent AND has_recommendation AND contains(symptoms, 'cough') AND has_table = false"),
}


@query("clinical_conditions", f"WITH {FLAT_SQL} " + " UNION ALL ".join(
    f"SELECT '{name}' AS condition, chunk_id FROM flat WHERE {sql}" for name, (_, sql) in CONDITIONS.items()))
def clinical_conditions(spark, sf):
    """Each condition of the combined filter on its own, and several at once."""
    flat = flat_notes(spark, sf)
    met = F.array_compact(F.array(*[F.when(compile_filter(clinical_filter(**wanted), flat.columns), F.lit(name)) for name, (wanted, _) in CONDITIONS.items()]))
    # The outer form keeps the optimizer from pushing "array not empty" below the tags, which would tag the texts again inside a filter.
    return flat.select("chunk_id", met.alias("met")).select(F.explode_outer("met").alias("condition"), "chunk_id").where(F.col("condition").isNotNull())


@query("evaluation_fields", f"WITH {FLAT_SQL} SELECT chunk_id, cancer_types, symptoms, urgency, section FROM flat")
def evaluation_fields(spark, sf):
    return chunk_files.evaluation_fields(flat_notes(spark, sf))


@query("page_markdown", f"""WITH RECURSIVE {PAGES_SQL} SELECT doc_id, CAST(page_ordinal AS INTEGER) AS page_ordinal, md5('# Page ' || page_number || {NL} || {NL} || '**Type:** ' || content_type
  || {NL} || {NL} || CASE WHEN len(sections) > 0 THEN '**Sections:** ' || array_to_string(sections, ', ') || {NL} || {NL} ELSE '' END
  || '**Has Tables:** ' || CASE WHEN has_tables THEN 'True' ELSE 'False' END || {NL} || {NL} || '---' || {NL} || {NL} || markdown) AS block_md5 FROM pages_sections""")
def page_markdown(spark, sf):
    return guideline_pages(spark, sf).select("doc_id", "page_ordinal", F.md5(page_files.page_block()).alias("block_md5"))


@query("latest_rows", """SELECT doc_id, CAST(max(version) AS INTEGER) AS version, arg_max(body, version) AS body FROM (SELECT doc_id % 97 AS doc_id, doc_id // 97 AS version, md5(text) AS body FROM documents)
GROUP BY doc_id""")
def latest_rows(spark, sf):
    """Upsert: the newest row per id wins; copies combine before the shuffle."""
    versions = texts(spark, sf, "documents").select((F.col("doc_id") % 97).alias("doc_id"), F.floor(F.col("doc_id") / 97).cast("int").alias("version"),
                                                    F.md5("text").alias("body"))
    return versions.groupBy("doc_id").agg(F.max_by(F.struct("version", "body"), "version").alias("r")).select("doc_id", "r.*")


@query("patient_list", f"""WITH {PATIENTS_SQL} SELECT CAST(patient_id AS VARCHAR) AS id, name, age, left(array_to_string(symptoms, ', '), 100) AS presenting_complaint
FROM patients WHERE contains(lower(CAST(patient_id AS VARCHAR)), '77') OR contains(lower(name), '#00000012')""")
def patient_list(spark, sf):
    rows = patients(spark, sf).withColumn("patient_id", F.col("patient_id").cast("string"))
    found = patient_files.find_patients(rows, "77").unionByName(patient_files.find_patients(rows, "#00000012")).dropDuplicates(["patient_id"])
    return patient_files.patient_list(found)


@query("file_audit")
def file_audit(spark, sf):
    """Size, type mark and checksum of every table file."""
    out = page_files.audit_files(spark, sf, magic=b"PAR1", glob="*.parquet")
    return out.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", "size_ok", "magic_ok", "sha256", "valid")
