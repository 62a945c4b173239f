"""Chunking, chunk reports, token batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..operators import chunking as K
from ..operators import embedding
from . import query
from .derived import GUIDELINE_SQL, NOTES_SQL, guideline, notes, quoted
from .text_queries import PAGES_SQL, flat_notes, guideline_pages, FLAT_SQL

SIZE = K.ChunkSize(chunk=128, overlap=25, minimum=25)
GAP = "chr(10) || chr(10)"
WS = "' ' || chr(9) || chr(10) || chr(13)"
IS_ROW = "(starts_with(trim({x}), '|') AND ends_with(trim({x}), '|'))"


def pack_sql(pages: str, ordinal: str, number: str, section: str, markdown: str) -> str:
    """CTEs that group and pack the pages of the named CTE, ending in ``packed``."""
    row, prev = IS_ROW.format(x="x"), IS_ROW.format(x="lines[i - 1]")
    limit = SIZE.max_chars * 0.8
    overlap = (f"CASE WHEN length(p.cur) <= {SIZE.overlap_chars} THEN p.cur ELSE "
               f"trim(regexp_replace(right(p.cur, {SIZE.overlap_chars}), '^[^.!?]*[.!?]\\s+', ''), {WS}) END")
    return f"""
src AS (SELECT doc_id, {ordinal} AS ord, {number} AS page, {section} AS sec, {markdown} AS md FROM {pages}),
split_lines AS (SELECT *, string_split(md, chr(10)) AS lines FROM src),
guarded AS (SELECT doc_id, ord, page, sec, array_to_string(list_transform(lines, lambda x, i: CASE WHEN i > 1 AND
    (({row} AND NOT {prev} AND trim(lines[i - 1]) <> '') OR (NOT {row} AND {prev})) THEN chr(10) || x ELSE x END), chr(10)) AS md FROM split_lines),
raw AS (SELECT doc_id, ord, page, sec, list_filter(list_transform(string_split_regex(md, '\\n\\n+'), lambda x: trim(x, {WS})), lambda x: x <> '') AS ps FROM guarded),
grp AS (SELECT doc_id, ord, page, sec, ps, 1 AS i, '' AS open_, CAST([] AS VARCHAR[]) AS groups FROM raw
  UNION ALL
  SELECT doc_id, ord, page, sec, ps, i + 1, CASE WHEN length(grown) > {limit} THEN '' ELSE grown END,
    CASE WHEN length(grown) > {limit} THEN list_append(closed, grown) ELSE closed END
  FROM (SELECT *, CASE WHEN opens OR open_ = '' THEN ps[i] ELSE open_ || {GAP} || ps[i] END AS grown,
      CASE WHEN opens AND open_ <> '' THEN list_append(groups, open_) ELSE groups END AS closed
    FROM (SELECT *, regexp_matches(ps[i], '^#{{1,4}}\\s+(\\d+(?:\\.\\d+)*)\\s+(.+)')
        OR regexp_matches(ps[i], {quoted('(?mi)' + fixed.PARAGRAPH_RECOMMENDATION)}) AS opens FROM grp WHERE i <= len(ps)))),
whole AS (SELECT doc_id, ord, page, sec, CASE WHEN open_ <> '' THEN list_append(groups, open_) ELSE groups END AS groups
  FROM grp WHERE i = len(ps) + 1),
entries AS (SELECT doc_id, ord, 0 AS j, page, sec, CAST(NULL AS VARCHAR) AS text FROM whole
  UNION ALL SELECT doc_id, ord, j, page, CAST(NULL AS VARCHAR), text FROM (SELECT doc_id, ord, page, unnest(groups) AS text, generate_subscripts(groups, 1) AS j FROM whole)),
elems AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord, j) AS n FROM entries),
pack AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS n, '' AS cur, CAST([] AS INTEGER[]) AS pages, CAST(NULL AS VARCHAR) AS sec,
    CAST(NULL AS VARCHAR) AS e_text, CAST([] AS INTEGER[]) AS e_pages, CAST(NULL AS VARCHAR) AS e_sec FROM elems
  UNION ALL
  SELECT doc_id, n, CASE WHEN text IS NULL THEN cur WHEN over_ THEN CASE WHEN ov <> '' THEN ov || {GAP} || text ELSE text END
      WHEN cur <> '' THEN cur || {GAP} || text ELSE text END,
    CASE WHEN text IS NULL THEN pages WHEN over_ THEN [page] WHEN list_contains(pages, page) THEN pages ELSE list_append(pages, page) END,
    sec, CASE WHEN over_ THEN cur END, pages, sec
  FROM (SELECT e.doc_id, e.n, e.page, e.text, p.cur, p.pages, coalesce(e.sec, p.sec) AS sec,
      e.text IS NOT NULL AND p.cur <> '' AND length(p.cur) + length(e.text) > {SIZE.max_chars} AS over_, {overlap} AS ov
    FROM pack p JOIN elems e ON e.doc_id = p.doc_id AND e.n = p.n + 1)),
ends AS (SELECT doc_id, max(n) AS n FROM pack GROUP BY doc_id),
cut_chunks AS (SELECT doc_id, n, e_text AS text, e_pages AS pages, e_sec AS section FROM pack WHERE e_text IS NOT NULL
  UNION ALL SELECT p.doc_id, p.n + 1, cur, pages, sec FROM pack p JOIN ends USING (doc_id, n) WHERE length(cur) >= {SIZE.min_chars}),
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INTEGER) AS chunk_index FROM cut_chunks),
packed0 AS (SELECT doc_id, chunk_index, text, coalesce(section, '') AS section, list_min(pages) AS page_start, list_max(pages) AS page_end,
  'ng12_' || doc_id || '_p' || pages[1] || '_' || lpad(CAST(chunk_index AS VARCHAR), 4, '0') || '_'
    || left(md5(left(text, 100) || '_' || pages[1] || '_' || chunk_index || '_' || doc_id), 8) AS chunk_id FROM numbered),
packed AS (SELECT *, coalesce(lag(chunk_id) OVER w, '') AS prev_chunk_id, coalesce(lead(chunk_id) OVER w, '') AS next_chunk_id
  FROM packed0 WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index))"""


OUT = "doc_id, chunk_index, chunk_id, md5(text) AS text_md5, page_start, page_end, section, prev_chunk_id, next_chunk_id"
USED_PAGES = """used AS (SELECT * FROM pages_sections WHERE content_type = 'content'
  OR doc_id NOT IN (SELECT doc_id FROM pages_sections WHERE content_type = 'content'))"""


def _shown(chunks):
    return chunks.select("doc_id", "chunk_index", "chunk_id", F.md5("text").alias("text_md5"), "page_start", "page_end",
                         *[F.coalesce(c, F.lit("")).alias(c) for c in ("section", "prev_chunk_id", "next_chunk_id")])


@query("chunk_pack", f"WITH RECURSIVE {PAGES_SQL}, {USED_PAGES}, "
       + pack_sql("used", "page_ordinal", "page_number", "sections[1]", "markdown") + f" SELECT {OUT} FROM packed")
def chunk_pack(spark, sf):
    """Pages of every document packed into linked, overlapping chunks, inside the document's row."""
    return _shown(K.chunk_documents(guideline(spark, sf), "markdown", size=SIZE))


@query("chunk_pack_in_parts", f"WITH RECURSIVE {PAGES_SQL}, {USED_PAGES}, "
       + pack_sql("used", "page_ordinal", "page_number", "sections[1]", "markdown") + f" SELECT {OUT} FROM packed")
def chunk_pack_in_parts(spark, sf):
    """The same from page rows, with documents cut into parts of eight pages, as very long ones are."""
    return _shown(K.chunk_pages(guideline_pages(spark, sf), size=SIZE, order="page_ordinal", pages_per_part=8))


TEXT_CHUNKS = f"{GUIDELINE_SQL}, " + pack_sql("guideline", "0", "0", "'1.2.3 Whole text'", "markdown")


def text_chunks(spark, sf):
    return K.chunk_texts(guideline(spark, sf), text="markdown", size=SIZE, section=F.lit("1.2.3 Whole text"))


@query("chunk_texts", f"WITH RECURSIVE {TEXT_CHUNKS} SELECT {OUT} FROM packed")
def chunk_texts(spark, sf):
    return _shown(text_chunks(spark, sf))


@query("chunk_stats", f"""WITH RECURSIVE {TEXT_CHUNKS}, s AS (SELECT greatest(1, length(text) // 4) AS t, length(text) AS c FROM packed)
SELECT count(*) AS chunks, CAST(sum(t) AS BIGINT) AS total_tokens, CAST(min(t) AS INTEGER) AS min_tokens, CAST(max(t) AS INTEGER) AS max_tokens,
  CAST(min(c) AS INTEGER) AS min_chars, CAST(max(c) AS INTEGER) AS max_chars, CAST(sum(t) // count(*) AS BIGINT) AS avg_tokens,
  count(*) FILTER (c > {SIZE.max_chars} * 1.1) AS over_limit FROM s""")
def chunk_stats(spark, sf):
    sized = text_chunks(spark, sf).withColumns({
        "char_count": F.length("text"), "token_count": F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("int")})
    return K.chunk_statistics(sized, SIZE.chunk)


@query("chunk_overlap_check", f"""WITH RECURSIVE {TEXT_CHUNKS},
w AS (SELECT a.doc_id, a.chunk_index, a.chunk_id,
  list_filter(string_split_regex(lower(right(a.text, 400)), '\\s+'), lambda x: x <> '') AS e,
  list_filter(string_split_regex(lower(left(b.text, 400)), '\\s+'), lambda x: x <> '') AS s
  FROM packed a JOIN packed b ON a.doc_id = b.doc_id AND b.chunk_index = a.chunk_index + 1)
SELECT doc_id, chunk_index, chunk_id, CAST(len(list_distinct(list_intersect(e, s))) AS INTEGER) AS shared_words,
  len(list_distinct(list_intersect(e, s))) > 5 AS overlaps FROM w""")
def chunk_overlap_check(spark, sf):
    return K.overlap_check(text_chunks(spark, sf))


@query("chain_check", f"""WITH RECURSIVE {TEXT_CHUNKS} SELECT count(*) AS chunks, count(*) FILTER (prev_chunk_id <> '') AS with_prev,
  count(*) FILTER (next_chunk_id <> '') AS with_next, CAST(0 AS BIGINT) AS breaks FROM packed""")
def chain_check(spark, sf):
    return K.chain_report(text_chunks(spark, sf))


@query("chain_check_broken", f"""WITH RECURSIVE {TEXT_CHUNKS} SELECT count(*) AS chunks, count(*) FILTER (prev_chunk_id <> '' OR chunk_index % 7 = 3) AS with_prev,
  count(*) FILTER (next_chunk_id <> '') AS with_next, count(*) FILTER (chunk_index % 7 = 3) AS breaks FROM packed""")
def chain_check_broken(spark, sf):
    """Every seventh link back is wrong."""
    wrong = F.when(F.col("chunk_index") % 7 == 3, F.lit("elsewhere")).otherwise(F.col("prev_chunk_id"))
    return K.chain_report(text_chunks(spark, sf).withColumn("prev_chunk_id", wrong))


@query("chunk_value_shares", f"""WITH {FLAT_SQL}, u AS (SELECT 'content_type' AS field, content_type AS value FROM flat
  UNION ALL SELECT 'urgency', urgency FROM flat), c AS (SELECT field, value, count(*) AS n FROM u GROUP BY field, value)
SELECT field, value, n, CAST(n * 100 // sum(n) OVER (PARTITION BY field) AS BIGINT) AS pct FROM c""")
def chunk_value_shares(spark, sf):
    return K.value_shares(flat_notes(spark, sf), "content_type", "urgency")


@query("chunk_top_terms", f"""WITH {FLAT_SQL}, t AS (SELECT unnest(string_split(symptoms, ',')) AS term FROM flat WHERE symptoms <> '')
SELECT term, count(*) AS n FROM t GROUP BY term ORDER BY n DESC, term LIMIT 10""")
def chunk_top_terms(spark, sf):
    return K.top_terms(K.enrich(notes(spark, sf)), "symptoms")


@query("token_batches", f"""WITH RECURSIVE {NOTES_SQL}, t AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, doc_id,
  CAST(length(text) // 4 AS BIGINT) AS tokens FROM notes),
f AS (SELECT source, doc_id, n, tokens, tokens AS total, 0::BIGINT AS batch FROM t WHERE n = 1
  UNION ALL SELECT t.source, t.doc_id, t.n, t.tokens, CASE WHEN f.total + t.tokens > 3000 THEN t.tokens ELSE f.total + t.tokens END,
    CASE WHEN f.total + t.tokens > 3000 THEN f.batch + 1 ELSE f.batch END FROM f JOIN t ON t.source = f.source AND t.n = f.n + 1)
SELECT source, doc_id, batch, tokens FROM f""")
def token_batches(spark, sf):
    """Batches per source, packed straight on in order; folded in parts of 128 positions."""
    return embedding.token_batches(notes(spark, sf), "source", "doc_id", limit=3000, span=128)
