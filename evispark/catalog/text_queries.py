"""Tagging, page structure and embedding text."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions import chunks as C
from ..functions import structure as S
from ..functions import tagging as T
from ..functions import vectors as V
from ..operators import chunking, pages as P
from . import query
from .derived import GUIDELINE_SQL, NOTES_SQL, guideline, notes, nth, quoted, sql_list, sql_nth, table, texts

NL = "chr(10)"


def sql_hits(text: str, terms: list[str]) -> str:
    """Normalised terms contained in a text, distinct, in lexicon order."""
    found = (f"list_transform(list_filter({sql_list(terms)}, lambda t: contains({text}, t)), "
             "lambda t: replace(replace(t, ' ', '_'), '-', '_'))")
    return f"list_filter({found}, lambda x, i: list_position({found}, x) = i)"


def sql_distinct(items: str) -> str:
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


def sql_any(text: str, regexes) -> str:
    return f"regexp_matches({text}, {quoted('|'.join(f'(?:{r})' for r in regexes))})"


def sql_urgency(low: str) -> str:
    cases = " ".join(f"WHEN {sql_any(low, p)} THEN '{k}'" for k, p in fixed.URGENCY_PATTERNS.items())
    return f"CASE {cases} ELSE 'unknown' END"


def sql_content_type(text: str, low: str) -> str:
    phrases = lambda ps: " OR ".join(f"contains({low}, {quoted(p)})" for p in ps)
    return (f"CASE WHEN regexp_matches({text}, {quoted('(?mi)' + fixed.PARAGRAPH_RECOMMENDATION)}) THEN 'recommendation' "
            f"WHEN regexp_matches({text}, {quoted('(?m)' + fixed.CHUNK_TABLE_ROW)}) THEN 'table' "
            f"WHEN {phrases(fixed.CRITERIA_PHRASES)} THEN 'criteria' WHEN {phrases(fixed.BACKGROUND_PHRASES)} THEN 'background' "
            f"WHEN {phrases(fixed.DEFINITION_PHRASES)} THEN 'definition' ELSE 'content' END")


AGES = ("list_transform(list_zip(regexp_extract_all(text, {p}, 1), regexp_extract_all(text, {p}, 2)), lambda z: "
        "CASE WHEN lower(z[2]) IN ('over','above','older','+','and over') THEN z[1] || '+' ELSE '<' || z[1] END)"
        ).format(p=quoted("(?i)" + fixed.AGE_PATTERN))
FRAMES = ("list_transform(list_zip(regexp_extract_all(text, {p}, 1), regexp_extract_all(text, {p}, 2)), lambda z: "
          "z[1] || '_' || lower(z[2]))").format(p=quoted("(?i)" + fixed.TIMEFRAME_PATTERN))
ACTIONS = "list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(text, {quoted(p)}) THEN '{n}' END" for n, p in fixed.ACTION_PATTERNS.items()
) + "], lambda x: x IS NOT NULL)"
SECTION_NUMBER = "regexp_extract(section, '^(\\d+(?:\\.\\d+)*)\\s+(.+)$', 1)"
HIERARCHY = (f"CASE WHEN section = '' THEN CAST([] AS VARCHAR[]) WHEN {SECTION_NUMBER} = '' THEN [section] "
             f"ELSE list_transform(range(1, len(string_split({SECTION_NUMBER}, '.')) + 1), "
             f"lambda i: array_to_string(list_slice(string_split({SECTION_NUMBER}, '.'), 1, i), '.')) END")
DENSITY_TERMS = [*fixed.CANCER_TYPES, *fixed.SYMPTOMS, *fixed.INVESTIGATIONS]
# The flat chunk table of the notes view, as the tagger builds it.
FLAT_SQL = f"""{NOTES_SQL}, lowered AS (SELECT *, lower(text) AS low FROM notes),
flat0 AS (SELECT doc_id, chunk_id, text, page_start, page_end, section, chunk_index, prev_chunk_id, next_chunk_id,
  array_to_string({HIERARCHY}, '|') AS section_hierarchy,
  {sql_content_type('text', 'low')} AS content_type, CAST(greatest(1, length(text) // 4) AS INTEGER) AS token_count, CAST(length(text) AS INTEGER) AS char_count,
  least(1.0, len(list_filter({sql_list(DENSITY_TERMS)}, lambda t: contains(low, t))) / (length(text) / 100.0)) AS semantic_density,
  array_to_string({sql_hits('low', fixed.CANCER_TYPES)}, ',') AS cancer_types,
  array_to_string({sql_hits('low', fixed.SYMPTOMS)}, ',') AS symptoms,
  array_to_string({sql_distinct(AGES)}, ',') AS age_thresholds, array_to_string({sql_distinct(FRAMES)}, ',') AS timeframes,
  {sql_urgency('low')} AS urgency, array_to_string({ACTIONS}, ',') AS actions,
  array_to_string({sql_hits('low', fixed.RISK_FACTORS)}, ',') AS risk_factors,
  array_to_string({sql_hits('low', fixed.INVESTIGATIONS)}, ',') AS investigations FROM lowered),
flat AS (SELECT *, content_type = 'recommendation' AS has_recommendation, content_type = 'table' AS has_table,
  urgency IN ('urgent', 'urgent_2_week') AS is_urgent FROM flat0)"""


def flat_notes(spark, sf):
    """The notes view as a flat, tagged chunk table."""
    return chunking.flatten_tags(chunking.enrich(notes(spark, sf)))


@query("lexicon_tags", f"""WITH {NOTES_SQL}, l AS (SELECT doc_id, lower(text) AS low FROM notes)
SELECT doc_id, array_to_string({sql_hits('low', fixed.CANCER_TYPES)}, ',') AS cancer_types,
  array_to_string({sql_hits('low', fixed.SYMPTOMS)}, ',') AS symptoms,
  array_to_string({sql_hits('low', fixed.RISK_FACTORS)}, ',') AS risk_factors,
  array_to_string({sql_hits('low', fixed.INVESTIGATIONS)}, ',') AS investigations FROM l""")
def lexicon_tags(spark, sf):
    low = notes(spark, sf).select("doc_id", F.lower("text").alias("low"))
    lists = {"cancer_types": fixed.CANCER_TYPES, "symptoms": fixed.SYMPTOMS, "risk_factors": fixed.RISK_FACTORS,
             "investigations": fixed.INVESTIGATIONS}
    return low.select("doc_id", *[F.array_join(T.lexicon_tags("low", v), ",").alias(k) for k, v in lists.items()])


@query("age_timeframe_tags", f"""WITH {NOTES_SQL} SELECT doc_id, array_to_string({sql_distinct(AGES)}, ',') AS ages,
  array_to_string({sql_distinct(FRAMES)}, ',') AS timeframes FROM notes""")
def age_timeframe_tags(spark, sf):
    return notes(spark, sf).select("doc_id", F.array_join(T.age_thresholds(F.col("text")), ",").alias("ages"),
                                   F.array_join(T.timeframes(F.col("text")), ",").alias("timeframes"))


@query("urgency_class", f"""WITH {NOTES_SQL} SELECT doc_id, {sql_urgency('lower(text)')} AS urgency,
  array_to_string({ACTIONS}, ',') AS actions FROM notes""")
def urgency_class(spark, sf):
    low = notes(spark, sf).withColumn("low", F.lower("text"))
    return low.select("doc_id", T.urgency(F.col("low")).alias("urgency"),
                      F.array_join(T.actions(F.col("text")), ",").alias("actions"))


@query("content_class", f"""WITH {NOTES_SQL}, l AS (SELECT *, lower(text) AS low FROM notes)
SELECT doc_id, {sql_content_type('text', 'low')} AS content_type, CAST(greatest(1, length(text) // 4) AS INTEGER) AS tokens,
  CAST(length(text) // 4 AS INTEGER) AS tokens_floor,
  round(least(1.0, len(list_filter({sql_list(DENSITY_TERMS)}, lambda t: contains(low, t))) / (length(text) / 100.0)), 6) AS density
FROM l""")
def content_class(spark, sf):
    low = notes(spark, sf).withColumn("low", F.lower("text"))
    t, lo = F.col("text"), "low"
    return low.select("doc_id", T.content_type(t, lo).alias("content_type"), T.token_estimate(t).alias("tokens"),
                      T.token_floor(t).alias("tokens_floor"), F.round(T.density(t, lo), 6).alias("density"))


@query("flat_chunks", f"""WITH {FLAT_SQL} SELECT chunk_id, section_hierarchy, content_type, token_count, char_count,
  round(semantic_density, 6) AS semantic_density, cancer_types, symptoms, age_thresholds, timeframes, urgency, actions,
  risk_factors, investigations, has_recommendation, has_table, is_urgent FROM flat""")
def flat_chunks(spark, sf):
    return flat_notes(spark, sf).withColumn("semantic_density", F.round("semantic_density", 6)).select(
        "chunk_id", "section_hierarchy", "content_type", "token_count", "char_count", "semantic_density", "cancer_types",
        "symptoms", "age_thresholds", "timeframes", "urgency", "actions", "risk_factors", "investigations",
        "has_recommendation", "has_table", "is_urgent")


@query("parse_tag_field", """WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(lang || ' , ' || upper(source) || ',,' || lang, ','),
  lambda x: lower(trim(x))), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ';') AS tags FROM p""")
def parse_tag_field(spark, sf):
    raw = F.concat("lang", F.lit(" , "), F.upper("source"), F.lit(",,"), "lang")
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.parse_tag_field(raw), ";").alias("tags"))


PREFIX_SQL = """concat_ws(' | ',
  CASE WHEN cancer_types <> '' THEN 'Cancer types: ' || replace(replace(cancer_types, ',', ', '), '_', ' ') END,
  CASE WHEN symptoms <> '' THEN 'Symptoms: ' || replace(replace(symptoms, ',', ', '), '_', ' ') END,
  CASE WHEN urgency <> '' THEN 'Urgency: ' || replace(urgency, '_', ' ') END,
  CASE WHEN actions <> '' THEN 'Actions: ' || replace(actions, ',', ', ') END,
  CASE WHEN investigations <> '' THEN 'Investigations: ' || upper(replace(investigations, ',', ', ')) END,
  CASE WHEN age_thresholds <> '' THEN 'Age criteria: ' || age_thresholds END)"""


@query("embedding_text", f"""WITH {FLAT_SQL}, p AS (SELECT chunk_id, text, {PREFIX_SQL} AS prefix FROM flat)
SELECT chunk_id, prefix, md5(CASE WHEN prefix <> '' THEN prefix || {NL} || {NL} || text ELSE text END) AS text_md5 FROM p""")
def embedding_text(spark, sf):
    p = flat_notes(spark, sf).withColumn("prefix", V.embedding_prefix())
    return p.select("chunk_id", "prefix", F.md5(V.embedding_text(F.col("text"), F.col("prefix"))).alias("text_md5"))


MARKER = quoted("(?m)" + fixed.PAGE_MARKER)
# Pages of the guideline view: by marker where there are two or more, else by length.
PAGES_SQL = f"""{GUIDELINE_SQL},
cut AS (SELECT doc_id, markdown, string_split_regex(markdown, {MARKER}) AS pieces, regexp_extract_all(markdown, {MARKER}, 1) AS nums FROM guideline),
by_marker AS (SELECT doc_id, i - 1 AS page_ordinal, CASE WHEN nums[i] <> '' THEN CAST(nums[i] AS INTEGER) ELSE CAST(i AS INTEGER) END AS page_number,
    trim(pieces[i + 1], ' ' || chr(9) || {NL} || chr(13)) AS markdown
  FROM (SELECT *, unnest(range(1, len(pieces))) AS i FROM cut WHERE len(pieces) > 2)),
walk AS (SELECT doc_id, markdown, length(markdown) AS size, length(markdown) // greatest(1, length(markdown) // 2500) AS step,
    0 AS pos, 0 AS page, '' AS body FROM cut WHERE len(pieces) <= 2
  UNION ALL
  SELECT doc_id, markdown, size, step, stop, page + CASE WHEN body2 <> '' THEN 1 ELSE 0 END, body2 FROM (
    SELECT *, trim(substr(markdown, pos + 1, stop - pos), ' ' || chr(9) || {NL} || chr(13)) AS body2 FROM (
      SELECT *, CASE WHEN goal < size AND blank > 0 THEN goal - 200 + blank - 1 ELSE goal END AS stop FROM (
        SELECT *, strpos(substr(markdown, goal - 199, 400), {NL} || {NL}) AS blank FROM (
          SELECT *, least(pos + step, size) AS goal FROM walk WHERE pos < size))))),
by_length AS (SELECT doc_id, CAST(page - 1 AS BIGINT) AS page_ordinal, page AS page_number, body AS markdown FROM walk WHERE body <> ''),
pages0 AS (SELECT * FROM by_marker UNION ALL SELECT * FROM by_length),
pages_sections AS (SELECT *, CASE WHEN regexp_matches(markdown, {quoted('(?m)' + fixed.SECTION_HEADER)})
    THEN list_transform(list_zip(regexp_extract_all(markdown, {quoted('(?m)' + fixed.SECTION_HEADER)}, 2),
      regexp_extract_all(markdown, {quoted('(?m)' + fixed.SECTION_HEADER)}, 3)), lambda z: z[1] || ' ' || trim(z[2]))
    ELSE list_transform(list_zip(regexp_extract_all(markdown, {quoted('(?m)' + fixed.RAW_SECTION)}, 1),
      regexp_extract_all(markdown, {quoted('(?m)' + fixed.RAW_SECTION)}, 2)), lambda z: z[1] || ' ' || trim(z[2], ' ' || {NL})) END AS sections,
  regexp_matches(markdown, {quoted(fixed.PAGE_TABLE_ROW)}) AS has_tables,
  CASE WHEN page_number <= 2 THEN 'frontmatter'
    WHEN contains(substr(lower(markdown), 1, 500), 'contents') AND page_number < 10
      AND (len(string_split(markdown, '...')) > 4 OR len(string_split(markdown, '. . .')) > 4) THEN 'toc'
    WHEN contains(substr(lower(markdown), 1, 200), 'appendix') THEN 'appendix'
    WHEN page_number > 45 AND contains(substr(lower(markdown), 1, 200), 'reference') THEN 'references'
    ELSE 'content' END AS content_type FROM pages0)"""


def guideline_pages(spark, sf):
    return P.to_pages(guideline(spark, sf), "markdown")


@query("page_split", f"""WITH RECURSIVE {PAGES_SQL} SELECT doc_id, CAST(page_ordinal AS INTEGER) AS page_ordinal, page_number,
  CAST(length(markdown) AS INTEGER) AS chars, md5(markdown) AS markdown_md5, array_to_string(sections, ';') AS sections, has_tables, content_type
FROM pages_sections""")
def page_split(spark, sf):
    return guideline_pages(spark, sf).select(
        "doc_id", "page_ordinal", "page_number", F.length("markdown").alias("chars"), F.md5("markdown").alias("markdown_md5"),
        F.array_join("sections", ";").alias("sections"), "has_tables", "content_type")


@query("section_list", f"""WITH RECURSIVE {PAGES_SQL} SELECT doc_id, page_number, unnest(sections) AS section FROM pages_sections
WHERE content_type = 'content'""")
def section_list(spark, sf):
    return P.section_listing(P.content_pages(guideline_pages(spark, sf)))


TERM_SQL = ", ".join(
    f"CAST(sum((length(lower(markdown)) - length(replace(lower(markdown), {quoted(t)}, ''))) // {len(t)}) AS BIGINT) AS n_{t.replace(' ', '_')}"
    for t in fixed.PROFILE_TERMS)


@query("doc_profile", f"""WITH RECURSIVE {PAGES_SQL}, s AS (SELECT doc_id, count(*) AS pages,
  count(*) FILTER (content_type = 'content') AS content_pages, count(*) FILTER (content_type = 'frontmatter') AS frontmatter_pages,
  count(*) FILTER (content_type = 'toc') AS toc_pages, count(*) FILTER (content_type = 'appendix') AS appendix_pages,
  count(*) FILTER (content_type = 'references') AS references_pages, count(*) FILTER (has_tables) AS pages_with_tables,
  count(*) FILTER (contains(markdown, '|') AND contains(markdown, '---')) AS markdown_tables,
  CAST(sum(len(sections)) AS BIGINT) AS sections, CAST(sum(length(markdown)) AS BIGINT) AS chars, {TERM_SQL}
  FROM pages_sections GROUP BY doc_id)
SELECT *, content_pages > 0 AND sections > 0 AND chars > 10000 AND n_refer > 0 AS ready FROM s""")
def doc_profile(spark, sf):
    return P.profile(guideline_pages(spark, sf))


# One extracted page per document: phrases, numbered titles and bullets between its lines.
EXTRACT_LINES = ["1.2 Referral and Review", "• first point", "- second point", "  Offer a test  ", "2.1.3.4 Deep Title",
                 "Contents ... ... ... ... ...", "Appendix A", "a\tb\tc", "plain line", ""]
PLAIN_SQL = f"""plain AS (SELECT doc_id, CAST(doc_id % 60 + 1 AS INTEGER) AS page_number, array_to_string(list_transform(string_split(text, {NL}),
  lambda x, i: {sql_nth(EXTRACT_LINES, "doc_id + i - 1")} || {NL} || x), {NL}) AS text FROM documents)"""


def plain(spark, sf):
    d = F.col("doc_id")
    text = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat(nth(EXTRACT_LINES, d + i), F.lit("\n"), x)), "\n")
    return texts(spark, sf, "documents").select("doc_id", (d % 60 + 1).cast("int").alias("page_number"), text.alias("text"))


MD_LINE = (f"CASE WHEN s = '' THEN '' WHEN regexp_matches(s, {quoted(fixed.LINE_SECTION)}) THEN repeat('#', CAST(least(4, "
           f"len(string_split(regexp_extract(s, {quoted(fixed.LINE_SECTION)}, 1), '.')) + 1) AS INTEGER)) || ' ' || "
           f"regexp_extract(s, {quoted(fixed.LINE_SECTION)}, 1) || ' ' || regexp_extract(s, {quoted(fixed.LINE_SECTION)}, 2) "
           f"WHEN substr(s, 1, 1) IN ('•', '-', '●', '○', '▪') THEN '- ' || trim(substr(s, 2)) "
           f"WHEN regexp_matches(s, {quoted('(?i)^' + fixed.LINE_RECOMMENDATION)}) THEN '> **' || s || '**' ELSE s END")


@query("text_to_markdown", f"""WITH {PLAIN_SQL}, m AS (SELECT doc_id, page_number, text, array_to_string(list_transform(
  list_transform(string_split(text, {NL}), lambda x: trim(x, ' ' || chr(9))), lambda s: {MD_LINE}), {NL}) AS markdown FROM plain)
SELECT doc_id, page_number, md5(markdown) AS markdown_md5, regexp_matches(text, '\\t.*\\t') OR contains(text, '│') AS has_tables,
  CASE WHEN page_number <= 2 THEN 'frontmatter' WHEN contains(substr(lower(markdown), 1, 500), 'contents') AND page_number < 10
    AND (len(string_split(markdown, '...')) > 4 OR len(string_split(markdown, '. . .')) > 4) THEN 'toc'
    WHEN contains(substr(lower(markdown), 1, 200), 'appendix') THEN 'appendix'
    WHEN page_number > page_number - 5 AND contains(substr(lower(markdown), 1, 200), 'reference') THEN 'references' ELSE 'content' END AS content_type
FROM m""")
def text_to_markdown(spark, sf):
    return P.plain_pages(plain(spark, sf)).select("doc_id", "page_number", F.md5("markdown").alias("markdown_md5"),
                                                  "has_tables", "content_type")


@query("titles", f"""WITH {PLAIN_SQL}, g AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '# Title ' || doc_id || {NL} || text
    WHEN 1 THEN 'Suspected cancer: recognition and referral' || {NL} || text ELSE text END AS text FROM plain),
l AS (SELECT doc_id, text, list_filter(list_transform(list_slice(string_split(trim(text, ' ' || {NL}), {NL}), 1, 15), lambda x: trim(x, ' ' || chr(9))),
  lambda s: length(s) > 10 AND length(s) < 200 AND NOT (starts_with(s, 'Page') OR starts_with(s, 'ISBN') OR starts_with(s, 'Copyright')
    OR starts_with(s, 'www.') OR starts_with(s, '©')) AND (contains(lower(s), 'cancer') OR contains(s, 'NG12'))) AS fits FROM g)
SELECT doc_id, CASE WHEN regexp_matches(text, '(?m)^#\\s+(.+)$') THEN trim(regexp_extract(text, '(?m)^#\\s+(.+)$', 1))
    WHEN regexp_matches(substr(text, 1, 2000), '(?i)' || {quoted(fixed.TITLE_PATTERN)}) THEN {quoted(fixed.TITLE_RECOGNISED)}
    ELSE {quoted(fixed.TITLE_DEFAULT)} END AS title,
  coalesce(fits[1], {quoted(fixed.TITLE_DEFAULT)}) AS text_title FROM l""")
def titles(spark, sf):
    d = F.col("doc_id")
    text = (F.when(d % 3 == 0, F.concat(F.lit("# Title "), d.cast("string"), F.lit("\n"), "text"))
            .when(d % 3 == 1, F.concat(F.lit("Suspected cancer: recognition and referral\n"), "text")).otherwise(F.col("text")))
    g = plain(spark, sf).select("doc_id", text.alias("text"))
    return g.select("doc_id", S.title(F.col("text")).alias("title"), S.title_from_text(F.col("text")).alias("text_title"))


@query("section_hierarchy", f"""WITH {NOTES_SQL} SELECT doc_id, array_to_string({HIERARCHY}, '|') AS hierarchy FROM notes""")
def section_hierarchy(spark, sf):
    return notes(spark, sf).select("doc_id", F.array_join(C.section_hierarchy(F.col("section")), "|").alias("hierarchy"))
