"""Views both engines derive from the given tables, with the same arithmetic.

The given texts hold no clinical words, so clinical phrases are added to them by row
number.  Each view comes as a DataFrame and as SQL for the check; all rows and whole
texts are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import literal_array
from ..operators.sizes import spread

PHRASES = [
    "Refer urgently people aged 40 and over with haemoptysis and weight loss for lung cancer",
    "Consider referral within 2 weeks for rectal bleeding and suspected colorectal cancer",
    "Offer an urgent chest x-ray within 14 days for persistent cough",
    "Routine referral for fatigue lasting 6 months with a family history of breast cancer",
    "Do not offer a ct scan if the patient is 30 years or younger",
    "Evidence shows that smoking raises the risk of bladder cancer and haematuria",
    "Dysphagia is defined as difficulty swallowing",
    "Use a suspected cancer pathway referral for breast lump, 30 years and over",
    "Non-urgent referral after 12 weeks of back pain",
    "Arrange mri and biopsy, Discuss exposure to asbestos",
    "the following factors matter: alcohol, obesity and night sweats",
    "unexplained bruising was seen",
    "aged 55 or over with bloating and abdominal pain, very urgent ultrasound",
]
SYMPTOM_WORDS = ["Haemoptysis", "cough", "persistent cough", "unexplained weight loss", "fatigue", "dysphagia",
                 "headache", "breast lump", "lump", "rectal bleeding", "back pain", "fever", "night sweats"]
FACTOR_WORDS = ["Current Smoker", "Never Smoked", "family history of cancer", "Ex-Smoker", "none", "previous cancer"]
SAYINGS = [
    "What symptoms trigger urgent referral for lung cancer?", "age 50, male, chronic cough for 30 days",
    "my patient is a 62 year old female with weight loss", "yes please", "What about for patients under 40?",
    "assess this patient: aged 71 with bleeding for 3 weeks", "summarize what you know", "ok",
    "he is tired and febrile", "And for colorectal?", "how old is the patient", "no other symptoms",
    "patient is 45 and has a swelling", "what does ng12 say about haematuria", "ex smoker",
    "lasting 2 months, temperature up", "show me the details", "[NG12 Section 1.1, p.3] and [NG12 1.2, p.4]",
]
TOOLS = ["search_guidelines", "check_red_flags", "calculate_risk", "get_section", "lookup_cancer_criteria", "other_tool"]
CANCERS = ["lung", "Breast", "colorectal", "skin", "bladder"]
URGENCIES = ["urgent_2_week", "Urgent", "routine", "monitor", "bogus"]


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def nth(values: list[str], index: Column) -> Column:
    """Entry number ``index`` modulo the list's length."""
    return F.element_at(literal_array(values), (index % len(values)).cast("int") + 1)


def sql_nth(values: list[str], index: str) -> str:
    return f"({sql_list(values)})[CAST(({index}) % {len(values)} AS INTEGER) + 1]"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table with long texts, whose per-row work is worth spreading."""
    return spread(table(spark, sf, name))


def guideline(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as Markdown with page markers, numbered headers, phrases and table rows."""
    docs = texts(spark, sf, "documents")
    d = F.col("doc_id")

    def line(x: Column, i: Column) -> Column:
        page = (F.floor(i / 12) + 1).cast("string")
        return (F.when(i % 12 == 0, F.concat(F.lit("<!-- Page "), page, F.lit(" -->\n\n## "), (d % 9 + 1).cast("string"),
                                             F.lit("."), page, F.lit(" Referral section\n\n"), x))
                .when((d + i) % 7 == 3, F.concat(nth(PHRASES, d + i), F.lit(" "), x))
                .when((d + i) % 11 == 5, F.concat(F.lit("| "), x, F.lit(" |"))).otherwise(x))

    text = F.array_join(F.transform(F.split("text", "\n"), line), "\n\n")
    return docs.select("doc_id", "source", text.alias("markdown"))


GUIDELINE_SQL = f"""guideline AS (
  SELECT doc_id, source, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i:
    CASE WHEN (i-1) % 12 = 0 THEN '<!-- Page ' || ((i-1)//12 + 1) || ' -->' || chr(10) || chr(10) || '## '
              || (doc_id % 9 + 1) || '.' || ((i-1)//12 + 1) || ' Referral section' || chr(10) || chr(10) || x
         WHEN (doc_id + i - 1) % 7 = 3 THEN {sql_nth(PHRASES, "doc_id + i - 1")} || ' ' || x
         WHEN (doc_id + i - 1) % 11 = 5 THEN '| ' || x || ' |'
         ELSE x END), chr(10) || chr(10)) AS markdown
  FROM documents)"""


def notes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as clinical notes with a page range, section and neighbours: one chunk each."""
    d = F.col("doc_id")
    text = F.concat(nth(PHRASES, d), F.lit("\n"), F.col("text"), F.lit("\n"), nth(PHRASES, F.floor(d / 7)), F.lit(". "),
                    nth(PHRASES, F.floor(d / 3) + 5))
    return texts(spark, sf, "documents").select(
        "doc_id", "source", F.concat(F.lit("c"), d.cast("string")).alias("chunk_id"), text.alias("text"),
        (d % 40 + 1).cast("int").alias("page_start"), (d % 40 + 1 + d % 3).cast("int").alias("page_end"),
        F.when(d % 5 == 0, F.lit("")).when(d % 5 == 1, F.lit("Appendix notes")).otherwise(
            F.concat((d % 4 + 1).cast("string"), F.lit("."), (d % 6 + 1).cast("string"), F.lit("."),
                     (d % 10 + 1).cast("string"), F.lit(" Referral"))).alias("section"),
        d.cast("int").alias("chunk_index"),
        F.when(d % 20 != 0, F.concat(F.lit("c"), (d - 1).cast("string"))).alias("prev_chunk_id"),
        F.when(d % 20 != 19, F.concat(F.lit("c"), (d + 1).cast("string"))).alias("next_chunk_id"))


NOTES_SQL = f"""notes AS (
  SELECT doc_id, source, 'c' || doc_id AS chunk_id,
    {sql_nth(PHRASES, "doc_id")} || chr(10) || text || chr(10) || {sql_nth(PHRASES, "doc_id // 7")} || '. '
      || {sql_nth(PHRASES, "doc_id // 3 + 5")} AS text,
    CAST(doc_id % 40 + 1 AS INTEGER) AS page_start, CAST(doc_id % 40 + 1 + doc_id % 3 AS INTEGER) AS page_end,
    CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 = 1 THEN 'Appendix notes'
         ELSE (doc_id % 4 + 1) || '.' || (doc_id % 6 + 1) || '.' || (doc_id % 10 + 1) || ' Referral' END AS section,
    CAST(doc_id AS INTEGER) AS chunk_index,
    CASE WHEN doc_id % 20 <> 0 THEN 'c' || (doc_id - 1) END AS prev_chunk_id,
    CASE WHEN doc_id % 20 <> 19 THEN 'c' || (doc_id + 1) END AS next_chunk_id
  FROM documents)"""


def patients(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as patients."""
    k = F.col("c_custkey")
    picked = F.transform(F.sequence(F.lit(1), (k % 4).cast("int") + 1), lambda i: nth(SYMPTOM_WORDS, k + i * i))
    return table(spark, sf, "customer").select(
        k.alias("patient_id"), F.col("c_name").alias("name"), (k % 107).cast("int").alias("age"),
        F.when(k % 3 == 0, "Male").when(k % 3 == 1, "female").otherwise("unknown").alias("sex"),
        picked.alias("symptoms"),
        F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(
            F.array(nth(FACTOR_WORDS, k), nth(FACTOR_WORDS, k * 5 + 1))).alias("risk_factors"),
        F.when(k % 6 == 0, F.lit("")).otherwise(F.concat(F.col("c_mktsegment"), F.lit(" complaint"))).alias("presenting_complaint"),
        F.when(k % 5 != 0, F.concat((k % 9 + 1).cast("string"), F.lit(" weeks"))).alias("symptom_duration"),
        F.array().cast("array<string>").alias("medical_history"),
        F.when(k % 7 == 0, F.array(F.lit("mother: breast cancer"))).otherwise(F.array().cast("array<string>")).alias("family_history"),
        F.lit("").alias("additional_notes"), nth(CANCERS, k).alias("cancer"), nth(URGENCIES, k * 3).alias("stated_urgency"))


PATIENTS_SQL = f"""patients AS (
  SELECT c_custkey AS patient_id, c_name AS name, CAST(c_custkey % 107 AS INTEGER) AS age,
    CASE WHEN c_custkey % 3 = 0 THEN 'Male' WHEN c_custkey % 3 = 1 THEN 'female' ELSE 'unknown' END AS sex,
    list_transform(range(1, CAST(c_custkey % 4 AS BIGINT) + 2), lambda i: {sql_nth(SYMPTOM_WORDS, "c_custkey + i * i")}) AS symptoms,
    CASE WHEN c_custkey % 4 = 0 THEN CAST([] AS VARCHAR[]) ELSE [{sql_nth(FACTOR_WORDS, "c_custkey")},
      {sql_nth(FACTOR_WORDS, "c_custkey * 5 + 1")}] END AS risk_factors,
    CASE WHEN c_custkey % 6 = 0 THEN '' ELSE c_mktsegment || ' complaint' END AS presenting_complaint,
    CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 9 + 1) || ' weeks' END AS symptom_duration,
    CASE WHEN c_custkey % 7 = 0 THEN ['mother: breast cancer'] ELSE CAST([] AS VARCHAR[]) END AS family_history,
    {sql_nth(CANCERS, "c_custkey")} AS cancer, {sql_nth(URGENCIES, "c_custkey * 3")} AS stated_urgency
  FROM customer)"""


def dialogue(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations with clinical sayings in their turns."""
    return with_sayings(texts(spark, sf, "conversations"))


def with_sayings(conversations: DataFrame) -> DataFrame:
    """The same for any frame of conversations, a stream as well."""
    k = F.col("conv_id") * 5 + F.col("turn") * 3
    saying = nth(SAYINGS, k)
    return conversations.select(
        "conv_id", "turn", "role",
        F.when(k % 4 == 0, F.concat(saying, F.lit(" "), F.col("text"))).otherwise(saying).alias("text"))


DIALOGUE_SQL = f"""dialogue AS (
  SELECT conv_id, turn, role, CASE WHEN (conv_id * 5 + turn * 3) % 4 = 0
    THEN {sql_nth(SAYINGS, "conv_id * 5 + turn * 3")} || ' ' || text ELSE {sql_nth(SAYINGS, "conv_id * 5 + turn * 3")} END AS text
  FROM conversations)"""


def transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as agent transcripts: one raw response per turn."""
    c, t = F.col("conv_id"), F.col("turn")
    tool = nth(TOOLS, c + t)
    body = F.concat(F.lit("Thought: look at this\n"), F.col("text"), F.lit("\n"))
    raw = (F.when(t % 4 == 3, F.concat(body, F.lit("Final Answer: done, see [NG12 Section 1.1, p.3] "), F.col("text")))
           .when((c + t) % 5 == 0, F.concat(body, F.lit("Action: "), tool, F.lit("\nAction Input: {\"query\": oops}")))
           .when((c + t) % 7 == 0, F.concat(F.lit("no structure here "), F.col("text")))
           .otherwise(F.concat(body, F.lit("Action 2: "), tool, F.lit("\nAction Input: {\"query\": \"q"), c.cast("string"),
                               F.lit("\", \"k\": "), t.cast("string"), F.lit("}\n"))))
    return texts(spark, sf, "conversations").select(
        c.alias("run_id"), (t + 1).cast("int").alias("step"), raw.alias("raw_text"), F.col("text").alias("observation"))


TRANSCRIPTS_SQL = f"""transcripts AS (
  SELECT conv_id AS run_id, CAST(turn + 1 AS INTEGER) AS step, text AS observation,
    CASE WHEN turn % 4 = 3 THEN 'Thought: look at this' || chr(10) || text || chr(10) || 'Final Answer: done, see [NG12 Section 1.1, p.3] ' || text
         WHEN (conv_id + turn) % 5 = 0 THEN 'Thought: look at this' || chr(10) || text || chr(10) || 'Action: '
           || {sql_nth(TOOLS, "conv_id + turn")} || chr(10) || 'Action Input: {{"query": oops}}'
         WHEN (conv_id + turn) % 7 = 0 THEN 'no structure here ' || text
         ELSE 'Thought: look at this' || chr(10) || text || chr(10) || 'Action 2: ' || {sql_nth(TOOLS, "conv_id + turn")} || chr(10)
           || 'Action Input: {{"query": "q' || conv_id || '", "k": ' || turn || '}}' || chr(10) END AS raw_text
  FROM conversations)"""
