"""Conversations, transcripts, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import fixed
from ..functions import transcripts as X
from ..operators import traces, turns
from ..session import shared_folder
from ..streaming import conversations as live
from . import query
from .derived import DIALOGUE_SQL, NOTES_SQL, SYMPTOM_WORDS, TRANSCRIPTS_SQL, dialogue, notes, quoted, sql_list, table, transcripts, with_sayings

NL = "chr(10)"


def sql_any_term(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(t)})" for t in terms) + ")"


def sql_any_regex(text: str, regexes) -> str:
    return f"regexp_matches({text}, {quoted('|'.join(f'(?:{r})' for r in regexes))})"


WS = "' ' || chr(9) || chr(10)"
LOW = f"trim(lower(text), {WS})"
WORDS = "len(list_filter(string_split_regex({}, '\\s+'), lambda x: x <> ''))"
WANTS = f"({sql_any_term(LOW, fixed.ASSESSMENT_KEYWORDS)} OR ({WORDS.format(LOW)} <= 3 AND {sql_any_term(LOW, fixed.AFFIRMATIVE_KEYWORDS)}))"
CONTEXT = f"({sql_any_term(LOW, fixed.CONTEXT_QUESTION_WORDS)} AND {sql_any_regex(LOW, fixed.CONTEXT_PATTERNS)})"
_m = lambda p: f"regexp_matches(lower(text), {quoted(p)})"
PATIENT = (f"(NOT {sql_any_term('lower(text)', fixed.GUIDELINE_QUESTION_PHRASES)} AND (({_m(fixed.PATIENT_AGE_PATTERN)} AND {_m(fixed.PATIENT_SEX_PATTERN)}) "
           f"OR ({_m(fixed.MY_PATIENT_PATTERN)} AND ({_m(fixed.PATIENT_AGE_PATTERN)} OR {_m(fixed.PATIENT_SEX_PATTERN)})) "
           f"OR ({_m(fixed.ASSESS_COMMAND_PATTERN)} AND {_m(fixed.PATIENT_AGE_PATTERN)})))")


@query("turn_intents", f"WITH {DIALOGUE_SQL} SELECT conv_id, turn, {WANTS} AS wants_assessment, {CONTEXT} AS context_question, {PATIENT} AS patient_data FROM dialogue")
def turn_intents(spark, sf):
    return turns.intent_flags(dialogue(spark, sf)).select("conv_id", "turn", "wants_assessment", "context_question", "patient_data")


def _age(i: int, p: str) -> str:
    got = f"TRY_CAST(regexp_extract(recent, {quoted(p)}, 1) AS INTEGER)"
    return f"CASE WHEN {got} BETWEEN 0 AND 120 THEN {got} END"


BITS = " + ".join(f"CASE WHEN {sql_any_term('recent', ws)} THEN {1 << i} ELSE 0 END" for i, ws in enumerate(fixed.TURN_SYMPTOMS.values()))
FACTS_CTE = f"""{DIALOGUE_SQL}, rec AS (SELECT *, lower(coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn
  ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), '')) AS recent FROM dialogue),
facts AS (SELECT *, coalesce({", ".join(_age(i, p) for i, p in enumerate(fixed.TURN_AGE_PATTERNS))}) AS stated_age, {BITS} AS bits,
  nullif(regexp_extract(recent, {quoted(fixed.TURN_DURATION_PATTERN)}, 0), '') AS stated_duration, {CONTEXT} AS ctx, {WANTS} AS wants FROM rec)"""
SYMPTOM_TEXT = ("array_to_string(list_filter([" + ", ".join(f"CASE WHEN {{b}} & {1 << i} <> 0 THEN {quoted(n)} END" for i, n in enumerate(fixed.TURN_SYMPTOMS))
                + "], lambda x: x IS NOT NULL), ';')")


@query("turn_facts", f"""WITH {FACTS_CTE} SELECT conv_id, turn, coalesce(stated_age, -1) AS age, {SYMPTOM_TEXT.format(b='bits')} AS symptoms, coalesce(stated_duration, '') AS duration FROM facts""")
def turn_facts(spark, sf):
    from ..functions.intents import mask_to_symptoms
    return turns.extracted_facts(dialogue(spark, sf)).select(
        "conv_id", "turn", F.coalesce("stated_age", F.lit(-1)).alias("age"),
        F.array_join(mask_to_symptoms(F.col("symptom_bits")), ";").alias("symptoms"), F.coalesce("stated_duration", F.lit("")).alias("duration"))


STATE_CTE = f"""{FACTS_CTE}, kept AS (SELECT conv_id, turn, role, ctx, wants, CASE WHEN role = 'user' AND NOT ctx THEN stated_age END AS a,
  CASE WHEN role = 'user' AND NOT ctx THEN bits ELSE 0 END AS b, CASE WHEN role = 'user' AND NOT ctx THEN stated_duration END AS d FROM facts),
run AS (SELECT *, last_value(a IGNORE NULLS) OVER w AS age, bit_or(b) OVER w AS mask, last_value(d IGNORE NULLS) OVER w AS duration FROM kept
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
dec AS (SELECT *, CASE WHEN ctx THEN 'answer_context' WHEN wants AND mask <> 0 THEN 'assess' WHEN wants THEN 'ask_missing'
  WHEN age IS NOT NULL AND mask <> 0 AND duration IS NOT NULL THEN 'confirm' ELSE 'ask_missing' END AS decision FROM run WHERE role = 'user')"""


@query("turn_state", f"""WITH {STATE_CTE} SELECT conv_id, turn, coalesce(age, -1) AS age, {SYMPTOM_TEXT.format(b='mask')} AS symptoms, coalesce(duration, '') AS duration,
  concat_ws(';', CASE WHEN age IS NULL THEN 'age' END, CASE WHEN mask = 0 THEN 'symptoms' END, CASE WHEN duration IS NULL THEN 'duration' END, 'risk_factors') AS missing, decision,
  coalesce(last_value(CASE decision WHEN 'assess' THEN 'complete' WHEN 'confirm' THEN 'clarifying' WHEN 'ask_missing' THEN 'gathering' END IGNORE NULLS)
    OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'greeting') AS state FROM dec""")
def turn_state(spark, sf):
    return _state(turns.conversation_state(dialogue(spark, sf)))


def _state(df):
    return df.select("conv_id", "turn", F.coalesce("age", F.lit(-1)).alias("age"), F.array_join("symptoms", ";").alias("symptoms"),
                     F.coalesce("duration", F.lit("")).alias("duration"), F.array_join("missing", ";").alias("missing"), "decision", "state")


FOLLOW = (f"({sql_any_term('lower(text)', fixed.FOLLOW_UP_PHRASES)} OR ({WORDS.format('text')} < 8 AND NOT "
          f"({' OR '.join(f'starts_with(lower(text), {quoted(s)})' for s in fixed.QUESTION_STARTS)})))")


@query("followup_rewrite", f"""WITH {DIALOGUE_SQL}, u AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM dialogue WHERE role = 'user'),
f AS (SELECT *, {FOLLOW} AND turn >= 2 AND previous IS NOT NULL AS is_follow_up FROM u)
SELECT conv_id, turn, is_follow_up, CASE WHEN is_follow_up THEN previous || ' ' || text ELSE text END AS search_text FROM f""")
def followup_rewrite(spark, sf):
    return turns.follow_up_queries(dialogue(spark, sf))


SPOKEN = "CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || text"


@query("history_window", f"""WITH {DIALOGUE_SQL} SELECT conv_id, turn, md5(string_agg({SPOKEN}, {NL} || {NL} ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn
  ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) AS history_md5 FROM dialogue""")
def history_window(spark, sf):
    return turns.history_text(dialogue(spark, sf)).select("conv_id", "turn", F.md5("history").alias("history_md5"))


@query("history_with_summary", f"""WITH {DIALOGUE_SQL}, h AS (SELECT conv_id, turn, string_agg({SPOKEN}, {NL} || {NL} ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn
    ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS long_, string_agg({SPOKEN}, {NL} || {NL} ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS short_ FROM dialogue)
SELECT conv_id, turn, md5(CASE WHEN turn + 1 > 4 THEN '[Previous conversation summary: conversation ' || conv_id || ']' || {NL} || {NL} || 'Recent conversation:' || {NL} || short_ ELSE long_ END) AS history_md5 FROM h""")
def history_with_summary(spark, sf):
    d = dialogue(spark, sf).withColumn("summary", F.concat(F.lit("conversation "), F.col("conv_id").cast("string")))
    return turns.history_text(d, summary="summary", summarise_after=4).select("conv_id", "turn", F.md5("history").alias("history_md5"))


@query("session_summary", f"""WITH {STATE_CTE}, e AS (SELECT conv_id, arg_max(a, turn) FILTER (a IS NOT NULL) AS age, bit_or(b) AS mask, arg_max(d, turn) FILTER (d IS NOT NULL) AS duration FROM kept GROUP BY conv_id)
SELECT conv_id, 'Patient: ' || coalesce(CAST(nullif(age, 0) AS VARCHAR), '?') || 'yo ?, symptoms: ' || CASE WHEN mask <> 0 THEN replace({SYMPTOM_TEXT.format(b='mask')}, ';', ', ') ELSE 'unknown' END
  || coalesce(' for ' || duration, '') AS summary FROM e""")
def session_summary(spark, sf):
    return turns.session_summaries(dialogue(spark, sf))


@query("last_citations", f"""WITH {DIALOGUE_SQL}, c AS (SELECT conv_id, turn, regexp_extract_all(text, {quoted(fixed.CITATION_PATTERN)}) AS c FROM dialogue WHERE role = 'assistant')
SELECT conv_id, coalesce(array_to_string(arg_max(c, turn) FILTER (len(c) > 0), ';'), '') AS citations FROM (SELECT DISTINCT conv_id FROM dialogue) LEFT JOIN c USING (conv_id) GROUP BY conv_id""")
def last_citations(spark, sf):
    return turns.last_citations(dialogue(spark, sf)).select("conv_id", F.array_join("citations", ";").alias("citations"))


NEG_TERMS = [w.lower() for w in SYMPTOM_WORDS]


def _negated(term: str) -> str:
    cue = r"\b(?:no|not|denies|denied|without|never|negative for|absence of)\b(?:\s+\S+){0,5}?\s+" + term
    hit = f"list_filter(cl, lambda c: contains(c, {quoted(term)}))"
    return f"len({hit}) > 0 AND len(list_filter({hit}, lambda c: NOT regexp_matches(c, {quoted(cue)}))) = 0"


@query("negation_extract", f"""WITH {NOTES_SQL}, n AS (SELECT doc_id, lower('Patient denies ' || CASE WHEN doc_id % 2 = 0 THEN 'fever, reports ' ELSE 'any headache but has ' END || text) AS low FROM notes),
s AS (SELECT doc_id, low, string_split_regex(low, '[.;,\\n]|\\bbut\\b|\\breports?\\b') AS cl FROM n),
g AS (SELECT doc_id, list_filter([{", ".join(f"CASE WHEN {_negated(t)} THEN {quoted(t)} END" for t in NEG_TERMS)}], lambda x: x IS NOT NULL) AS neg,
  list_filter({sql_list(NEG_TERMS)}, lambda t: contains(low, t)) AS found FROM s)
SELECT doc_id, array_to_string(neg, ';') AS negated, array_to_string(list_filter(found, lambda t: NOT list_contains(neg, t)), ';') AS symptoms FROM g""")
def negation_extract(spark, sf):
    text = F.concat(F.lit("Patient denies "), F.when(F.col("doc_id") % 2 == 0, "fever, reports ").otherwise("any headache but has "), F.col("text"))
    out = turns.extract_with_negation(notes(spark, sf).select("doc_id", text.alias("text")), terms=NEG_TERMS)
    return out.select("doc_id", F.array_join("negated", ";").alias("negated"), F.array_join("symptoms", ";").alias("symptoms"))


_STATED_SQL = ("'A ' || (doc_id % 130) || CASE WHEN doc_id % 3 = 0 THEN ' year old woman' WHEN doc_id % 3 = 1 THEN ' years old man' ELSE ' year old' END || "
               "CASE WHEN doc_id % 2 = 0 THEN ' denies smoking, reports alcohol' ELSE ' is a smoker without hepatitis' END || "
               "CASE WHEN doc_id % 5 = 0 THEN ' for 3 weeks. ' ELSE '. ' END || text")


@query("negation_fields", f"""WITH {NOTES_SQL}, n AS (SELECT doc_id, lower({_STATED_SQL}) AS recent FROM notes),
s AS (SELECT doc_id, recent, string_split_regex(recent, '[.;,\\n]|\\bbut\\b|\\breports?\\b') AS cl FROM n),
g AS (SELECT doc_id, recent, list_filter([{", ".join(f"CASE WHEN {_negated(t)} THEN {quoted(t)} END" for t in fixed.RISK_FACTORS)}], lambda x: x IS NOT NULL) AS neg,
  list_filter({sql_list(fixed.RISK_FACTORS)}, lambda t: contains(recent, t)) AS found FROM s)
SELECT doc_id, array_to_string(list_filter(found, lambda t: NOT list_contains(neg, t)), ';') AS risk_factors,
  coalesce({", ".join(_age(i, p) for i, p in enumerate(fixed.TURN_AGE_PATTERNS))}, -1) AS age,
  regexp_extract(recent, {quoted(fixed.TURN_DURATION_PATTERN)}, 0) AS duration,
  CASE WHEN regexp_matches(recent, '\\b(?:female|woman|she|her)\\b|\\b\\d{{1,3}}\\s*f\\b') THEN 'female'
       WHEN regexp_matches(recent, '\\b(?:male|man|he|his)\\b|\\b\\d{{1,3}}\\s*m\\b') THEN 'male' ELSE '' END AS sex FROM g""")
def negation_fields(spark, sf):
    """Risk factors, age, duration and sex of notes that state them."""
    d = F.col("doc_id")
    text = F.concat(F.lit("A "), (d % 130).cast("string"), F.when(d % 3 == 0, " year old woman").when(d % 3 == 1, " years old man").otherwise(" year old"),
                    F.when(d % 2 == 0, " denies smoking, reports alcohol").otherwise(" is a smoker without hepatitis"),
                    F.when(d % 5 == 0, " for 3 weeks. ").otherwise(". "), F.col("text"))
    out = turns.extract_with_negation(notes(spark, sf).select("doc_id", text.alias("text")), terms=NEG_TERMS)
    return out.select("doc_id", F.array_join("risk_factors", ";").alias("risk_factors"), F.coalesce("age", F.lit(-1)).alias("age"),
                      F.coalesce("duration", F.lit("")).alias("duration"), F.coalesce("sex", F.lit("")).alias("sex"))


FINAL = quoted("(?is)" + fixed.FINAL_ANSWER_PATTERN)
THOUGHT = quoted(r"(?is)Thought(?:\s*\d*)?:\s*(.+?)(?:Action|Final Answer|$)")
NAME, INPUT = quoted("(?i)" + fixed.ACTION_NAME_PATTERN), quoted("(?is)" + fixed.ACTION_INPUT_PATTERN)
STEPS_CTE = f"""{TRANSCRIPTS_SQL}, steps AS (SELECT run_id, step, observation, trim(regexp_extract(raw_text, {THOUGHT}, 1), {WS}) AS thought,
  CASE WHEN regexp_matches(raw_text, {FINAL}) THEN trim(regexp_extract(raw_text, {FINAL}, 1), {WS}) END AS final_answer,
  CASE WHEN NOT regexp_matches(raw_text, {FINAL}) AND regexp_matches(raw_text, {NAME}) THEN regexp_extract(raw_text, {NAME}, 1) END AS action,
  CASE WHEN NOT regexp_matches(raw_text, {FINAL}) AND regexp_matches(raw_text, {INPUT}) THEN
    CASE WHEN json_valid(regexp_extract(raw_text, {INPUT}, 1)) THEN regexp_extract(raw_text, {INPUT}, 1) ELSE '{{}}' END END AS action_input FROM transcripts)"""


def parsed(spark, sf):
    return traces.parse_steps(transcripts(spark, sf)).drop("raw_text")


@query("transcript_steps", f"""WITH {STEPS_CTE} SELECT run_id, step, md5(thought) AS thought_md5, coalesce(action, '') AS action, coalesce(action_input, '') AS action_input,
  coalesce(md5(final_answer), '') AS final_md5 FROM steps""")
def transcript_steps(spark, sf):
    return parsed(spark, sf).select("run_id", "step", F.md5("thought").alias("thought_md5"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("action", "action_input")],
                                    F.coalesce(F.md5("final_answer"), F.lit("")).alias("final_md5"))


JSON_TEXTS = ['{"a": 1}', 'see ```json\n{"b": [1, 2]}\n``` end', 'text {"c": {"d": 2}} tail', "no json", '{"broken": ', "```\n[1]\n```", 'x { y } z']


@query("lenient_json", f"""WITH t AS (SELECT conv_id, turn, ({sql_list(JSON_TEXTS)})[CAST((conv_id * 3 + turn) % {len(JSON_TEXTS)} AS INTEGER) + 1] || CASE WHEN (conv_id + turn) % 2 = 0 THEN '' ELSE ' ' || text END AS text FROM conversations),
e AS (SELECT *, regexp_extract(text, '```(?:json)?\\s*((?s:.*?))\\s*```', 1) AS fenced, regexp_extract(text, '(?s)\\{{.*\\}}', 0) AS braced FROM t)
SELECT conv_id, turn, coalesce(CASE WHEN json_valid(text) THEN text END, CASE WHEN fenced <> '' AND json_valid(fenced) THEN fenced END, CASE WHEN braced <> '' AND json_valid(braced) THEN braced END, '') AS json FROM e""")
def lenient_json(spark, sf):
    from .derived import nth
    k = F.col("conv_id") * 3 + F.col("turn")
    text = F.concat(nth(JSON_TEXTS, k), F.when((F.col("conv_id") + F.col("turn")) % 2 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), F.col("text"))))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce(X.lenient_json(text), F.lit("")).alias("json"))


@query("tools_used", f"WITH {STEPS_CTE} SELECT run_id, step, action FROM steps WHERE action IS NOT NULL")
def tools_used(spark, sf):
    return traces.tools_used(parsed(spark, sf))


@query("run_totals", f"WITH {STEPS_CTE} SELECT run_id, count(*) AS steps, count(action) AS tool_calls, count(DISTINCT action) AS tools FROM steps GROUP BY run_id")
def run_totals(spark, sf):
    return traces.run_totals(parsed(spark, sf))


PROMPT_SQL = f"""concat_ws({NL}, 'Thought ' || step || ': ' || thought, 'Action ' || step || ': ' || action,
  CASE WHEN action IS NOT NULL AND action_input IS NOT NULL AND action_input NOT IN ('', '{{}}') THEN 'Action Input ' || step || ': ' || action_input END,
  CASE WHEN observation <> '' THEN 'Observation ' || step || ': ' || observation END)"""
LABEL = "CASE action " + " ".join(f"WHEN '{k}' THEN {quoted(v)}" for k, v in fixed.ACTION_LABELS.items()) + " ELSE '🔧 ' || action END"
DISPLAY_SQL = f"""concat_ws({NL}, {NL} || '**Step ' || step || ':** ' || CASE WHEN length(thought) > 150 THEN left(thought, 150) || '...' ELSE thought END,
  CASE WHEN action IS NOT NULL THEN '   → ' || {LABEL} END,
  CASE WHEN action IS NOT NULL AND observation <> '' THEN '   ✓ Found: ' || translate(CASE WHEN length(observation) > 100 THEN left(observation, 100) || '...' ELSE observation END, '{{}}"', '') END)"""
REASON_SQL = f"'Step ' || step || ': ' || left(thought, 100) || '...' || {NL} || CASE WHEN action IS NOT NULL THEN '  → Used tool: ' || action || {NL} ELSE '' END"


@query("trace_render", f"""WITH {STEPS_CTE} SELECT run_id, md5(string_agg({PROMPT_SQL}, {NL} || {NL} ORDER BY step)) AS prompt_md5,
  md5(string_agg({DISPLAY_SQL}, {NL} ORDER BY step)) AS display_md5, md5(string_agg({REASON_SQL}, '' ORDER BY step)) AS reasoning_md5 FROM steps GROUP BY run_id""")
def trace_render(spark, sf):
    steps = parsed(spark, sf)
    out = None
    for form in ("prompt", "display", "reasoning"):
        one = traces.render(steps, form).select("run_id", F.md5("text").alias(f"{form}_md5"))
        out = one if out is None else out.join(one, "run_id")
    return out


@query("trace_lookup", f"""WITH {STEPS_CTE}, w AS (SELECT DISTINCT o_custkey AS run_id FROM orders)
SELECT run_id, steps.run_id IS NOT NULL AS found, coalesce(step, -1) AS step, coalesce(CASE WHEN length(observation) > 200 THEN left(observation, 200) || '...' ELSE observation END, '') AS observation
FROM w LEFT JOIN steps USING (run_id)""")
def trace_lookup(spark, sf):
    wanted = table(spark, sf, "orders").select(F.col("o_custkey").alias("run_id"))
    out = traces.trace_by_id(traces.step_table(parsed(spark, sf)), wanted)
    return out.select("run_id", "found", F.coalesce("step", F.lit(-1)).alias("step"), F.coalesce("observation", F.lit("")).alias("observation"))


def streamed(spark, sf):
    """The dialogue view as a stream of timed turns."""
    schema = table(spark, sf, "conversations").schema
    raw = spark.readStream.schema(schema).format("parquet").load(f"{sf}/conversation[s].parquet")
    ts = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 7200 + F.col("turn") * 60)
    return with_sayings(raw).withColumn("ts", ts)


TIMED_SQL = f"{DIALOGUE_SQL}, timed AS (SELECT *, 1700000000 + conv_id * 7200 + turn * 60 AS at_s FROM dialogue)"


@query("session_windows_stream", f"""WITH {TIMED_SQL}, s AS (SELECT conv_id, min(at_s) AS session_start, max(at_s) + 3600 AS session_end, count(*) AS turns,
  count(*) FILTER (role = 'user') AS user_turns FROM timed GROUP BY conv_id)
SELECT * FROM s WHERE session_end <= (SELECT max(at_s) - 60 FROM timed)""")
def session_windows_stream(spark, sf):
    """Sessions of the conversations, read and aggregated as a stream; the watermark has to pass a session's end."""
    out = _drained(spark, live.session_statistics(streamed(spark, sf), watermark="1 minute"), "append")
    return out.withColumns({c: F.unix_timestamp(c) for c in ("session_start", "session_end")})


# Facts of each turn on its own, as the stream reads them.
OWN_FACTS = f"""{TIMED_SQL}, rec AS (SELECT *, lower(text) AS recent FROM timed), facts AS (SELECT *, coalesce({", ".join(_age(i, p) for i, p in enumerate(fixed.TURN_AGE_PATTERNS))}) AS stated_age, {BITS} AS bits,
  nullif(regexp_extract(recent, {quoted(fixed.TURN_DURATION_PATTERN)}, 0), '') AS stated_duration, {CONTEXT} AS ctx, {WANTS} AS wants FROM rec)"""


@query("live_state_stream", f"""WITH {OWN_FACTS}, run AS (SELECT conv_id, turn, at_s, role, ctx, wants, count(*) OVER w AS turns,
  last_value(CASE WHEN role = 'user' AND NOT ctx THEN stated_age END IGNORE NULLS) OVER w AS age,
  bit_or(CASE WHEN role = 'user' AND NOT ctx THEN bits ELSE 0 END) OVER w AS symptom_bits,
  last_value(CASE WHEN role = 'user' AND NOT ctx THEN stated_duration END IGNORE NULLS) OVER w AS duration FROM facts
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
dec AS (SELECT *, CASE WHEN ctx THEN 'answer_context' WHEN wants AND symptom_bits <> 0 THEN 'assess' WHEN wants THEN 'ask_missing'
  WHEN age IS NOT NULL AND symptom_bits <> 0 AND duration IS NOT NULL THEN 'confirm' ELSE 'ask_missing' END AS decision FROM run WHERE role = 'user'),
ends AS (SELECT r.*, at_s + 3600 AS due FROM run r JOIN (SELECT conv_id, max(turn) AS turn FROM run GROUP BY conv_id) USING (conv_id, turn)),
rows_ AS (SELECT conv_id, at_s, age, symptom_bits, duration, turns, decision, CASE decision WHEN 'assess' THEN 'complete' WHEN 'confirm' THEN 'clarifying'
    WHEN 'ask_missing' THEN 'gathering' ELSE '' END AS state, false AS expired FROM dec
  UNION ALL SELECT conv_id, due, age, symptom_bits, duration, turns, 'expire', 'greeting', true FROM ends WHERE due <= (SELECT max(at_s) - 3600 FROM timed))
SELECT conv_id, at_s, coalesce(age, -1) AS age, CAST(symptom_bits AS BIGINT) AS symptom_bits, coalesce(duration, '') AS duration, turns, decision, state, expired FROM rows_""")
def live_state_stream(spark, sf):
    """Running conversation state, read and kept as a stream; silent conversations expire with the watermark."""
    out = _drained(spark, live.live_state(streamed(spark, sf)), "append")
    return out.select("conv_id", F.unix_timestamp("ts").alias("at_s"), F.coalesce("age", F.lit(-1)).alias("age"), "symptom_bits",
                      F.coalesce("duration", F.lit("")).alias("duration"), "turns", "decision",
                      F.coalesce("state", F.lit("")).alias("state"), "expired")


def _drained(spark, df, mode):
    """Run a stream over all present files into a Parquet folder of its own and read that."""
    folder = shared_folder(spark).rstrip("/") + f"/stream-{uuid.uuid4().hex}"
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = (df.writeStream.outputMode(mode).format("parquet").option("path", folder + "/out")
             .option("checkpointLocation", folder + "/checkpoint").trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(df.schema).parquet(folder + "/out")
