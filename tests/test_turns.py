import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from evispark import fixed
from evispark.functions import intents
from evispark.operators import traces, turns
from evispark.operators.evaluation import fits

TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("text, redirected", [
    ("age 50, male, chronic cough for 30 days", True), ("my patient is 55 with hemoptysis", False),
    ("my patient is a male with hemoptysis", True), ("assess this patient: aged 62 with weight loss", True),
    ("What does NG12 say about haematuria?", False), ("what age should a 50 year old male be seen", False)])
def test_patient_data(spark, text, redirected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(intents.brings_patient_data(F.col("t"))).first()[0] is redirected


@pytest.mark.parametrize("text, wants, context", [
    ("yes please", True, False), ("ex smoker", True, False), ("please tell me more about this one", False, False),
    ("run assessment now", True, False), ("how old is she", False, True), ("Summarize", False, True), ("remind me", False, True)])
def test_intents(spark, text, wants, context):
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(intents.wants_assessment(F.col("t")), intents.asks_about_context(F.col("t"))).first()
    assert tuple(row) == (wants, context)


def test_whole_word_consent(spark):
    df = spark.createDataFrame([("ex smoker",), ("ok",)], "t string")
    assert [r[0] for r in df.select(intents.wants_assessment(F.col("t"), whole_words=True)).collect()] == [False, True]


def brute_state(rows):
    """State after each user turn of one conversation, in a loop."""
    known, state, out = {"age": None, "symptoms": [], "duration": None}, "greeting", []
    for i, (role, text) in enumerate(rows):
        if role != "user":
            continue
        low = text.lower().strip()
        context = any(w in low for w in fixed.CONTEXT_QUESTION_WORDS) and any(re.search(p, low) for p in fixed.CONTEXT_PATTERNS)
        if context:
            out.append((i, known["age"], list(known["symptoms"]), known["duration"], "answer_context", state))
            continue
        recent = " ".join(t for r, t in rows[max(0, i - 3):i + 1] if r == "user").lower()
        for p in fixed.TURN_AGE_PATTERNS:
            m = re.search(p, recent)
            if m and 0 <= int(m.group(1)) <= 120:
                known["age"] = int(m.group(1))
                break
        found = [s for s, ws in fixed.TURN_SYMPTOMS.items() if any(w in recent for w in ws)]
        known["symptoms"] = [s for s in fixed.TURN_SYMPTOMS if s in known["symptoms"] or s in found]
        m = re.search(fixed.TURN_DURATION_PATTERN, recent)
        known["duration"] = m.group(0) if m else known["duration"]
        asks = any(k in low for k in fixed.ASSESSMENT_KEYWORDS) or (
            len(low.split()) <= 3 and any(k in low for k in fixed.AFFIRMATIVE_KEYWORDS))
        ready = known["age"] is not None and known["symptoms"] and known["duration"]
        decision = ("assess" if asks and known["symptoms"] else "ask_missing" if asks else "confirm" if ready else "ask_missing")
        state = {"assess": "complete", "confirm": "clarifying", "ask_missing": "gathering"}[decision]
        out.append((i, known["age"], list(known["symptoms"]), known["duration"], decision, state))
    return out


def conversations(n, length, hot_length, seed=4):
    rng = random.Random(seed)
    sayings = ["age 50", "a cough", "yes", "for 3 weeks", "how old", "she is 71 years", "bleeding and pain", "hello there my friend",
               "patient is 45", "summary", "what about men", "And for colorectal?"]
    rows = []
    for c in range(n):
        for t in range(hot_length if c == 0 else rng.randint(1, length)):
            rows.append((c, t, "user" if rng.random() < 0.6 else "assistant", rng.choice(sayings)))
    return rows


@pytest.fixture(scope="module")
def talk(spark):
    rows = conversations(8, 12, 60)
    return rows, spark.createDataFrame(rows, TURNS)


@pytest.mark.parametrize("span", [1024, 7])
def test_state_matches_loop(talk, span):
    """A conversation longer than a part gives what one pass gives."""
    rows, df = talk
    got = {}
    for r in turns.conversation_state(df, span=span).orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.turn, r.age, r.symptoms, r.duration, r.decision, r.state))
    for c in {r[0] for r in rows}:
        assert got.get(c, []) == brute_state([(r[2], r[3]) for r in rows if r[0] == c])


@pytest.mark.parametrize("span", [1024, 16])
def test_history_and_follow_up(talk, span):
    rows, df = talk
    history = {(r.conv_id, r.turn): r.history for r in turns.history_text(df, span=span).collect()}
    follow = {(r.conv_id, r.turn): (r.is_follow_up, r.search_text) for r in turns.follow_up_queries(df, span=span).collect()}
    assert len(history) == len(rows)
    for c in {r[0] for r in rows}:
        said = [(r[2], r[3]) for r in rows if r[0] == c]
        for i, (role, text) in enumerate(said):
            lines = [f"{'User' if r == 'user' else 'Assistant'}: {t}" for r, t in said[max(0, i - 9):i + 1]]
            assert history[(c, i)] == "\n\n".join(lines)
            if role == "user":
                before = [t for r, t in said[:i] if r == "user"]
                low = text.lower()
                asks = any(p in low for p in fixed.FOLLOW_UP_PHRASES) or (
                    len(text.split()) < 8 and not low.startswith(tuple(fixed.QUESTION_STARTS)))
                use = asks and i >= 2 and bool(before)
                assert follow[(c, i)] == (use, f"{before[-1]} {text}" if use else text)


def test_numbering_turns(spark):
    rows = [(c, 1000 - i, f"t{c}-{i}") for c in range(3) for i in range(50)]
    got = turns.number_turns(spark.createDataFrame(rows, "conv_id long, at long, text string"), "at").collect()
    assert {(r.conv_id, r.turn): r.text for r in got} == {(c, i): f"t{c}-{49 - i}" for c in range(3) for i in range(50)}


def test_summary_and_citations(spark):
    df = spark.createDataFrame([(1, 0, "user", "age 50 with cough for 3 weeks"), (1, 1, "assistant", "see [NG12 1.1, p.3]"),
                                (1, 2, "assistant", "no source"), (2, 0, "user", "hello")], TURNS)
    s = {r.conv_id: r.summary for r in turns.session_summaries(df).collect()}
    assert s == {1: "Patient: 50yo ?, symptoms: cough for 3 week".replace("3 week", "3 weeks"), 2: "Patient: ?yo ?, symptoms: unknown"}
    c = {r.conv_id: r.citations for r in turns.last_citations(df).collect()}
    assert c == {1: ["[NG12 1.1, p.3]"], 2: []}


def test_negation(spark):
    df = spark.createDataFrame([("Patient denies chest pain, reports persistent cough for 3 weeks. Female, 55 years, former smoker",)], "text string")
    row = turns.extract_with_negation(df, terms=["chest pain", "persistent cough", "fever"]).first()
    assert (row.symptoms, row.negated, row.duration, row.age, row.sex, row.risk_factors) == (
        ["persistent cough"], ["chest pain"], "3 weeks", 55, "female", ["smoker"])


RAW = [
    ('Thought: look\nAction: search_guidelines\nAction Input: {"query": "x"}', "look", "search_guidelines", '{"query": "x"}', None),
    ("Thought 2: now\nAction 2: get_section\nAction Input: {bad}", "now", "get_section", "{}", None),
    ("Thought: done\nAction: ignored\nFinal Answer: refer\nsoon [NG12 1.1, p.2]", "done", None, None, "refer\nsoon [NG12 1.1, p.2]"),
    ("no structure", "", None, None, None),
]


def test_steps(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(RAW)], "step int, raw_text string")
    rows = traces.parse_steps(df).orderBy("step").collect()
    assert [(r.thought, r.action, r.action_input, r.final_answer) for r in rows] == [r[1:] for r in RAW]


def test_json(spark):
    from evispark.functions.transcripts import citations, lenient_json
    cases = {'{"a": 1}': '{"a": 1}', 'x ```json\n{"a": 1}\n``` y': '{"a": 1}', 'x {"a": {"b": 2}} y': '{"a": {"b": 2}}', "none": None,
             '{"a": 1} tail': '{"a": 1}', "1] x [2": None, "1, 2": None, '{"a"': None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(lenient_json(F.col("t"))).collect()] == list(cases.values())
    assert spark.range(1).select(citations(F.lit("a [NG12 1, p.2] b [other] [NG12 3]"))).first()[0] == ["[NG12 1, p.2]", "[NG12 3]"]


def test_rendering_in_parts(spark):
    rows = [(1, i, f"t{i}", "get_section" if i % 2 else None, "{}" if i % 2 else None, "o" * 300 if i % 2 else None) for i in range(1, 11)]
    df = spark.createDataFrame(rows, "run_id long, step int, thought string, action string, action_input string, observation string")
    for form in ("reasoning", "prompt", "display"):
        parts, whole = (traces.render(df, form, per_part=n).collect() for n in (4, 256))
        assert len(parts) == 1 and parts == whole
    assert traces.render(df.where("step = 1"), "display").first().text == (
        "\n**Step 1:** t1\n   → 📄 Retrieved guideline section\n   ✓ Found: " + "o" * 100 + "...")
    assert traces.run_totals(df).first()[1:] == (10, 5, 1)
    assert len(traces.step_table(df).where("step = 1").first().observation) == 203


def test_grounded(spark):
    hits = spark.createDataFrame([(1, 0.9, "[NG12 1]"), (1, 0.2, "[NG12 2]"), (2, 0.5, "[NG12 1]")], "query_id long, score double, citation string")
    answers = spark.createDataFrame([(1, "a [NG12 1] and [NG12 2]"), (2, "[NG12 1]"), (3, "[NG12 9]")], "query_id long, answer string")
    got = {r.query_id: (r.grounded, r.unsupported) for r in traces.groundedness(answers, hits).collect()}
    assert got == {1: (True, 0), 2: (False, 0), 3: (False, 1)}


def test_fits_stops_early(spark):
    assert fits(spark.range(10), 10) and not fits(spark.range(11), 10)


def test_numbers_of_many_written_rows(spark, tmp_path):
    """Every row is written with its place: 400,000 rows over conversations from short to a third of all, in random order."""
    n = 400_000
    rows = spark.range(n).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000 + 10).alias("conv_id"),
                                 (F.pmod(F.xxhash64("id"), F.lit(10**9))).alias("at"), "id")
    turns.number_turns(rows.repartition(7), "at").write.parquet(str(tmp_path / "numbered"))
    got = spark.read.parquet(str(tmp_path / "numbered"))
    assert got.count() == n
    w = Window.partitionBy("conv_id").orderBy("at")
    assert got.withColumn("want", F.row_number().over(w) - 1).where("want <> turn").count() == 0


def test_look_backs_over_gaps(spark):
    """Turn numbers with gaps at part edges: the last rows count, not the last numbers."""
    numbers = [*range(0, 20), *range(1000, 1020), *range(1030, 1040), 2047, 2048, 5000]
    rows = [(c, t, "user" if i % 2 == 0 else "assistant", f"{c}-{t} age {i}") for c in (1, 2) for i, t in enumerate(numbers)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r.history for r in turns.history_text(df, span=16).collect()}
    said = {(c, t): ("User: " if role == "user" else "Assistant: ") + text for c, t, role, text in rows}
    assert got == {(c, t): "\n\n".join(said[c, x] for x in numbers[max(0, i - 9):i + 1]) for c in (1, 2) for i, t in enumerate(numbers)}
    for span in (16, 1024, 100_000):
        recent = {(r.conv_id, r.turn): r.recent for r in turns.recent_user_text(df, span=span).collect()}
        users = {(c, t): text for c, t, role, text in rows if role == "user"}
        assert recent == {(c, t): " ".join(users[c, x] for x in numbers[max(0, i - 3):i + 1] if (c, x) in users).lower()
                          for c in (1, 2) for i, t in enumerate(numbers)}


def test_free_text_is_read_by_ascii_words(spark):
    df = spark.createDataFrame([(1, "seen at 81 für, énot fever, no\u00a0cough, denies über headache"), (2, None)], "doc_id long, text string")
    rows = turns.extract_with_negation(df, terms=["fever", "cough", "headache"]).orderBy("doc_id").collect()
    assert (rows[0].sex, rows[0].negated, rows[0].symptoms) == ("female", ["fever", "headache"], ["cough"])
    assert (rows[1].sex, rows[1].negated, rows[1].symptoms) == (None, [], [])
