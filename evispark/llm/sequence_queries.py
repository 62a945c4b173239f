"""Conversations, runs and pieces over whole tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import periodic, pieces, repair
from .common import table
from .registry import query

WORD = r"[^\x20\x09-\x0D]+"


def looped(text: Column, doc_id: Column) -> Column:
    """The text of one document in ten, as its id decides, with its end made periodic; all others as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def cut(words: Column) -> Column:
        a = g % F.size(words)
        return F.struct(words.alias("w"), a.alias("a"), (F.floor((F.size(words) - a) / (3 + g % 8)) + 1).alias("p"))

    def bound(value: Column, f) -> Column:
        """``value`` is worked out once."""
        return F.get(F.transform(F.array(value), f), F.lit(0))

    def rewritten(x: Column) -> Column:
        return F.array_join(F.transform(x["w"], lambda w, i: F.when(i < x["a"], w).otherwise(
            F.get(x["w"], (x["a"] + (i - x["a"]) % x["p"]).cast("int")))), " ")

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.when((h % 10 == 0) & text.rlike(WORD), bound(bound(words, cut), rewritten)).otherwise(text)


@query("op12_periodic_runs")
def op12_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", looped(F.col("text"), F.col("doc_id")).alias("text"))
    # The greatest length first, then the least start, then the least period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = periodic.find_runs(docs).withColumn("best", best)
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"),
        F.col("best.n").alias("length"), (-F.col("best.p")).alias("period"),
        F.floor(1000 * F.col("best.n") / -F.col("best.p")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def piece_model() -> str:
    """Where the tokenizer of the query lies; any other path can be given to the operator."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


@query("op13_pieces")
def op13_pieces(spark, sf_dir):
    found = pieces.encode(table(spark, sf_dir, "documents"), piece_model(), decoded=True)
    return found.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def damaged(turns):
    """Rows of conversations as the query damages them: dropped, emptied, cut, repeated or of another role, by their key."""
    def text(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), h.alias("h")).where("h <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def _least_sql(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


def _edit_sql(letter: str, cost: str, to: str, line: str | None) -> str:
    lines = f"{to}.l" if line is None else f"list_prepend({line}, {to}.l)"
    return f"{{'c': {cost} + {to}.c, 'a': '{letter}' || {to}.a, 'l': {lines}}}"


def _row_sql(state: int) -> str:
    """The cheapest way from a state over the next row on."""
    wanted = repair.WANTED[state]
    options = [_edit_sql("D", "4", f"v{state}", None),
               f"case when code <> 'd' then {_edit_sql('R', '3 + extra', f'v{wanted}', chr(39) + repair.NAMES[wanted] + ':' + chr(39) + ' || body')} end"]
    options += [f"case when low = '{c}' then {_edit_sql('K', 'extra', f'v{to}', 'role || chr(58) || body')} end"
                for (s, c), to in repair.KEPT.items() if s == state]
    return _least_sql(*options)


def _inserted_sql(state: int) -> str:
    """The same with inserts before the row; more than two in a row only lead back."""
    once = repair.WANTED[state]
    twice = repair.WANTED[once]
    line = {s: f"'{name}:'" for s, name in repair.NAMES.items()}
    one = _edit_sql("I", "3", f"b{once}", line[once])
    two = f"{{'c': 6 + b{twice}.c, 'a': 'II' || b{twice}.a, 'l': list_prepend({line[once]}, list_prepend({line[twice]}, b{twice}.l))}}"
    return _least_sql(f"b{state}", one, two)


_CRC_BITS = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)"
_REPAIR_SQL = rf"""
with recursive keyed as (
  select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') body,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''),
      lambda x: ascii(x)::bigint)), lambda c, b: {_CRC_BITS}), 4294967295::bigint) % 20 h
  from conversations),
damaged as (
  select conv_id, turn, case when h = 4 then 'user' else role end as role,
    case h when 1 then '' when 2 then regexp_replace(body, '[.!?]', '', 'g') else body end body, unnest(case when h = 3 then [0, 1] else [0] end) copy
  from keyed where h <> 0),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, body, copy) i from damaged),
faulty as (
  select *, case when not regexp_matches(body, '[^\x20\x09-\x0D]') then 'blank'
      when row_number() over (partition by conv_id, role, body order by i) > 1 then 'duplicate'
      when not regexp_matches(body, '[.!?][\x20\x09-\x0D]*$') then 'truncated' end fault,
    left(role, 1) initial, lag(left(role, 1)) over (partition by conv_id order by i) before from placed),
told as (
  select conv_id, count(*) m, list(role order by i) roles, list(body order by i) bodies, list(coalesce(fault, '') order by i) faults,
    count(*) filter (fault = 'blank') blank, count(*) filter (fault = 'duplicate') duplicate, count(*) filter (fault = 'truncated') truncated,
    count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) illegal,
    coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps
  from faulty group by conv_id),
walked as (
  select conv_id, m i, m, {{'c': 0::bigint, 'a': '', 'l': []::varchar[]}} v0, {{'c': 6::bigint, 'a': 'II', 'l': ['user:', 'assistant:']}} v1,
    {{'c': 3::bigint, 'a': 'I', 'l': ['assistant:']}} v2, {{'c': 0::bigint, 'a': '', 'l': []::varchar[]}} v3 from told
  union all
  select conv_id, i - 1, m, {_inserted_sql(0)}, {_inserted_sql(1)}, {_inserted_sql(2)}, {_inserted_sql(3)}
  from (select *, {_row_sql(0)} b0, {_row_sql(1)} b1, {_row_sql(2)} b2, {_row_sql(3)} b3
        from (select walked.*, roles[i] role, bodies[i] body, case when faults[i] = 'truncated' then 3 else 0 end extra,
                case when faults[i] in ('blank', 'duplicate') then 'd' else left(roles[i], 1) end low,
                case when faults[i] in ('blank', 'duplicate') then 'd' else 'x' end code
              from walked join told on walked.conv_id is not distinct from told.conv_id where i > 0)))
select ids.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank, coalesce(duplicate, 0)::bigint duplicate,
  coalesce(truncated, 0)::bigint truncated, coalesce(illegal, 0)::bigint illegal, coalesce(v0.c, 0)::bigint as cost, coalesce(v0.a, '') audit,
  sha256(coalesce(array_to_string(v0.l, chr(10)), '')) repaired_sha256
from (select distinct conv_id from conversations) ids left join told on ids.conv_id is not distinct from told.conv_id
left join (select * from walked where i = 0) done on ids.conv_id is not distinct from done.conv_id"""


@query("op11_conversations", _REPAIR_SQL)
def op11_conversations(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    rows = damaged(turns)
    ids = turns.select("conv_id").distinct()
    found = repair.summaries(repair.repair(rows)).withColumnRenamed("id", "own")
    missing = repair.gaps(rows).withColumnRenamed("id", "other")
    out = ids.join(found, F.col("conv_id").eqNullSafe(F.col("own")), "left").join(missing, F.col("conv_id").eqNullSafe(F.col("other")), "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
