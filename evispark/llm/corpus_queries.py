"""Mixing, languages, licences and language-model scores over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import language, licenses, lm, mixing
from .common import table
from .registry import query


def _mark_sql(*parts: str) -> str:
    return "('0x' || left(md5(" + " || '|' || ".join(f"coalesce(({p})::varchar, '')" for p in parts) + "), 8))::bigint"


_MIX_SQL = f"""
with recursive counted as (
  select doc_id, source, (source is null)::varchar || coalesce(':' || source, '') grp,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint tokens, {_mark_sql(str(mixing.SEED), 'doc_id', "md5(coalesce(text, ''))")} mark
  from documents),
totals as (select grp, sum(tokens)::bigint tokens, count(*) docs from counted group by grp),
shares as materialized (select tokens::double / (select sum(tokens) from totals)::double q from totals where tokens > 0),
halved(i, low, high) as (
  select 0, 0.0::double, 1.0::double
  union all
  select i + 1, case when fits then low else mid end, case when fits then mid else high end
  from (select i, low, high, (low + high) / 2 mid, (select max(pow(q, (low + high) / 2 - 1)) / min(pow(q, (low + high) / 2 - 1)) from shares) <= 2.0 fits
        from halved where i < {mixing.STEPS})),
chosen as (select case when (select max(1 / q) / min(1 / q) from shares) <= 2.0 then 0.0 else (select high from halved where i = {mixing.STEPS}) end x),
sums as (select x, sum(pow(q, x)) z, min(pow(q, x - 1)) least from shares, chosen group by x),
plan as (
  select grp, tokens source_tokens, docs, weight, reads, ceil(docs / {mixing.BLOCK_DOCS}.0)::bigint blocks, floor(reads)::bigint whole,
    round((reads - floor(reads)) * tokens)::bigint rest
  from (select *, case when tokens > 0 then round(weight * ((select sum(tokens) from totals) * z / least) / tokens, 6) else 1.0 end reads
        from (select totals.*, z, least, case when tokens > 0 then pow(tokens::double / (select sum(tokens) from totals)::double, x) / z else 0.0 end weight
              from totals, sums))),
dealt as (select *, mark % blocks block from counted join plan using (grp)),
epochs as (
  select grp, block, epoch, {_mark_sql(str(mixing.SEED), 'epoch', 'grp', 'block')} turn, ceil(sqrt(blocks))::bigint supers, block_tokens
  from (select grp, block, blocks, sum(tokens) block_tokens, unnest(generate_series(0, case when rest > 0 then whole else whole - 1 end)) epoch
        from dealt group by grp, block, blocks, rest, whole)),
placed as (
  select grp, block, epoch, coalesce(sum(block_tokens) over (partition by grp, epoch order by floor(turn * supers / 4294967296.0), turn, block
    rows between unbounded preceding and 1 preceding), 0) ahead from epochs),
readings as (
  select *, ahead + coalesce(sum(tokens) over (partition by grp, block, epoch order by turn, mark, tokens
    rows between unbounded preceding and 1 preceding), 0) start
  from (select *, {_mark_sql(str(mixing.SEED), 'epoch', 'mark')} turn from dealt join placed using (grp, block)))
select doc_id, source, epoch, block, tokens, round(least((epoch * source_tokens + start) / greatest(reads * source_tokens, 1.0), 1.0), 6)::double "at",
  round(weight, 6) weight
from readings where epoch < whole or start + tokens <= rest"""


@query("op3_mixing", _MIX_SQL)
def op3_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op4_language")
def op4_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs)).withColumnRenamed("id", "doc_id")


_TEMPLATE_WORDS = ", ".join(f"('{label}', {i}, '{w}')" for label, text, _ in licenses.TEMPLATES for i, w in enumerate(text.split()))
_TEMPLATE_SIZES = ", ".join(f"('{label}', {len(text.split())}, {licenses.needed(len(text.split()))})" for label, text, _ in licenses.TEMPLATES)
_KEY_PLACES = ", ".join(
    f"('{label}', {k}, {list(range(i, i + len(key.split())))})" for label, text, keys in licenses.TEMPLATES for k, key in enumerate(keys)
    for i in range(len(text.split())) if text.split()[i:i + len(key.split())] == key.split())
_PHRASE_WORDS = ", ".join(f"({phrase.split()}, '{label}')" for phrase, label in licenses.PHRASES.items())
_LICENSE_SQL = f"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from documents),
dw as (select doc_id, unnest(w) word, generate_subscripts(w, 1) - 1 pos from d),
tw(label, place, word) as (values {_TEMPLATE_WORDS}), ts(label, n, need) as (values {_TEMPLATE_SIZES}),
kp(label, k, held) as (values {_KEY_PLACES}), ph(words, label) as (values {_PHRASE_WORDS}),
aligned as (select doc_id, label, pos - place b, list(place) places, count(*) c from dw join tw using (word) group by doc_id, label, pos - place),
keyed as (select doc_id, label, b, c, k, bool_or(list_has_all(places, held)) ok from aligned join kp using (label) group by doc_id, label, b, c, k),
met as (select doc_id, label, b, c from keyed group by doc_id, label, b, c having bool_and(ok)),
own as (select doc_id, label, max(c::double / n) share from met join ts using (label) where c >= need group by doc_id, label),
base as (select doc_id, label, pos from dw join d using (doc_id) join ph on ph.words[1] = word where w[pos + 1:pos + len(ph.words)] = ph.words),
counted as (select doc_id, count(*) n_base, min(pos) first_word, max(pos) last_word, string_agg(distinct label, ',' order by label) base_labels from base group by doc_id),
named as (select doc_id, string_agg(distinct label, ',' order by label) labels from (select doc_id, label from base union select doc_id, label from own) group by doc_id)
select doc_id, len(w) n_words, coalesce(n_base, 0) n_base, first_word, last_word, coalesce(base_labels, '') base_labels, coalesce(labels, '') labels,
  round(case when n_base > 0 then 1.0 else coalesce((select max(share) from own where own.doc_id = d.doc_id), 0.0) end, 6)::double score
from d left join counted using (doc_id) left join named using (doc_id)"""


@query("op6_licenses", _LICENSE_SQL)
def op6_licenses(spark, sf_dir):
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    own = F.transform("templates", lambda t: t["label"])
    score = F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("templates", lambda t: t["share"])), F.lit(0.0)))
    return licenses.find_licenses(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["start"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["start"])).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        F.round(score, 6).alias("score"))


@query("op8_language_model")
def op8_language_model(spark, sf_dir):
    blocks = lm.cut(table(spark, sf_dir, "documents"))
    counts = lm.word_counts(blocks)
    return lm.score(blocks, lm.train(blocks, counts), counts=counts).withColumnRenamed("id", "doc_id")
