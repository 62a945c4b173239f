"""Near-duplicates and contamination over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontaminate, embeddings, simhash
from .common import table
from .registry import query


@query("op2_simhash")
def op2_simhash(spark, sf_dir):
    return simhash.find_near_duplicates(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


_WORDS_SQL = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
              r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
_CONTAMINATION_SQL = f"""
with d as (select doc_id, {_WORDS_SQL} w from documents),
i as (select item_id, {_WORDS_SQL} w from benchmark),
item_windows as (
  select distinct item_id, n, array_to_string(w[s + 1:s + n], ' ') win
  from (select item_id, w, least(len(w), {decontaminate.WINDOW}) n, unnest(generate_series(0, len(w) - least(len(w), {decontaminate.WINDOW}))) s
        from i where len(w) > 0)),
doc_windows as (
  select doc_id, n, s, array_to_string(w[s + 1:s + n], ' ') win
  from (select doc_id, w, n, unnest(generate_series(0, len(w) - n)) s from d, (select distinct n from item_windows) where len(w) >= n)),
hits as (select doc_id, item_id, s, doc_windows.n from doc_windows join item_windows using (n, win)),
covered as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(generate_series(s, s + n - 1)) p from hits) group by doc_id),
named as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) items
          from (select distinct doc_id, item_id::varchar item from hits where item_id is not null) group by doc_id)
select doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(items, '')) items_sha256,
  coalesce(n_hit, 0) > 0 contaminated
from d left join covered using (doc_id) left join named using (doc_id)"""


@query("op9_decontaminate", _CONTAMINATION_SQL)
def op9_decontaminate(spark, sf_dir):
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


_LINK_SQL = """
with recursive v as (
  select vec_id, embedding::double[] e, embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 ok
  from embeddings),
pairs as (select a.vec_id a, b.vec_id b from v a join v b on a.vec_id <> b.vec_id and a.ok and b.ok and len(a.e) = len(b.e)
          where list_cosine_similarity(a.e, b.e) >= 0.9),
reach(vec_id, other) as (select vec_id, vec_id from v union select reach.vec_id, pairs.b from reach join pairs on reach.other = pairs.a),
least as (select vec_id, min(other) component_id from reach group by vec_id),
degree as (select a vec_id, count(*) n_links from pairs group by a)
select vec_id, coalesce(n_links, 0) n_links, component_id, vec_id = component_id kept from least left join degree using (vec_id)"""


@query("op10_embeddings", _LINK_SQL)
def op10_embeddings(spark, sf_dir):
    found = embeddings.find_near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"),
                        F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))
