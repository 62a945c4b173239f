"""Secrets, URL rules, licences and personal data over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import pii, secrets, spans, urls
from .common import table
from .registry import query


def _digest_of(kept: Column) -> Column:
    return F.sha2(spans.listed(kept), 256)


def _base(kinds: list[str]) -> Column:
    return F.filter("spans", lambda s: s["kind"].isin(kinds))


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _found_sql(kinds: list[tuple[str, str, str]], context: bool = False) -> str:
    """Common tables: ``found`` (doc_id, nth, kind, s, e, v) of all matches kept, by kind (name, RE2 pattern, condition on v)."""
    parts = []
    for nth, (name, pattern, keep) in enumerate(kinds):
        p = _sql_text(pattern)
        parts.append(f"""
  select * from (
    select doc_id, {nth} nth, '{name}' kind, v, before, after,
      sum(length(gap) + length(v)) over (partition by doc_id order by i) - length(v) s, sum(length(gap) + length(v)) over (partition by doc_id order by i) e
    from (select doc_id, unnest(m) v, unnest(g[1:len(m)]) gap, right(unnest(g[1:len(m)]), 50) before, left(unnest(g[2:]), 50) after,
                 generate_subscripts(m, 1) i
          from (select doc_id, regexp_extract_all(text, {p}) m, string_split_regex(text, {p}) g from texts) where len(m) > 0))
  where {keep}""")
    return ("with texts as (select doc_id, coalesce(text, '') as text from documents),\nfound as (" + "\n  union all".join(parts) + ")")


_SECRET_SQL = _found_sql([
    ("assign", secrets.ASSIGN.replace("++", "+"),
     "length(regexp_extract(v, '^[A-Za-z_]+[\"'']?\\x20*[:=]\\x20*[\"'']?(.*)$', 1)) >= 6"),
    ("access", "AKIA[A-Z0-9]+", "length(v) >= 20"),
    ("hex", "[0-9a-f]+", "length(v) >= 24"),
    ("login", secrets.LOGIN.replace("{3,}+", "{3,}"), "true"),
    ("phrase", secrets.PHRASE.replace("{4,}+", "{4,}"), "true"),
    ("endpoint", secrets.ENDPOINT.replace("{3,}+", "{3,}"), "true")]) + f""",
told as (
  select * from found f where nth < 3
    or (kind = 'login' and exists (select 1 from found o where o.doc_id = f.doc_id and o.kind in ('assign', 'hex', 'phrase') and abs(o.s - f.s) <= {secrets.SCOPE}))
    or (kind = 'phrase' and exists (select 1 from found o where o.doc_id = f.doc_id and o.kind in ('access', 'login', 'endpoint') and abs(o.s - f.s) <= {secrets.SCOPE}))
    or (kind = 'endpoint' and exists (select 1 from found o where o.doc_id = f.doc_id and o.kind in ('access', 'login') and abs(o.s - f.s) <= {secrets.SCOPE})
                         and exists (select 1 from found o where o.doc_id = f.doc_id and o.kind in ('assign', 'hex', 'phrase') and abs(o.s - f.s) <= {secrets.SCOPE}))),
per_doc as (
  select doc_id, count(*) filter (kind = 'assign') n_assign, count(*) filter (kind = 'access') n_access, count(*) filter (kind = 'hex') n_hex,
    string_agg(kind || ':' || s::bigint || ':' || e::bigint, ',' order by s, nth) filter (nth < 3) base,
    string_agg(kind || ':' || s::bigint || ':' || e::bigint, ',' order by s, nth) spans
  from told group by doc_id)
select d.doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex,
  sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
from documents d left join per_doc using (doc_id)"""


@query("op1_secrets", _SECRET_SQL)
def op1_secrets(spark, sf_dir):
    kinds = ["assign", "access", "hex"]
    return secrets.find_secrets(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), *(_count(k) for k in kinds), _digest_of(_base(kinds)).alias("base_sha256"),
        spans.listed(F.col("spans")).alias("spans"))


_LUHN_SQL = """list_sum(list_transform(generate_series(1, length({d})), lambda i: case
  when i % 2 = 1 then ascii(reverse({d})[i]) - 48
  else (2 * (ascii(reverse({d})[i]) - 48)) // 10 + (2 * (ascii(reverse({d})[i]) - 48)) % 10 end)) % 10 = 0""".format(d="regexp_replace(v, '[^0-9]', '', 'g')")
_MOD_SQL = """length(replace(v, ' ', '')) between 15 and 34 and list_reduce(list_prepend(0::bigint, list_transform(
  string_split(replace(v, ' ', '')[5:] || replace(v, ' ', '')[1:4], ''), lambda c: case when c >= 'A' then ascii(c)::bigint + 945 else ascii(c)::bigint - 48 end)),
  lambda acc, x: case when x >= 900 then (acc * 100 + x - 1000) % 97 else (acc * 10 + x) % 97 end) = 1"""
_PII_SQL = _found_sql([
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "list_max(list_transform(string_split(v, '.'), lambda p: try_cast(p as hugeint))) <= 255"
           " and len(list_filter(string_split(v, '.'), lambda p: try_cast(p as hugeint) is null)) = 0"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", "length(regexp_replace(v, '[^0-9]', '', 'g')) between 13 and 19 and " + _LUHN_SQL),
    ("phone", pii.PHONE, "length(regexp_replace(v, '[^0-9]', '', 'g')) between 9 and 15"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b", _MOD_SQL),
    ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "right(before, 1) <> '-' and left(after, 1) <> '-'")]) + """,
told as (
  select *, least(1.0, round(base + case when regexp_matches(lower(before || ' ' || after), word) then 0.3 else 0 end, 3)) score
  from found join (values """ + ", ".join(
      f"('{k}', {pii.SCORE[k]}::double, {_sql_text(pii.CONTEXT[k])})" for k in pii.SCORE) + f""") t(kind, base, word) using (kind)),
per_doc as (
  select doc_id, count(*) filter (kind = 'email') n_email, count(*) filter (kind = 'ip') n_ip, count(*) filter (kind = 'card') n_card,
    count(*) filter (kind = 'phone') n_phone,
    string_agg(kind || ':' || s::bigint || ':' || e::bigint, ',' order by nth, s) filter (nth < 4) base,
    string_agg(kind || ':' || s::bigint || ':' || e::bigint, ',' order by nth, s) spans, max(score) score
  from told where score >= {pii.THRESHOLD} group by doc_id)
select d.doc_id, coalesce(n_email, 0) n_email, coalesce(n_ip, 0) n_ip, coalesce(n_card, 0) n_card, coalesce(n_phone, 0) n_phone,
  sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans, coalesce(score, 0.0)::double score
from documents d left join per_doc using (doc_id)"""


@query("op7_personal_data", _PII_SQL)
def op7_personal_data(spark, sf_dir):
    kinds = ["email", "ip", "card", "phone"]
    return pii.find_personal_data(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), *(_count(k) for k in kinds), _digest_of(_base(kinds)).alias("base_sha256"),
        spans.listed(F.col("spans")).alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"))


# The rules of the query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
         ("net", "/fr/", "block")]
_RULE_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
_URL_SQL = f"""
with rules(rh, rp, rv) as (values {_RULE_VALUES}),
rest as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end r from pages),
parts as (select page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
                 regexp_extract(r, '^[^/?#]*([^?#]*)', 1) path from rest),
fits as (select page_id, max(struct_pack(n := length(rh) + length(rp), h := length(rh), rule := rh || rp, verdict := rv)) best
         from parts, rules where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by page_id)
select page_id, host, path, best.rule rule, coalesce(best.verdict, 'allow') verdict from parts left join fits using (page_id)"""


@query("op5_urls", _URL_SQL)
def op5_urls(spark, sf_dir):
    rules = spark.sql(f"select * from values {_RULE_VALUES} as rules(host, path, verdict)")
    return urls.judge(table(spark, sf_dir, "pages"), rules).withColumnRenamed("id", "page_id")
