"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .spans import Kind

# The base kinds, then those of this operator.
LOCAL = r"A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CONTEXT = {
    "email": "mail|contact|write", "ip": r"\bip\b|address|server|host", "card": "card|visa|credit|payment",
    "phone": "phone|call|tel|mobile|fax", "iban": "iban|account|bank", "ssn": "ssn|social|security",
}
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT_SCORE = 0.3
THRESHOLD = 0.5


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, r"[^0-9]", "")


def _parts_at_most_255(match: Column) -> Column:
    """Leading zeros don't make a part greater."""
    return F.forall(F.split(match, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) < 3) | (
        (F.length(F.ltrim(p, F.lit("0"))) == 3) & (F.ltrim(p, F.lit("0")) <= "255")))


def mod97(match: Column) -> Column:
    """True for an account number of 15 to 34 characters whose check digits hold (mod 97 is 1)."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    code = F.split(turned, "")
    left = F.aggregate(code, F.lit(0), lambda acc, c: F.when(c == "", acc).when(
        c >= "A", (acc * 100 + F.ascii(c) - 55) % 97).otherwise((acc * 10 + F.ascii(c) - 48) % 97))
    return F.length(plain).between(15, 34) & (left == 1)


KINDS = [
    Kind("email", EMAIL, needs=lambda text: F.contains(text, F.lit("@"))),
    Kind("ip", IP, _parts_at_most_255, lambda text: F.contains(text, F.lit("."))),
    Kind("card", CARD, lambda m: F.length(_digits(m)).between(13, 19) & F.call_function("luhn_check", _digits(m))),
    Kind("phone", PHONE, lambda m: F.length(_digits(m)).between(9, 15), lambda text: F.contains(text, F.lit("+"))),
    Kind("iban", IBAN, mod97),
    Kind("ssn", SSN, needs=lambda text: F.contains(text, F.lit("-"))),
]


def find_personal_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                       threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``row``, ``id``, ``spans`` array<struct<nth, start, kind, end, value, score>> in order.

    A pattern proposes, a validator confirms (Luhn for cards, mod 97 for accounts, ranges and lengths else), and
    a fitting word within 50 code points on either side (up to the next match of the kind) adds to the
    score.  Spans under ``threshold`` are left out: of the kinds here, only ``ssn`` without a fitting word.

    Null and empty texts have no spans; rows with null or repeated ids are judged each on its own
    text; an empty table gives an empty one.  Other columns of ``docs`` are not read.
    """
    rows, found = spans.matches(docs, KINDS, id_column, text_column)
    near = F.lower(F.concat("before", F.lit(" "), "after"))
    score = context = None
    for k in KINDS:
        is_kind, told = F.col("kind") == k.name, near.rlike(CONTEXT[k.name])
        score = F.when(is_kind, F.lit(SCORE[k.name])) if score is None else score.when(is_kind, F.lit(SCORE[k.name]))
        context = F.when(is_kind, told) if context is None else context.when(is_kind, told)
    score = F.least(F.lit(1.0), F.round(score + F.when(context, F.lit(CONTEXT_SCORE)).otherwise(F.lit(0.0)), 3))
    found = found.select("row", "nth", "start", "kind", "end", "value", score.alias("score")).where(F.col("score") >= threshold)
    found = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("nth", "start", "kind", "end", "value", "score"))).alias("spans"))
    none = F.expr("cast(array() as array<struct<nth:int,start:bigint,kind:string,end:bigint,value:string,score:double>>)")
    return rows.join(found, "row", "left").select("row", "id", F.coalesce("spans", none).alias("spans"))
