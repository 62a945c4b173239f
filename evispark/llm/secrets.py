"""Secret scan: strong matches as they are, weak ones only where complementary parts stand close together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from . import spans
from .common import fits, same
from .spans import Kind

SCOPE = 200

# The base kinds.
ASSIGN = (r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
          r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]++""")
ASSIGN_VALUE = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?(.*)$"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
# The weak kinds of this operator.
LOGIN = (r"""(?:[Uu]ser(?:_?[Nn]ame|_?[Ii]d)?|[Ll]ogin|[Aa]ccount(?:_?[Ii]d)?|[Cc]lient_?[Ii]d)["']?\x20*[:=]\x20*["']?"""
         r"""[A-Za-z0-9_.@-]{3,}+""")
PHRASE = (r"""(?:[Pp]wd|[Pp]ass|[Pp]assphrase|[Cc]redential|[Pp]rivate_?[Kk]ey|[Aa]uth)["']?\x20*[:=]\x20*["']?"""
          r"""[A-Za-z0-9+/_.=!@#$%-]{4,}+""")
ENDPOINT = r"(?:https?|ftp|jdbc|mongodb|postgres|mysql|redis|amqp|s3)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]{3,}+"


def _has(*parts: str):
    def test(text: Column) -> Column:
        low, found = F.lower(text), F.lit(False)
        for p in parts:
            found = found | F.contains(low, F.lit(p))
        return found
    return test


KINDS = [
    Kind("assign", ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN_VALUE, 1)) >= 6,
         _has("passw", "secret", "token", "apikey", "api_key")),
    Kind("access", ACCESS, needs=lambda text: F.contains(text, F.lit("AKIA"))),
    Kind("hex", HEX),
    Kind("login", LOGIN, needs=_has("user", "login", "account", "client")),
    Kind("phrase", PHRASE, needs=_has("pwd", "pass", "credential", "private", "auth")),
    Kind("endpoint", ENDPOINT, needs=lambda text: F.contains(text, F.lit("://"))),
]
#: What a kind is a part of, and what else must be near for a weak kind: any of the listed sets, all of a set.
PART = {"access": "name", "login": "name", "assign": "secret", "hex": "secret", "phrase": "secret", "endpoint": "place"}
WEAK = {"login": [{"secret"}], "phrase": [{"name"}, {"place"}], "endpoint": [{"name", "secret"}]}


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per document: ``row``, ``id`` and ``spans`` array<struct<start, nth, kind, end, value>> in order.

    Kinds ``assign``, ``access`` and ``hex`` are reported as they match.  ``login``, ``phrase`` and ``endpoint``
    are weak: reported only if complementary parts of the same document start at most ``scope`` code points away (a
    login needs a secret; a phrase a name or an endpoint; an endpoint a name and a secret).  Weak parts
    complete each other.  Linking is an interval join: parts go to bins of ``scope`` code points with their first and
    last start per bin, and a weak candidate meets its own and the two neighbouring bins: no pairs of parts arise.

    Null and empty texts have no spans; rows with null or repeated ids are judged each on its own
    text; an empty table gives an empty one.  Other columns of ``docs`` are not read.
    """
    rows, found = spans.matches(docs, KINDS, id_column, text_column)
    part = F.create_map(*(F.lit(x) for pair in PART.items() for x in pair))
    found = found.select("row", "nth", "kind", "start", "end", "value", part[F.col("kind")].alias("part"),
                         F.floor(F.col("start") / scope).alias("bin"))
    weak = found.where(F.col("kind").isin(*WEAK))
    ranges = found.groupBy("row", "bin", F.col("part").alias("other")).agg(F.min("start").alias("first"), F.max("start").alias("last"))
    near = weak.select("row", "nth", "start", "bin", F.explode(F.array(*(F.col("bin") + d for d in (-1, 0, 1)))).alias("meets")).join(
        ranges.withColumnRenamed("bin", "meets"), ["row", "meets"]).where(
        "meets = bin or (meets < bin and last >= start - {0}) or (meets > bin and first <= start + {0})".format(scope))
    near = near.groupBy("row", "nth", "start").agg(F.collect_set("other").alias("others"))
    linked = F.lit(False)
    for kind, ways in WEAK.items():
        for way in ways:
            met = F.col("kind") == kind
            for p in way:
                met = met & F.array_contains("others", p)
            linked = linked | met
    told = found.where(~F.col("kind").isin(*WEAK)).select("row", "nth", "kind", "start", "end", "value").union(
        weak.join(near, ["row", "nth", "start"]).where(linked).select("row", "nth", "kind", "start", "end", "value"))
    told = told.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "nth", "kind", "end", "value"))).alias("spans"))
    none = F.expr("cast(array() as array<struct<start:bigint,nth:int,kind:string,end:bigint,value:string>>)")
    return rows.join(told, "row", "left").select("row", "id", F.coalesce("spans", none).alias("spans"))


def redact(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", mark: str = "<secret>") -> DataFrame:
    """``docs`` with each reported span of secrets replaced by ``mark``; all rows and columns stay.

    Overlapping spans are replaced as one.  Rows are packed while they are joined, so their column
    names clash with nothing; rows of one id and text are redacted alike.
    """
    key = [F.col("doc")[id_column], F.xxhash64(F.col("doc")[text_column]), F.length(F.col("doc")[text_column])]
    packed = docs.select(F.struct("*").alias("doc")).select("doc", *(k.alias(f"k{i}") for i, k in enumerate(key)))
    found = find_secrets(packed.select(F.struct("k0", "k1", "k2").alias("key"), F.col("doc")[text_column].alias("text")), "key", "text")
    found = found.where(F.size("spans") > 0).groupBy("id").agg(F.first("spans").alias("spans")).select(
        *(F.col("id")[f"k{i}"].alias(f"f{i}") for i in range(3)),
        F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))
    found = checkpointed(found)
    found = F.broadcast(found) if fits(found, F.size("spans") * 64 + 128) else found
    text = F.col("doc")[text_column]
    start = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at"))

    def add(done: Column, span: Column) -> Column:
        """Text up to the span and the mark; a span that begins inside the last one only lengthens it."""
        apart = F.concat(done["text"], F.substring(text, done["at"] + 1, span["start"] - done["at"]), F.lit(mark))
        return F.struct(F.when(span["start"] >= done["at"], apart).otherwise(done["text"]).alias("text"),
                        F.greatest(done["at"], span["end"]).alias("at"))
    redacted = F.aggregate("spans", start, add, lambda done: F.concat(
        done["text"], F.substring(text, done["at"] + 1, F.length(text))))
    joined = packed.join(found, same([(F.col(f"k{i}"), F.col(f"f{i}")) for i in range(3)]), "left")
    return joined.select(*(F.when(F.col("spans").isNull(), text).otherwise(redacted).alias(c) if c == text_column
                           else F.col("doc")[c].alias(c) for c in docs.columns))
