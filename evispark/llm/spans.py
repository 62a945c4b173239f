"""Regex matches with their positions, as DataFrame expressions only.

``regexp_extract_all`` gives the matches and ``split`` by the same pattern the text between them, so a match
starts where the lengths before it end.  Rows are (document, kind, number), and a running sum over a
document's rows of a kind gives the positions: linear in the matches, and only matches are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

CONTEXT = 50


@dataclass(frozen=True)
class Kind:
    """A pattern, what its text must hold to be tried (a cheap test), and what a match must meet to be kept.

    Patterns must run in linear time on any text: possessive repeats, and ``(?:\\G|(?<![x]))`` before a
    leading run of x, which starts a match at a run's start or right behind the match before, as a leftmost
    search does, without trying again inside the run.
    """
    name: str
    pattern: str
    keep: Callable[[Column], Column] = field(default=lambda m: F.lit(True))
    needs: Callable[[Column], Column] = field(default=lambda text: F.lit(True))


def matches(docs: DataFrame, kinds: list[Kind], id_column: str, text_column: str) -> tuple[DataFrame, DataFrame]:
    """All documents and all kept matches.

    Documents: ``row`` (a number of the row, so that null and repeated ids stay apart) and ``id``.
    Matches: ``row``, ``id``, ``kind``, ``nth`` (place of the kind in the list), ``start``, ``end`` (code points, end
    exclusive), ``value``, ``before`` and ``after`` (up to 50 code points of text to the matches around it).
    A null text has no match.  The table of raw matches is written to the shared folder, so texts are scanned once.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    found = docs.select(F.col(id_column).alias("id"), text.alias("text"))
    found = found.select("id", "text", *(
        F.when(k.needs(F.col("text")), F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0))).alias(f"m{i}")
        for i, k in enumerate(kinds)))
    none = F.expr("cast(array() as array<struct<nth:int,i:int,gap:int,width:int,value:string,before:string,after:string>>)")
    found = checkpointed(found.select(
        F.monotonically_increasing_id().alias("row"), "id",
        F.concat(*(F.coalesce(F.when(F.size(f"m{i}") > 0, _numbered(i, k)), none) for i, k in enumerate(kinds))).alias("raw")))
    per_kind = Window.partitionBy("row", "nth").orderBy("i")
    rows = found.where(F.size("raw") > 0).select("row", "id", F.inline("raw")).select(
        "*", F.sum(F.col("gap") + F.col("width")).over(per_kind).alias("end"))
    kept = F.lit(False)
    for i, k in enumerate(kinds):
        kept = kept | ((F.col("nth") == i) & k.keep(F.col("value")))
    names = F.array(*(F.lit(k.name) for k in kinds))
    return found.select("row", "id"), rows.where(kept).select(
        "row", "id", F.get(names, F.col("nth")).alias("kind"), "nth", (F.col("end") - F.col("width")).alias("start"), "end",
        "value", "before", "after")


def _numbered(i: int, kind: Kind) -> Column:
    """Each match with the text before it; the split text is bound once by the outer lambda."""
    def zipped(gaps: Column) -> Column:
        sides = F.zip_with(gaps, F.slice(gaps, 2, F.size(gaps)), lambda gap, after: F.struct(gap.alias("gap"), after.alias("after")))
        return F.filter(F.zip_with(sides, F.col(f"m{i}"), lambda s, value: F.struct(s.alias("s"), value.alias("value"))),
                        lambda x: x["value"].isNotNull())
    once = F.get(F.transform(F.array(F.split("text", kind.pattern, -1)), zipped), F.lit(0))
    return F.transform(once, lambda x, n: F.struct(
        F.lit(i).alias("nth"), n.cast("int").alias("i"), F.length(x["s"]["gap"]).alias("gap"),
        F.length(x["value"]).alias("width"), x["value"].alias("value"),
        F.right(x["s"]["gap"], F.lit(CONTEXT)).alias("before"),
        F.coalesce(F.left(x["s"]["after"], F.lit(CONTEXT)), F.lit("")).alias("after")))


def listed(rows: Column) -> Column:
    """``kind:start:end``, comma-joined, of an array of structs (.., kind, start, end) in order."""
    return F.array_join(F.transform(rows, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
