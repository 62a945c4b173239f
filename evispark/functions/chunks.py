"""Chunking as array expressions: tables, paragraph groups, greedy packing, ids.

The packing state is sequential within one document, so it is a fold
(``aggregate``) over that document's paragraphs.  The fold carries lengths and
positions; text is put together only when a chunk is emitted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .text import pattern, strip

GAP = "\n\n"
PARAGRAPH = "struct<page:int,sec:string,text:string>"
CHUNK = "struct<text:string,page_first:int,page_start:int,page_end:int,section:string>"
CARRY = "struct<text:string,page_first:int,page_start:int,page_end:int,section:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_in_blocks(items: Column, fields: dict[str, Column], out: str, kind: str, step: Callable[[Column, Column], Column],
                   finish: Callable[[Column], Column]) -> Column:
    """A fold whose state has ``fields`` and a list ``out`` of ``kind`` that ``step`` adds to.

    Adding to an array copies it, so one long list would cost the square of its length.  Items are folded in
    blocks of about the root of their number; a block begins with an empty list, and the lists are put together at the end.
    """
    def folded(all_items: Column) -> Column:
        n = F.size(all_items)
        block = F.greatest(F.lit(1), F.floor(F.sqrt(n)).cast("int"))
        blocks = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")),
                                           lambda i: F.slice(all_items, i * block + 1, block))).otherwise(F.array())
        start = F.struct(*(c.alias(f) for f, c in fields.items()), F.array().cast(f"array<array<{kind}>>").alias("done"))

        def one(s: Column, part: Column) -> Column:
            begin = F.struct(*(s[f].alias(f) for f in fields), F.array().cast(f"array<{kind}>").alias(out))
            return let(F.aggregate(part, begin, step), lambda r: F.struct(
                *(r[f].alias(f) for f in fields), F.concat(s["done"], F.array(r[out])).alias("done")))
        return F.aggregate(blocks, start, one, lambda s: let(F.struct(
            *(s[f].alias(f) for f in fields), F.flatten(s["done"]).alias(out)), finish))
    return let(items, folded)


def protect_tables(text: Column) -> Column:
    """Put blank lines around runs of lines that start and end with ``|``."""
    lines = F.split(text, "\n")

    def marked(line: Column) -> Column:
        s = strip(line)
        return F.struct(line.alias("line"), (s == "").alias("blank"),
                        (s.startswith("|") & s.endswith("|")).alias("row"))

    def spaced(rows: Column) -> Column:
        def one(cur: Column, i: Column) -> Column:
            prev = F.get(rows, i - 1)
            opens = cur["row"] & ~prev["row"] & ~prev["blank"]
            closes = ~cur["row"] & prev["row"]
            return F.when((i > 0) & (opens | closes), F.concat(F.lit("\n"), cur["line"])).otherwise(cur["line"])
        return F.array_join(F.transform(rows, one), "\n")

    return F.when(F.contains(text, F.lit("|")), let(F.transform(lines, marked), spaced)).otherwise(text)


def paragraphs(text: Column, max_chars: int, separator: str = r"\n\n+") -> Column:
    """Paragraph groups: a header or recommendation opens a group, a full one closes it."""
    raw = F.filter(F.transform(F.split(protect_tables(text), separator), strip), lambda p: p != "")
    flagged = F.transform(raw, lambda p: F.struct(
        p.alias("text"),
        p.rlike(pattern(fixed.PARAGRAPH_SECTION.rstrip("$"))).alias("header"),
        p.rlike(pattern(fixed.PARAGRAPH_RECOMMENDATION, "mi")).alias("rec")))
    limit = F.lit(max_chars * 0.8)

    def step(state: Column, p: Column) -> Column:
        opens = p["rec"] | p["header"]
        grown = F.when(opens | (state["open"] == ""), p["text"]).otherwise(
            F.concat(state["open"], F.lit(GAP), p["text"]))
        closed = F.when(opens & (state["open"] != ""), F.concat(state["groups"], F.array(state["open"]))
                        ).otherwise(state["groups"])
        return let(F.struct(grown.alias("open"), closed.alias("groups")), lambda s: F.when(
            F.length(s["open"]) > limit,
            F.struct(F.lit("").alias("open"), F.concat(s["groups"], F.array(s["open"])).alias("groups"))
        ).otherwise(s))

    return fold_in_blocks(flagged, {"open": F.lit("")}, "groups", "string", step, lambda s: F.when(
        s["open"] != "", F.concat(s["groups"], F.array(s["open"]))).otherwise(s["groups"]))


def overlap_tail(text: Column, overlap_chars: int) -> Column:
    """Last characters, from the first sentence start in them; a short text whole."""
    if overlap_chars <= 0:
        return F.lit("")
    tail = F.right(text, F.lit(overlap_chars))
    return F.when(F.length(text) <= overlap_chars, text).otherwise(
        strip(F.regexp_replace(tail, pattern(r"^[^.!?]*[.!?]\s+"), "")))


def pack(paras: Column, max_chars: int, overlap_chars: int, carry: Column | None = None) -> Column:
    """Greedy packing of ``array<PARAGRAPH>``.

    Returns ``struct<chunks array<CHUNK>, tail CARRY>``: finished chunks and the
    text still open at the end.  ``carry`` is the open text of the part before,
    which lets a long document be packed in parts.  A paragraph without text
    only sets the current section.
    """
    none = F.lit(None).cast(CARRY)
    carry = none if carry is None else carry
    start = {
        "size": F.coalesce(F.length(carry["text"]), F.lit(0)), "at": F.lit(0), "first": F.lit(1),
        "lead": F.coalesce(carry["text"], F.lit("")), "lead_first": carry["page_first"], "lead_start": carry["page_start"],
        "lead_end": carry["page_end"], "sec": carry["section"]}

    def open_chunk(s: Column, upto: Column, sec: Column) -> Column:
        """The text gathered since the last cut, with its pages."""
        own = F.filter(F.slice(paras, s["first"], F.greatest(F.lit(0), upto - s["first"] + 1)),
                       lambda p: p["text"].isNotNull())

        def build(part: Column) -> Column:
            pages = F.transform(part, lambda p: p["page"])
            body = F.array_join(F.transform(part, lambda p: p["text"]), GAP)
            lead = F.when(s["lead"] != "", s["lead"])
            return F.struct(
                F.concat_ws(GAP, lead, F.when(F.size(part) > 0, body)).alias("text"),
                F.coalesce(s["lead_first"], F.get(pages, F.lit(0))).alias("page_first"),
                F.least(s["lead_start"], F.array_min(pages)).alias("page_start"),
                F.greatest(s["lead_end"], F.array_max(pages)).alias("page_end"),
                sec.alias("section"))

        return let(own, build)

    def fields(size, at, first, lead, lf, ls, le, sec, chunks) -> Column:
        return F.struct(size.alias("size"), at.alias("at"), first.alias("first"), lead.alias("lead"),
                        lf.alias("lead_first"), ls.alias("lead_start"), le.alias("lead_end"),
                        sec.alias("sec"), chunks.alias("chunks"))

    def step(s: Column, p: Column) -> Column:
        at = s["at"] + 1
        sec = F.coalesce(p["sec"], s["sec"])
        n = F.length(p["text"])
        null_int = F.lit(None).cast("int")

        def emit(chunk: Column) -> Column:
            return let(overlap_tail(chunk["text"], overlap_chars), lambda ov: fields(
                F.when(ov != "", F.length(ov) + 2 + n).otherwise(n), at, at, ov,
                null_int, null_int, null_int, sec, F.concat(s["chunks"], F.array(chunk))))

        def keep(size: Column) -> Column:
            return fields(size, at, s["first"], s["lead"], s["lead_first"], s["lead_start"],
                          s["lead_end"], sec, s["chunks"])

        return (F.when(p["text"].isNull(), keep(s["size"]))
                .when((s["size"] > 0) & (s["size"] + n > max_chars),
                      let(open_chunk(s, s["at"], sec), emit))
                .otherwise(keep(F.when(s["size"] > 0, s["size"] + 2 + n).otherwise(n))))

    def finish(s: Column) -> Column:
        return F.struct(s["chunks"].alias("chunks"), open_chunk(s, s["at"], s["sec"]).alias("tail"))

    return fold_in_blocks(paras, start, "chunks", CHUNK, step, finish)


def close(packed: Column, min_chars: int, keep_short: bool = False) -> Column:
    """Finished chunks plus the open tail, if it is long enough."""
    floor = 1 if keep_short else max(1, min_chars)
    return F.when(F.length(packed["tail"]["text"]) >= floor,
                  F.concat(packed["chunks"], F.array(packed["tail"]))).otherwise(packed["chunks"])


def section_hierarchy(section: Column) -> Column:
    """``1.2.3 T`` to ``[1, 1.2, 1.2.3]``; an unnumbered section is itself."""
    numbered = pattern(fixed.NUMBERED_SECTION)

    def prefixes(parts: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))

    return (F.when(F.coalesce(section, F.lit("")) == "", F.array().cast("array<string>"))
            .when(section.rlike(numbered), let(F.split(F.regexp_extract(section, numbered, 1), r"\."), prefixes))
            .otherwise(F.array(section)))


def chunk_id(text: Column, page: Column, index: Column, doc_key: Column | None = None,
             prefix: str = fixed.GUIDELINE.lower()) -> Column:
    """``<prefix>_p<page>_<index>_<hash>``; with ``doc_key`` the document is part of it."""
    parts = [F.left(text, F.lit(100)), page.cast("string"), index.cast("string")]
    head = [F.lit(prefix)]
    if doc_key is not None:
        parts.append(doc_key.cast("string"))
        head.append(doc_key.cast("string"))
    digest = F.left(F.md5(F.concat_ws("_", *parts)), F.lit(8))
    padded = F.when(index < 10000, F.lpad(index.cast("string"), 4, "0")).otherwise(index.cast("string"))
    return F.concat_ws("_", *head, F.concat(F.lit("p"), page.cast("string")), padded, digest)
