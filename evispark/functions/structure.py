"""Page structure as column functions: page split, headers, tables, types, titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .chunks import fold_in_blocks, let
from .text import occurrences, pattern, starts_with_any, strip

LENGTH_BLOCK = 1 << 16


def split_by_marker(text: Column) -> Column:
    """``array<struct<page_number, markdown>>`` from page markers.

    Text before the first marker belongs to no page; an unnumbered marker takes
    its 1-based position.  Meaningful only with two markers or more.
    """
    regex = pattern(fixed.PAGE_MARKER, "m")
    split = F.split(text, regex)
    pieces = F.slice(split, F.lit(2), F.greatest(F.lit(0), F.size(split) - 1))
    numbers = F.regexp_extract_all(text, F.lit(regex), 1)
    numbered = F.transform(numbers, lambda n, i: F.coalesce(
        n.try_cast("int"), (i + 1).cast("int")))
    return F.zip_with(numbered, pieces, lambda n, p: F.struct(
        n.alias("page_number"), strip(p).alias("markdown")))


def marker_count(text: Column) -> Column:
    return F.size(F.split(text, pattern(fixed.PAGE_MARKER, "m"))) - 1


def split_by_length(text: Column, chars_per_page: int = fixed.CHARS_PER_PAGE) -> Column:
    """Pages of about ``chars_per_page``, cut at a blank line near the target.

    The text is cut into blocks first and a step looks at two of them, as finding a place in a text takes
    as long as the text before it.
    """
    block = max(LENGTH_BLOCK, 4 * chars_per_page)

    def pages(known: Column) -> Column:
        size, step, parts = known["size"], known["step"], known["parts"]

        def advance(state: Column, _step: Column) -> Column:
            at = F.floor(state["pos"] / F.lit(block)).cast("int")
            near = F.struct(F.concat(F.get(parts, at), F.coalesce(F.get(parts, at + 1), F.lit(""))).alias("text"),
                            (at * block).alias("before"), F.least(state["pos"] + step, size).alias("target"))

            def cut(w: Column) -> Column:
                before, target = w["before"], w["target"]
                blank = F.position(F.lit("\n\n"), w["text"], F.greatest(F.lit(1), target - 199 - before)) - 1 + before

                def ended(found: Column) -> Column:
                    near_target = (target < size) & (found >= target - 200) & (found >= before) & (found <= target + 198)
                    return F.when(near_target, found).otherwise(target).cast("int")
                return let(let(blank, ended), lambda end: F.struct(
                    end.alias("end"), strip(F.substring(w["text"], state["pos"] - before + 1, end - state["pos"])).alias("piece")))
            return F.when(state["pos"] < size, let(let(near, cut), lambda c: F.struct(
                c["end"].alias("pos"), F.when(F.length(c["piece"]) > 0, F.concat(state["pages"], F.array(c["piece"])))
                .otherwise(state["pages"]).alias("pages")))).otherwise(state)

        # A cut moves back at most 200 characters, so this many steps always reach the end.
        steps = F.floor(size / F.lit(max(1, chars_per_page - 200))).cast("int") + F.lit(2)
        return fold_in_blocks(F.sequence(F.lit(1), steps), {"pos": F.lit(0)}, "pages", "string", advance, lambda s: F.transform(
            s["pages"], lambda p, i: F.struct((i + 1).cast("int").alias("page_number"), p.alias("markdown"))))

    # What every step needs is worked out once and bound.
    return let(F.length(text), lambda size: let(F.struct(
        size.alias("size"), F.floor(size / F.greatest(F.lit(1), F.floor(size / F.lit(chars_per_page)))).cast("int").alias("step"),
        F.transform(F.sequence(F.lit(0), F.floor(size / F.lit(block)).cast("int")),
                    lambda i: F.substring(text, i * block + 1, F.lit(block))).alias("parts")), pages))


def split_pages(text: Column) -> Column:
    """Marker split where two or more markers exist, length split otherwise."""
    return F.when(marker_count(text) > 1, split_by_marker(text)).otherwise(split_by_length(text))


def to_markdown(text: Column) -> Column:
    """Plain text lines to Markdown: headers, bullets, recommendations."""
    header = pattern(fixed.LINE_SECTION)

    def line(s: Column) -> Column:
        number, title = F.regexp_extract(s, header, 1), F.regexp_extract(s, header, 2)
        level = F.least(occurrences(number, ".") + 2, F.lit(4))
        return (
            F.when(s == "", F.lit(""))
            .when(s.rlike(header), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), number, F.lit(" "), title))
            .when(starts_with_any(s, fixed.BULLETS),
                  F.concat(F.lit("- "), strip(F.substring(s, 2, 2**31 - 1))))
            .when(s.rlike(pattern(r"^" + fixed.LINE_RECOMMENDATION, "i")), F.concat(F.lit("> **"), s, F.lit("**")))
            .otherwise(s))

    return F.array_join(F.transform(F.transform(F.split(text, "\n"), strip), line), "\n")


def sections(text: Column) -> Column:
    """Numbered Markdown headers; only where there are none, raw numbered titles."""
    def pairs(regex: str, number: int, title: int) -> Column:
        rx = F.lit(pattern(regex, "m"))
        return F.zip_with(F.regexp_extract_all(text, rx, number), F.regexp_extract_all(text, rx, title),
                          lambda n, t: F.concat(n, F.lit(" "), strip(t)))

    return F.when(text.rlike(pattern(fixed.SECTION_HEADER, "m")), pairs(fixed.SECTION_HEADER, 2, 3)
                  ).otherwise(pairs(fixed.RAW_SECTION, 1, 2))


def has_tables(markdown: Column) -> Column:
    return markdown.rlike(pattern(fixed.PAGE_TABLE_ROW))


def has_tables_plain(text: Column) -> Column:
    """Table hint in extracted plain text: two tabs in a line, or a box rule."""
    return text.rlike(pattern(r"\t.*\t")) | F.contains(text, F.lit("│"))


def page_type(text: Column, page_number: Column, total_pages: Column | int = 50) -> Column:
    total = F.lit(total_pages) if isinstance(total_pages, int) else total_pages
    low = F.lower(text)
    leaders = (occurrences(low, "...") > 3) | (occurrences(low, ". . .") > 3)
    head = F.lower(F.left(text, F.lit(500)))
    top = F.lower(F.left(text, F.lit(200)))
    return (
        F.when(page_number <= 2, "frontmatter")
        .when(F.contains(head, F.lit("contents")) & (page_number < 10) & leaders, "toc")
        .when(F.contains(top, F.lit("appendix")), "appendix")
        .when((page_number > total - 5) & F.contains(top, F.lit("reference")), "references")
        .otherwise("content"))


def title(markdown: Column, metadata_title: Column | None = None) -> Column:
    """Metadata title, first H1, recognised title in the opening, default."""
    h1 = pattern(r"^#\s+(.+)$", "m")
    return F.coalesce(
        metadata_title if metadata_title is not None else F.lit(None).cast("string"),
        F.when(markdown.rlike(h1), strip(F.regexp_extract(markdown, h1, 1))),
        F.when(F.left(markdown, F.lit(2000)).rlike(pattern(fixed.TITLE_PATTERN, "i")), F.lit(fixed.TITLE_RECOGNISED)),
        F.lit(fixed.TITLE_DEFAULT))


def title_from_text(text: Column) -> Column:
    """First of the opening 15 lines that reads like the guideline's title."""
    lines = F.transform(F.slice(F.split(strip(text), "\n"), 1, 15), strip)
    fits = F.filter(lines, lambda s: (F.length(s) > 10) & (F.length(s) < 200)
                    & ~starts_with_any(s, fixed.TITLE_SKIP_PREFIXES)
                    & (F.contains(F.lower(s), F.lit("cancer")) | F.contains(s, F.lit(fixed.GUIDELINE))))
    return F.coalesce(F.get(fits, F.lit(0)), F.lit(fixed.TITLE_DEFAULT))
