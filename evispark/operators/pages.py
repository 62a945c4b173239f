"""Documents to pages, section listings, and the document profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import structure as S
from ..functions.text import occurrences


def to_pages(docs: DataFrame, text: str = "text", doc: str = "doc_id", total_pages: int = 50) -> DataFrame:
    """One row per page, with sections, table flag and type.  Row-local until the explode."""
    split = docs.select(doc, S.split_pages(F.col(text)).alias("_pages"))
    # Outer, so the optimizer does not evaluate the split again in a pushed-down filter.
    pages = split.select(doc, F.posexplode_outer("_pages").alias("page_ordinal", "p")).where(F.col("p").isNotNull())
    md = F.col("p.markdown")
    return pages.select(doc, "page_ordinal", F.col("p.page_number").alias("page_number"), md.alias("markdown"),
                        S.sections(md).alias("sections"), S.has_tables(md).alias("has_tables"),
                        S.page_type(md, F.col("p.page_number"), total_pages).alias("content_type"))


def plain_pages(pages: DataFrame, text: str = "text", doc: str = "doc_id", total_pages: str | None = None) -> DataFrame:
    """Extracted plain-text pages to Markdown pages.

    The number of pages per document is an aggregate joined back on the document.
    """
    if total_pages is None:
        counts = pages.groupBy(doc).agg(F.max("page_number").alias("_total"))
        pages, total_pages = pages.join(counts, doc), "_total"
    md = pages.withColumns({"markdown": S.to_markdown(F.col(text)), "has_tables": S.has_tables_plain(F.col(text))})
    return md.select(doc, "page_number", "markdown", S.sections(F.col("markdown")).alias("sections"), "has_tables",
                     S.page_type(F.col("markdown"), F.col("page_number"), F.col(total_pages)).alias("content_type"))


def content_pages(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("content_type") == "content")


def section_listing(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    return pages.select(doc, "page_number", F.explode("sections").alias("section"))


def profile(pages: DataFrame, doc: str = "doc_id", terms: list[str] | None = None) -> DataFrame:
    """Counts and readiness per document, combined before the shuffle."""
    terms = terms or fixed.PROFILE_TERMS
    low = F.lower("markdown")
    as_int = lambda c: c.cast("int")
    by_type = {f"{t}_pages": F.sum(as_int(F.col("content_type") == t))
               for t in ("content", "frontmatter", "toc", "appendix", "references")}
    marks = {"pages_with_tables": F.sum(as_int(F.col("has_tables"))),
             "markdown_tables": F.sum(as_int(F.contains("markdown", F.lit("|")) & F.contains("markdown", F.lit("---")))),
             "sections": F.sum(F.size("sections")), "chars": F.sum(F.length("markdown"))}
    counts = {"n_" + t.replace(" ", "_"): F.sum(occurrences(F.col("_low"), t)) for t in terms}
    out = pages.withColumn("_low", low).groupBy(doc).agg(
        F.count(F.lit(1)).alias("pages"), *[c.alias(n) for n, c in {**by_type, **marks, **counts}.items()])
    refer = F.col("n_refer") if "refer" in terms else F.lit(0)
    return out.withColumn("ready", (F.col("content_pages") > 0) & (F.col("sections") > 0)
                          & (F.col("chars") > 10000) & (refer > 0))
