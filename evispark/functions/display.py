"""Citation strings, labels and snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .text import cut, label_lookup, words


def page_reference(start: Column, end: Column) -> Column:
    return F.when(start == end, F.concat(F.lit("p."), start.cast("string"))).otherwise(
        F.concat(F.lit("pp."), start.cast("string"), F.lit("-"), end.cast("string")))


def citation(start: Column, end: Column, hierarchy: Column, section: Column,
             label: str = fixed.GUIDELINE) -> Column:
    """``[label Section 1.4.1, p.22]`` of a flat row: hierarchy, else first word of the section."""
    page = page_reference(start, end)
    last = F.element_at(F.split(hierarchy, r"\|"), -1)
    return (F.when(F.coalesce(hierarchy, F.lit("")) != "",
                   F.concat(F.lit(f"[{label} Section "), last, F.lit(", "), page, F.lit("]")))
            .when(F.coalesce(section, F.lit("")) != "",
                  F.concat(F.lit(f"[{label} "), F.get(words(section), F.lit(0)), F.lit(", "), page, F.lit("]")))
            .otherwise(F.concat(F.lit(f"[{label} "), page, F.lit("]"))))


def chunk_citation(start: Column, section: Column, label: str = fixed.GUIDELINE) -> Column:
    """Citation of a freshly cut chunk: whole section text and first page."""
    page = F.concat(F.lit("p."), start.cast("string"), F.lit("]"))
    return F.when(F.coalesce(section, F.lit("")) != "",
                  F.concat(F.lit(f"[{label} Section "), section, F.lit(", "), page)
                  ).otherwise(F.concat(F.lit(f"[{label} "), page))


def urgency_label(col: Column, labels: dict[str, str] | None = None) -> Column:
    return label_lookup(col, labels or fixed.HIT_URGENCY_LABELS)


def snippet(text: Column, limit: int = 500) -> Column:
    return cut(text, limit)
