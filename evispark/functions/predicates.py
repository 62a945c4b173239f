"""Metadata filters as Spark predicates, so they reach the scan."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {
    "$eq": lambda c, v: c == v,
    "$lte": lambda c, v: c <= v,
    "$gte": lambda c, v: c >= v,
    "$contains": lambda c, v: F.contains(c.cast("string"), F.lit(v)),
}


def compile_filter(where: dict[str, Any] | None, columns: list[str]) -> Column:
    """Filter dictionary to a predicate.

    Sibling keys are combined with AND; an unknown field matches nothing; an
    unknown operator is an error.
    """
    def field(name: str, value: Any) -> Column:
        if name not in columns:
            return F.lit(False)
        if not isinstance(value, dict):
            return F.col(name) == value
        unknown = set(value) - set(_COMPARE)
        if unknown:
            raise ValueError(f"unknown filter operator: {sorted(unknown)}")
        return reduce(and_, (_COMPARE[op](F.col(name), v) for op, v in value.items()))

    def one(key: str, value: Any) -> Column:
        if key == "$and":
            return reduce(and_, (compile_filter(v, columns) for v in value))
        if key == "$or":
            return reduce(or_, (compile_filter(v, columns) for v in value))
        if key.startswith("$"):
            raise ValueError(f"unknown filter operator: {key}")
        return field(key, value)

    return reduce(and_, (one(k, v) for k, v in (where or {}).items()), F.lit(True))


def clinical_filter(cancer_type: str | None = None, urgency: str | None = None, is_urgent: bool | None = None,
                    has_recommendation: bool | None = None, symptom: str | None = None,
                    investigation: str | None = None, has_table: bool | None = None,
                    content_type: str | None = None) -> dict[str, Any] | None:
    """Filter dictionary from optional conditions; None if there is none."""
    conditions: list[dict[str, Any]] = []
    for name, value in (("cancer_types", cancer_type), ("symptoms", symptom), ("investigations", investigation)):
        if value:
            conditions.append({name: {"$contains": value}})
    for name, value in (("urgency", urgency or None), ("is_urgent", is_urgent), ("has_table", has_table),
                        ("has_recommendation", has_recommendation), ("content_type", content_type or None)):
        if value is not None:
            conditions.append({name: value})
    return None if not conditions else conditions[0] if len(conditions) == 1 else {"$and": conditions}
