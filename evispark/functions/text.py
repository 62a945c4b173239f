"""String columns with the whitespace, case and regex rules of Python text."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Unicode text treats as white space.
WHITESPACE = "".join(map(chr, [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
    *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def pattern(regex: str, flags: str = "") -> str:
    """Java pattern with Unicode classes and only ``\\n`` as line end."""
    return f"(?Ud{flags}){regex}"


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def words(col: Column) -> Column:
    """Tokens between runs of white space, none of them empty."""
    return F.array_remove(F.split(col, r"(?U)\s+"), "")


def contains_any(col: Column, terms: Iterable[str]) -> Column:
    """True if any term is a substring; stays in generated code (no lambda)."""
    return reduce(lambda a, b: a | b, (F.contains(col, F.lit(t)) for t in terms))


def contains_any_in(name: str, terms: Iterable[str]) -> Column:
    """The same for a column given by name, as one parsed expression."""
    return F.expr("(" + " or ".join(f"contains(`{name}`, {sql_text(t)})" for t in terms) + ")")


def matches_any(col: Column, regexes: Iterable[str], flags: str = "") -> Column:
    return col.rlike(pattern("|".join(f"(?:{r})" for r in regexes), flags))


def starts_with_any(col: Column, prefixes: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, (col.startswith(p) for p in prefixes))


def occurrences(col: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(col) - F.length(F.replace(col, F.lit(needle), F.lit(""))))
            / F.lit(len(needle))).cast("int")


def non_empty(col: Column) -> Column:
    """Null for null, empty string or empty array."""
    return F.when(F.length(col) > 0, col)


def label_lookup(col: Column, labels: dict[str, str]) -> Column:
    """Label for a key, the key itself when it has none."""
    pairs = [F.lit(x) for item in labels.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[col], col)


def sql_text(value: str) -> str:
    """A string as a literal of a SQL expression."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_array(values: Iterable[str]) -> Column:
    """One parsed expression: long lists would cost a call per entry otherwise."""
    return F.expr("cast(array(" + ", ".join(map(sql_text, values)) + ") as array<string>)")


def cut(col: Column, limit: int, tail: str = "...") -> Column:
    return F.when(F.length(col) > limit, F.concat(F.left(col, F.lit(limit)), F.lit(tail))).otherwise(col)
