"""Row checks as data: every rule is a name and the condition that breaks it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEXES = ["male", "female", "other", "m", "f"]   # fixed values, compared in lower case


def between(name: str, low: float, high: float) -> Column:
    return (F.col(name) < low) | (F.col(name) > high)


def length_between(name: str, low: int, high: int) -> Column:
    n = F.coalesce(F.length(F.col(name)), F.lit(0))
    return (n < low) | (n > high)


# Limits of the request and response fields.
RULES = {
    "patient": {"age_range": lambda: between("age", 0, 120),
                "sex_known": lambda: F.col("sex").isNotNull() & ~F.lower("sex").isin(*SEXES)},
    "quick": {"symptoms_required": lambda: F.coalesce(F.size("symptoms"), F.lit(0)) < 1,
              "age_range": lambda: between("age", 0, 120)},
    "chat": {"message_length": lambda: length_between("message", 1, 5000)},
    "search": {"query_length": lambda: length_between("query", 1, 1000), "top_k_range": lambda: between("top_k", 1, 20)},
    "extract": {"text_length": lambda: length_between("text", 10, 10000)},
    "feedback": {"rating_range": lambda: between("rating", 1, 5)},
    "assessment": {"confidence_range": lambda: between("confidence", 0.0, 1.0)},
}


def check(df: DataFrame, rules: dict) -> DataFrame:
    """Add ``violations``: names of broken rules, in rule order (null fields break none)."""
    named = [F.when(F.coalesce(broken(), F.lit(False)), F.lit(name)) for name, broken in rules.items()]
    return df.withColumn("violations", F.array_compact(F.array(*named)))


def split(df: DataFrame, rules: dict) -> tuple[DataFrame, DataFrame]:
    """Accepted and quarantined rows."""
    checked = check(df, rules)
    ok = F.size("violations") == 0
    return checked.where(ok).drop("violations"), checked.where(~ok)


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Fill missing columns and nulls with typed defaults."""
    def value(name: str, default: object) -> Column:
        lit = F.lit(default)
        return F.coalesce(F.col(name), lit) if name in df.columns else lit
    return df.withColumns({n: value(n, d) for n, d in defaults.items()})
