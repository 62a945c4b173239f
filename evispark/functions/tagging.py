"""Text to metadata columns: lexicon tags, patterns, content type, density.

Every function maps a text column to a column, so tagging is one projection:
no shuffle, no Python.  Lexicon tests are ``contains`` calls rather than
lambdas, so the lower-cased text is evaluated once per row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from .text import contains_any, contains_any_in, matches_any, pattern, sql_text


def normalise_term(term: str) -> str:
    return term.replace(" ", "_").replace("-", "_")


def guarded_match(col: Column, regexes: Sequence[str], flags: str = "") -> Column:
    """``rlike`` on any of the patterns, tried only where a word they need occurs.

    ``contains`` is many times cheaper than a regex, and most rows fail it.  A pattern
    with groups, alternatives, counts or other case has no word it surely needs.
    """
    needed = []
    for regex in regexes:
        plain = re.sub(r"\[[^\]]*\][?*+]?|\\[A-Za-z][?*+]?|.[?*]", " ", regex)
        runs = re.findall(r"[A-Za-z]{3,}", plain)
        if not runs or "i" in flags or any(c in regex for c in "|({"):
            return matches_any(col, regexes, flags)
        needed.append(max(runs, key=len))
    return contains_any(col, sorted(set(needed))) & matches_any(col, regexes, flags)


def lexicon_tags(low: str, terms: Sequence[str], word_boundary: bool = False) -> Column:
    """Normalised terms found in a lower-cased text column, in lexicon order, distinct."""
    return F.array_distinct(found_terms(low, terms, word_boundary))


def found_terms(low: str, terms: Sequence[str], word_boundary: bool = False) -> Column:
    """The same with an entry for every term that is found, also where two have one normal form.

    ``low`` is a column name: the whole list is one parsed expression, not a call per term.
    """
    shared = Counter(w for t in terms for w in t.split())

    def found(term: str) -> str:
        hit = f"contains(`{low}`, {sql_text(term)})"
        if word_boundary:
            regex = pattern(r"(?<!\w)\Q" + term + r"\E(?!\w)")
            return f"{hit} and rlike(`{low}`, {sql_text(regex)})"
        # A word several terms share ("cancer", "pain") is looked up once and rules them all out.
        word = max(term.split(), key=lambda w: shared[w])
        return f"contains(`{low}`, {sql_text(word)}) and {hit}" if word != term and shared[word] > 2 else hit

    cases = ", ".join(f"case when {found(t)} then {sql_text(normalise_term(t))} end" for t in terms)
    return F.expr(f"array_compact(array({cases}))")


def age_thresholds(text: Column) -> Column:
    """``N+`` or ``<N`` for every number followed by a direction, first seen first."""
    regex = F.lit(pattern(fixed.AGE_PATTERN, "i"))
    upward = [F.lit(w) for w in fixed.AGE_UPWARD]
    return F.array_distinct(F.zip_with(
        F.regexp_extract_all(text, regex, 1), F.regexp_extract_all(text, regex, 2),
        lambda n, d: F.when(F.lower(d).isin(*upward), F.concat(n, F.lit("+")))
                      .otherwise(F.concat(F.lit("<"), n))))


def timeframes(text: Column) -> Column:
    regex = F.lit(pattern(fixed.TIMEFRAME_PATTERN, "i"))
    return F.array_distinct(F.zip_with(
        F.regexp_extract_all(text, regex, 1), F.regexp_extract_all(text, regex, 2),
        lambda n, unit: F.concat(n, F.lit("_"), F.lower(unit))))


def urgency(low: Column, patterns: dict[str, list[str]] | None = None, strict: bool = True) -> Column:
    """First level any pattern of which matches, else ``unknown``.

    ``strict=False`` leaves out two readings the plain patterns allow: "12 weeks"
    as "2 weeks" and "non-urgent referral" as "urgent referral".
    """
    patterns = patterns or fixed.URGENCY_PATTERNS
    if not strict:
        guard = {r"2[\s\-]?week": r"(?<!\d)2[\s\-]?week",
                 r"urgent\s+referral": r"(?<!non-)(?<!non )(?<!non)urgent\s+referral"}
        patterns = {k: [guard.get(p, p) for p in v] for k, v in patterns.items()}
    levels = list(patterns.items())
    out = F.when(guarded_match(low, levels[0][1]), F.lit(levels[0][0]))
    for level, regexes in levels[1:]:
        out = out.when(guarded_match(low, regexes), F.lit(level))
    return out.otherwise(F.lit("unknown"))


def actions(text: Column, patterns: dict[str, str] | None = None) -> Column:
    """Case-sensitive action words, in fixed order."""
    patterns = patterns or fixed.ACTION_PATTERNS
    return F.array_compact(F.array(*[
        F.when(guarded_match(text, [p]), F.lit(name)) for name, p in patterns.items()]))


def content_type(text: Column, low: str) -> Column:
    return (
        F.when(contains_any_in(low, fixed.RECOMMENDATION_HINTS)
               & text.rlike(pattern(fixed.PARAGRAPH_RECOMMENDATION, "mi")), "recommendation")
        .when(F.contains(text, F.lit("|")) & text.rlike(pattern(fixed.CHUNK_TABLE_ROW, "m")), "table")
        .when(contains_any_in(low, fixed.CRITERIA_PHRASES), "criteria")
        .when(contains_any_in(low, fixed.BACKGROUND_PHRASES), "background")
        .when(contains_any_in(low, fixed.DEFINITION_PHRASES), "definition")
        .otherwise("content"))


def density(text: Column, low: str, terms: Sequence[str] | None = None) -> Column:
    """Distinct lexicon terms per 100 characters, at most 1."""
    terms = terms or [*fixed.CANCER_TYPES, *fixed.SYMPTOMS, *fixed.INVESTIGATIONS]
    return _per_hundred(F.expr(" + ".join(f"cast(contains(`{low}`, {sql_text(t)}) as int)" for t in terms)), text)


def density_of(text: Column, found: Sequence[str]) -> Column:
    """The same from columns of ``found_terms``, which have looked the terms up already."""
    return _per_hundred(F.when(text.isNotNull(), sum((F.size(c) for c in found), F.lit(0))), text)


def _per_hundred(count: Column, text: Column) -> Column:
    return F.least(F.lit(1.0), count / (F.greatest(F.length(text), F.lit(1)) / F.lit(100.0)))


def token_estimate(text: Column, chars_per_token: float = 4.0) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / F.lit(float(chars_per_token))).cast("int"))


def token_floor(text: Column) -> Column:
    """Estimate without the minimum of one, as used for batching."""
    return F.floor(F.length(text) / F.lit(4)).cast("int")


def tag_fields(text: str = "text", lexicons: dict[str, Sequence[str]] | None = None,
               low: str = "text_lower", strict: bool = True) -> dict[str, Column]:
    lex = {"cancer_types": fixed.CANCER_TYPES, "symptoms": fixed.SYMPTOMS,
           "risk_factors": fixed.RISK_FACTORS, "investigations": fixed.INVESTIGATIONS,
           **(lexicons or {})}
    t, lo = F.col(text), F.col(low)
    return {
        "cancer_types": lexicon_tags(low, lex["cancer_types"]),
        "symptoms": lexicon_tags(low, lex["symptoms"]),
        "age_thresholds": age_thresholds(t),
        "timeframes": timeframes(t),
        "urgency": urgency(lo, strict=strict),
        "actions": actions(t),
        "risk_factors": lexicon_tags(low, lex["risk_factors"]),
        "investigations": lexicon_tags(low, lex["investigations"]),
    }


def tag(df: DataFrame, text: str = "text", lexicons: dict[str, Sequence[str]] | None = None,
        strict: bool = True) -> DataFrame:
    """Append all tag columns of a text column in one projection."""
    lowered = df.withColumn("text_lower", F.lower(text))
    return lowered.withColumns(tag_fields(text, lexicons, strict=strict)).drop("text_lower")


def flags(df: DataFrame) -> DataFrame:
    """The three boolean flags that follow from content type and urgency."""
    return df.withColumns({
        "has_recommendation": F.col("content_type") == "recommendation",
        "has_table": F.col("content_type") == "table",
        "is_urgent": F.col("urgency").isin("urgent", "urgent_2_week"),
    })


def parse_tag_field(col: Column) -> Column:
    """Comma string to distinct trimmed lower-case tags."""
    from .text import strip
    return F.array_distinct(F.filter(
        F.transform(F.split(F.coalesce(col, F.lit("")), ","), lambda x: F.lower(strip(x))),
        lambda x: x != ""))
