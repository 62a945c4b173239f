"""Vector columns: deterministic text vectors, norms, cosine, embedding text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chunks import let
from .text import non_empty


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalise(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is.  ``v`` is bound first: it may be a costly expression."""
    return let(v, lambda u: let(norm(u), lambda n: F.when(n == 0, u.cast("array<double>")).otherwise(
        F.transform(u, lambda x: x.cast("double") / n))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda acc, x: acc + x)


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity, 0.0 if either norm is 0.  Pass norms computed once per row."""
    na, nb = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def text_vector(text: Column, dim: int = 768) -> Column:
    """Deterministic unit vector of a text, for tests and as default provider.

    The text is hashed once; each dimension hashes that digest with its number.
    """
    def component(digest: Column, i: Column) -> Column:
        head = F.left(F.md5(F.concat(digest, F.lit("#"), i.cast("string"))), F.lit(8))
        return F.conv(head, 16, 10).cast("double") / F.lit(2147483647.5) - F.lit(1.0)

    return normalise(let(F.md5(text), lambda d: F.transform(
        F.sequence(F.lit(1), F.lit(dim)), lambda i: component(d, i))))


def embedding_prefix(prefix: str = "") -> Column:
    """Labelled metadata line of a flat chunk row; empty fields are left out."""
    def field(name: str) -> Column:
        return non_empty(F.col(prefix + name))

    def listed(c: Column) -> Column:
        return F.replace(c, F.lit(","), F.lit(", "))

    def spaced(c: Column) -> Column:
        return F.replace(c, F.lit("_"), F.lit(" "))

    parts = [
        F.concat(F.lit("Cancer types: "), spaced(listed(field("cancer_types")))),
        F.concat(F.lit("Symptoms: "), spaced(listed(field("symptoms")))),
        F.concat(F.lit("Urgency: "), spaced(field("urgency"))),
        F.concat(F.lit("Actions: "), listed(field("actions"))),
        F.concat(F.lit("Investigations: "), F.upper(listed(field("investigations")))),
        F.concat(F.lit("Age criteria: "), field("age_thresholds")),
    ]
    return F.concat_ws(" | ", *parts)


def embedding_text(text: Column, prefix: Column, include_metadata: bool = True) -> Column:
    if not include_metadata:
        return text
    return F.when(prefix != "", F.concat(prefix, F.lit("\n\n"), text)).otherwise(text)
