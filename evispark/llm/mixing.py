"""Temperature mixing of sources: shares to a power, the power found by bisection, weights realised as permuted blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .common import is_small

SEED = 42
BLOCK_DOCS = 256
STEPS = 40
LEVELS = 4
#: Words: runs of anything but ASCII white space.
TOKEN = r"[^\x20\x09-\x0D]+"


def _mark(*parts: Column | str | int) -> Column:
    """32 bits of a digest of the parts as text; the same in any engine."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.left(F.md5(F.concat_ws("|", *texts)), F.lit(8)), 16, 10).cast("long")


def _figures(totals: DataFrame, tokens: int, exponents: list[float]) -> list[dict[str, float]]:
    """By exponent: sum of powers, entropy of the weights, and least and greatest weight per share; one pass over the sources."""
    share = F.col("tokens") / F.lit(tokens)
    sums = totals.where("tokens > 0").select(share.alias("q"), F.explode(F.array(*(F.lit(float(x)) for x in exponents))).alias("x"))
    power = F.pow("q", F.col("x"))
    rows = sums.groupBy("x").agg(F.sum(power).alias("z"), F.sum(power * F.ln("q")).alias("l"), F.max(F.pow("q", F.col("x") - 1)).alias("most"),
                                 F.min(F.pow("q", F.col("x") - 1)).alias("least")).collect()
    by = {r["x"]: r for r in rows}
    return [{"z": r["z"], "entropy": math.log(r["z"]) - x * r["l"] / r["z"], "most": r["most"], "least": r["least"]}
            for x in exponents for r in [by[float(x)]]]


def find_exponent(totals: DataFrame, tokens: int, entropy: float | None = None, repeats: float | None = None,
                  budget: int | None = None) -> float:
    """The exponent in [0, 1] nearest to 0 whose weights meet both targets, 1 if none does: 1 keeps the shares, 0 makes all
    sources equal.

    ``entropy``: at most so much of the greatest possible entropy.  ``repeats``: no source is read more often
    than so.  Both fall as the exponent rises, so ``STEPS`` halvings find it; the midpoints of ``LEVELS`` halvings are
    evaluated at once.
    """
    sources = totals.where("tokens > 0").count()
    if not sources:
        return 1.0

    def meets(f: dict[str, float]) -> bool:
        read = f["most"] / f["z"] * budget / tokens if budget is not None else f["most"] / f["least"]
        return (entropy is None or f["entropy"] <= entropy * math.log(sources)) and (repeats is None or read <= repeats)

    def midpoints(low: float, high: float, levels: int) -> list[float]:
        mid = (low + high) / 2
        return [mid] + (midpoints(low, mid, levels - 1) + midpoints(mid, high, levels - 1) if levels > 1 else [])
    if meets(_figures(totals, tokens, [0.0])[0]):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(0, STEPS, LEVELS):
        points = midpoints(low, high, LEVELS)
        known = dict(zip(points, _figures(totals, tokens, points)))
        for _ in range(LEVELS):
            mid = (low + high) / 2
            low, high = (low, mid) if meets(known[mid]) else (mid, high)
    return high


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
        entropy: float | None = None, repeats: float | None = 2.0, budget: int | None = None, block_docs: int = BLOCK_DOCS,
        seed: int = SEED) -> DataFrame:
    """The mixed order, a row per reading of a document: ``id``, ``source``, ``epoch``, ``block``, ``tokens``, ``at``, ``weight``.

    A source's weight is its share of all tokens to the power of ``find_exponent``, normalised.  Its
    weight of ``budget`` tokens is read as whole epochs and a part of one.  An epoch deals the source's blocks (about
    ``block_docs`` documents, by a digest of id and text) in an order of its own, and the documents of a block too;
    the part of an epoch ends before the document that would pass the budget.  ``at`` is how much of its source's
    tokens is read before: ordered by ``at``, every stretch has the sources in their weights.
    Without a ``budget`` it is the least that reads every document at least once.  Documents of sources without tokens
    are read once, with weight 0.

    Sums run over the documents of a block, the blocks of a super-block (about the root of a source's blocks) and its
    super-blocks, so no task gets a whole source.  Null texts have no tokens, null sources are a
    source of their own, null ids and repeated rows (the same id and text: one block) are dealt like others; an
    empty table gives an empty one.  Other columns are not read.
    """
    source = F.col(source_column).cast("string")
    text = F.coalesce(F.col(text_column), F.lit(""))
    counted = docs.select(F.col(id_column).alias("id"), source.alias("source"),
                          F.regexp_count(text, F.lit(TOKEN)).cast("long").alias("tokens"),
                          _mark(seed, F.col(id_column), F.md5(text)).alias("mark"))
    counted = checkpointed(counted.select("id", "source", F.concat_ws(":", F.col("source").isNull().cast("string"), "source").alias("group"),
                                          "tokens", "mark"))
    totals = checkpointed(counted.groupBy("group").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")))
    all_tokens = totals.agg(F.sum("tokens")).first()[0] or 0
    exponent = find_exponent(totals, all_tokens, entropy, repeats, budget) if all_tokens else 1.0
    figures = _figures(totals, all_tokens, [exponent])[0] if all_tokens else {"z": 1.0, "least": 1.0}
    whole = all_tokens * figures["z"] / figures["least"] if budget is None else float(budget)

    share = F.col("tokens") / F.lit(max(all_tokens, 1))
    weight = F.when(F.col("tokens") > 0, F.pow(share, F.lit(exponent)) / F.lit(figures["z"])).otherwise(0.0)
    reads = F.when(F.col("tokens") > 0, F.round(weight * F.lit(whole) / F.col("tokens"), 6)).otherwise(1.0)
    plan = totals.select("group", "tokens", weight.alias("weight"), reads.alias("reads"),
                         F.ceil(F.col("docs") / F.lit(block_docs)).alias("blocks"))
    plan = checkpointed(plan.select(
        F.col("group").alias("plan_group"), F.col("tokens").alias("source_tokens"), "weight", "reads", "blocks",
        F.ceil(F.sqrt("blocks")).alias("supers"), F.floor("reads").alias("full"),
        F.round((F.col("reads") - F.floor("reads")) * F.col("tokens")).cast("long").alias("rest")))
    small = F.broadcast(plan) if is_small(plan, 256) else plan
    dealt = counted.join(small, F.col("group") == F.col("plan_group")).select(
        "id", "source", "group", "tokens", "mark", F.pmod("mark", "blocks").alias("block"), "weight", "reads", "full", "rest", "supers",
        "source_tokens")
    dealt = checkpointed(dealt)

    blocks = dealt.groupBy("group", "block").agg(F.sum("tokens").alias("block_tokens"), *(
        F.first(c).alias(c) for c in ("full", "rest", "supers", "source_tokens")))
    last = F.when(F.col("rest") > 0, F.col("full")).otherwise(F.col("full") - 1)
    blocks = blocks.where(last >= 0).select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("epoch"))
    blocks = blocks.select("*", _mark(seed, F.col("epoch"), F.col("group"), F.col("block")).alias("turn"))
    blocks = blocks.withColumn("super", F.floor(F.col("turn") * F.col("supers") / F.lit(1 << 32)))
    inner = Window.partitionBy("group", "epoch", "super").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("within", F.coalesce(F.sum("block_tokens").over(inner), F.lit(0)))
    supers = blocks.groupBy("group", "epoch", "super").agg(F.sum("block_tokens").alias("super_tokens"))
    outer = Window.partitionBy("group", "epoch").orderBy("super").rowsBetween(Window.unboundedPreceding, -1)
    supers = supers.select("group", "epoch", "super", F.coalesce(F.sum("super_tokens").over(outer), F.lit(0)).alias("ahead"))
    blocks = blocks.join(supers, ["group", "epoch", "super"])
    blocks = checkpointed(blocks.select("group", "block", "epoch", (F.col("ahead") + F.col("within")).alias("begin")))

    readings = dealt.join(blocks, ["group", "block"])
    own = Window.partitionBy("group", "block", "epoch").orderBy("turn", "mark", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    readings = readings.withColumn("turn", _mark(seed, F.col("epoch"), F.col("mark")))
    readings = readings.withColumn("begin", F.col("begin") + F.coalesce(F.sum("tokens").over(own), F.lit(0)))
    readings = readings.where((F.col("epoch") < F.col("full")) | (F.col("begin") + F.col("tokens") <= F.col("rest")))
    total = F.greatest(F.col("reads") * F.col("source_tokens"), F.lit(1.0))
    return readings.select("id", "source", "epoch", "block", "tokens", F.round(
        F.least((F.col("epoch") * F.col("source_tokens") + F.col("begin")) / total, F.lit(1.0)), 6).alias("at"), F.round("weight", 6).alias("weight"))
