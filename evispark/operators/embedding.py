"""Attaching vectors: token-aware batches around a pluggable provider."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed
from ..functions.tagging import token_floor
from ..functions.vectors import text_vector
from ..session import checkpointed, small_batches

# texts, mode ("document" or "query") -> one vector per text
Provider = Callable[[list[str], str], list[list[float]]]


def batch_starts(tokens: list[int], limit: int) -> list[int]:
    """Where a batch has to start so that no batch exceeds ``limit`` tokens."""
    starts, total = [], 0
    for i, n in enumerate(tokens):
        if not starts or total + n > limit:
            starts.append(i)
            total = 0
        total += n
    return starts


def attach(df: DataFrame, text: str = "embedding_text", provider: Provider | None = None, mode: str = "document",
           dim: int = 768, max_tokens: int = fixed.MAX_TOKENS_PER_BATCH) -> DataFrame:
    """Add ``embedding`` and ``embedding_error``.

    Without a provider the deterministic text vector is used (no Python).  With one,
    it is called per token-limited batch of an Arrow batch of a few megabytes; a failed
    batch keeps its rows, with the error instead of a vector.
    """
    if provider is None:
        return df.withColumns({"embedding": text_vector(F.col(text), dim), "embedding_error": F.lit(None).cast("string")})
    small_batches(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType())),
                           T.StructField("embedding_error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b[text].tolist()
            starts = batch_starts([len(t or "") // 4 for t in texts], max_tokens)
            vectors, errors = [], []
            for lo, hi in zip(starts, [*starts[1:], len(texts)]):
                try:
                    vectors += [list(map(float, v)) for v in provider(texts[lo:hi], mode)]
                    errors += [None] * (hi - lo)
                except Exception as problem:   # the provider is foreign code: keep the rows, report
                    vectors += [None] * (hi - lo)
                    errors += [f"{type(problem).__name__}: {problem}"] * (hi - lo)
            b["embedding"] = pd.Series(vectors, index=b.index, dtype=object)
            b["embedding_error"] = pd.Series(errors, index=b.index, dtype=object)
            yield b

    return df.mapInPandas(run, schema)


def token_batches(df: DataFrame, key: str, order: str, text: str = "text", limit: int = fixed.MAX_TOKENS_PER_BATCH,
                  span: int = 4096) -> DataFrame:
    """Batch number of every row, greedy in order within ``key``, as one pass over the key would give.

    A key's rows are folded in parts of ``span`` positions, all at once.  A part needs the tokens of the batch that is
    open where it begins: parts start from a guess, and only those whose guess was wrong are folded again, until
    none is.  Only two numbers per part take part in that; the rows stay where they are.
    """
    rows = checkpointed(df.select(key, F.floor(F.col(order) / span).alias("part"), F.struct(
        F.col(order).cast("long").alias("o"), token_floor(F.col(text)).cast("long").alias("n")).alias("r")).groupBy(key, "part").agg(
        F.array_sort(F.collect_list("r")).alias("rows")))
    place = Window.partitionBy(key).orderBy("part")

    def step(s: Column, r: Column) -> Column:
        cut = (s["open"] >= 0) & (s["open"] + r["n"] > limit)
        return F.struct(F.when(cut | (s["open"] < 0), r["n"]).otherwise(s["open"] + r["n"]).alias("open"),
                        F.when(cut, F.concat(s["cuts"], F.array(r["o"]))).otherwise(s["cuts"]).alias("cuts"))

    def folded(parts: DataFrame) -> DataFrame:
        begin = F.struct(F.col("begins").alias("open"), F.expr("cast(array() as array<bigint>)").alias("cuts"))
        return parts.withColumn("f", F.aggregate("rows", begin, step)).select(
            key, "part", "begins", F.col("f.open").alias("ends"), F.col("f.cuts").alias("cuts"))

    # -1: no batch is open yet; only right for a key's first part, a guess elsewhere
    state = checkpointed(folded(rows.withColumn("begins", F.lit(-1).cast("long"))))
    while True:
        asked = state.withColumn("wanted", F.coalesce(F.lag("ends").over(place), F.lit(-1).cast("long")))
        wrong = checkpointed(asked.where("wanted <> begins").select(F.col(key).alias("_key"), F.col("part").alias("_part"), "wanted"))
        if wrong.isEmpty():
            break
        met = F.col(key).eqNullSafe(F.col("_key")) & (F.col("part") == F.col("_part"))
        again = folded(rows.join(wrong, met).withColumn("begins", F.col("wanted")))
        state = checkpointed(state.join(wrong, met, "left_anti").unionByName(again))
    base = place.rowsBetween(Window.unboundedPreceding, -1)
    numbered = state.select(F.col(key).alias("_key"), F.col("part").alias("_part"), "cuts", F.coalesce(
        F.sum(F.size("cuts")).over(base), F.lit(0)).alias("base"))
    inside = Window.partitionBy(key, "part").orderBy("o")
    each = rows.join(numbered, F.col(key).eqNullSafe(F.col("_key")) & (F.col("part") == F.col("_part"))).select(
        key, "part", "base", "cuts", F.inline("rows"))
    return each.select(key, F.col("o").alias(order), (F.col("base") + F.sum(
        F.array_contains("cuts", F.col("o")).cast("int")).over(inside)).cast("long").alias("batch"), F.col("n").alias("tokens"))
