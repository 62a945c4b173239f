"""Benchmark decontamination: a prefix-filtered join of shingles, verified on windows of item size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .common import fits, is_small, same, words

WINDOW = 10
SHINGLE = 5


def _shingles(words_column: str, size: int) -> Column:
    """Hash of each run of ``size`` words, in order; none if there are fewer words."""
    w, n = F.col(words_column), F.size(words_column)
    return F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(
        F.lit(size), *(F.get(w, i + j) for j in range(size)))))


def _windows(items: DataFrame, item_id: str, item_text: str, window: int) -> tuple[DataFrame, DataFrame]:
    """The different windows (``win`` text, ``ws`` words) and which items have them."""
    split = items.select(F.col(item_id).alias("item_id"), words(F.col(item_text)).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    runs = split.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - size), lambda i: F.transform(
        F.sequence(F.lit(0), size - 1), lambda j: F.get(F.col("w"), i + j)))).alias("ws"))
    runs = checkpointed(runs.select("item_id", "ws", F.array_join("ws", " ").alias("win")).distinct())
    return runs.select("win", "ws").distinct(), runs.select("item_id", "win").where("item_id is not null").distinct()


def find_contamination(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                       item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: ``id``, ``h`` and ``n`` (hash and length of its text), ``n_words``, ``n_hit``, ``hit_positions``
    (sorted word positions inside any occurrence of a window), ``items`` (sorted ids as text of items with an occurring window).

    A window is ``window`` consecutive words of an item, or all words of a shorter one.  Its tokens are its
    shingles of ``shingle`` words (all its words if it has fewer).  1. Document shingles that any item has are kept, over all
    documents; their counts order shingles by rarity.  2. A window occurs only where its rarest shingle does, so
    that one token is its necessary prefix; windows with a shingle that no document has are gone.  3. Candidates start where
    the shingle's place in the window says (positional bound) and must end within the document (length bound).
    4. Candidates are compared word for word with the document's text.

    Only the item side is ever broadcast, and only if its measured size is small.  Null and empty texts have
    no words; items without words or without an id report nothing (windows of an item without id still
    hit); repeated items change nothing; rows of one id and text get the same result; other columns are not read.
    """
    windows, owners = _windows(items, item_id, item_text, window)
    size = F.least(F.size("ws"), F.lit(shingle))
    sizes = sorted(r[0] for r in windows.select(size).distinct().collect())   # at most ``shingle`` numbers
    docs = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"),
                       F.xxhash64(text_column).alias("h"), F.length(text_column).alias("n"))
    key = ["id", "h", "n"]

    in_window = None
    for s in sizes:
        part = windows.where(size == s).select("win", "ws", F.posexplode(_shingles("ws", s)).alias("off", "shingle"))
        in_window = part if in_window is None else in_window.union(part)
    if in_window is None:
        in_window = windows.select("win", "ws", F.lit(0).alias("off"), F.lit(0).cast("long").alias("shingle")).limit(0)
    in_window = checkpointed(in_window)
    # written, as are the other small sides: a join of two written tables can split a key that very many rows have
    vocabulary = checkpointed(in_window.select("shingle").distinct())
    owners = checkpointed(owners)

    tokens = docs.select(*key, words(F.col("text")).alias("w"))
    each = F.array(*(F.coalesce(_shingles("w", s), F.expr("cast(array() as array<bigint>)")) for s in sizes)) if sizes else \
        F.expr("cast(array() as array<array<bigint>>)")
    # one row more for each document, without a shingle, keeps its number of words: texts are cut into words once
    each = F.concat(each, F.array(F.array(F.lit(None).cast("long"))))
    known = vocabulary.withColumn("known", F.lit(True))
    seen = tokens.select(*key, F.size("w").alias("n_words"), F.explode(each).alias("hashes")).select(
        *key, "n_words", F.posexplode("hashes").alias("pos", "shingle"))
    seen = seen.join(F.broadcast(known) if is_small(vocabulary, 16) else known, "shingle", "left").where("known or shingle is null").drop("known")
    seen = checkpointed(seen)
    counted, seen = seen.where("shingle is null").select(*key, "n_words"), seen.where("shingle is not null")

    counts = seen.groupBy("shingle").agg(F.count("*").alias("count"))
    prefix = in_window.join(counts, "shingle", "left").groupBy("win").agg(
        F.min(F.coalesce("count", F.lit(0))).alias("least"),
        F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "shingle", "off")).alias("rarest"), F.first("ws").alias("ws"))
    prefix = checkpointed(prefix.where("least > 0").select("win", "ws", F.col("rarest.shingle").alias("shingle"), F.col("rarest.off").alias("off")))
    held = F.octet_length("win") * 2 + F.size("ws") * 16 + 64
    candidates = seen.join(F.broadcast(prefix) if fits(prefix, held) else prefix, "shingle")
    candidates = candidates.select(*key, "n_words", (F.col("pos") - F.col("off")).alias("start"), "win", "ws").where(
        (F.col("start") >= 0) & (F.col("start") + F.size("ws") <= F.col("n_words")))
    candidates = candidates.groupBy(*key).agg(F.collect_set(F.struct("start", "win", "ws")).alias("candidates"))
    candidates = checkpointed(candidates.select(*(F.col(k).alias(f"c_{k}") for k in key), "candidates"))

    met = [(F.col(k), F.col(f"c_{k}")) for k in key]
    checked = docs.join(F.broadcast(candidates.select("c_h").distinct()).withColumnRenamed("c_h", "b_h"), F.col("h") == F.col("b_h"), "left_semi") \
        if is_small(candidates, 16) else docs
    checked = checked.join(candidates, same(met)).dropDuplicates(key).select(*key, "text", "candidates")
    # the outer lambda binds the words, which would be split again for each candidate otherwise
    occurs = F.get(F.transform(F.array(words(F.col("text"))), lambda w: F.filter("candidates", lambda c: F.forall(
        F.sequence(F.lit(0), F.size(c["ws"]) - 1), lambda j: F.get(w, c["start"] + j) == F.get(c["ws"], j)))), F.lit(0))
    checked = checkpointed(checked.select(*key, F.transform(occurs, lambda c: F.struct(
        c["start"].alias("start"), F.size(c["ws"]).alias("size"), c["win"].alias("win"))).alias("found")).where(F.size("found") > 0))
    positions = F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda c: F.sequence(c["start"], c["start"] + c["size"] - 1)))))
    names = checked.select(*key, F.explode(F.array_distinct(F.transform("found", lambda c: c["win"]))).alias("win")).join(
        F.broadcast(owners) if fits(owners, F.octet_length("win") + 64) else owners, "win")
    names = names.groupBy(*key).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    names = names.select(*(F.col(k).alias(f"i_{k}") for k in key), "items")
    hits = checked.select(*key, positions.alias("hit_positions")).join(
        names, same([(F.col(k), F.col(f"i_{k}")) for k in key]), "left").select(
        *(F.col(k).alias(f"c_{k}") for k in key), "hit_positions", F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))
    hits = checkpointed(hits)

    return counted.join(hits, same(met), "left").select(
        *key, "n_words", F.coalesce(F.size("hit_positions"), F.lit(0)).alias("n_hit"),
        F.coalesce("hit_positions", F.expr("cast(array() as array<int>)")).alias("hit_positions"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))
