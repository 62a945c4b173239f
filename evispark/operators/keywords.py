"""Keyword search by BM25 over impact-ordered postings, and its fusion with vector hits.

Postings of a term are grouped by impact (what a posting adds to a score): sixteen levels, each cut into blocks of bounded size, so
that no term's postings are one task's.  A search first bounds what the k-th best score must be from the top blocks of each
term, then reads only blocks that can still lift a chunk over that bound, and completes the scores of what they hold.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpointed, shared_folder
from .search import rank_hits
from .sizes import fits, join_checked

TERM = r"[\p{L}\p{N}]+"
LEVELS, BLOCK_ROWS = 16, 1024
#: Of sums of the same impacts in another order, the difference at most; bounds are loosened by it.
SLACK = 1e-9
#: A search that has to read more rows than this share of its terms' postings, a row counted once per query, reads these all instead.
DENSE = 0.5
#: So many scores of chunks against queries are worked out at a time.
TILE = 1 << 19


def terms(text: Column) -> Column:
    """The terms of a text in order: runs of letters and digits in lower case; none for a null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def _stored(df: DataFrame) -> DataFrame:
    """The rows as a compact table in the shared folder; a checkpoint of them takes many times the bytes."""
    path = f"{shared_folder(df.sparkSession)}/keywords-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class KeywordIndex:
    """``postings``: term, level (0 is the highest impact), block, chunk_id, impact.  ``blocks``: term, level, blocks, n, top (the
    highest impact).  As built, both are views of two tables, which take a fraction of their bytes: how often a term stands in a chunk, and
    what is known of each term.  ``about`` then makes them for some terms alone (a frame of distinct ``term``), without all others being shuffled."""
    postings: DataFrame
    blocks: DataFrame
    about: Callable[[DataFrame], KeywordIndex] | None = None

    def write(self, folder: str) -> KeywordIndex:
        """The index as Parquet, postings by term and chunk, so that the statistics of a file tell its terms."""
        spark = self.postings.sparkSession
        self.postings.repartitionByRange("term", "level", "block").sortWithinPartitions("term", "level", "block", "chunk_id").write.parquet(f"{folder}/postings")
        self.blocks.write.parquet(f"{folder}/blocks")
        return KeywordIndex(spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/blocks"))

    @staticmethod
    def read(spark, folder: str) -> KeywordIndex:
        return KeywordIndex(spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/blocks"))


def _counted(chunks: DataFrame, text: str) -> DataFrame:
    """``term, chunk_id, length, tf``.  Terms are counted inside their row, so nothing is shuffled; only rows of one chunk id that
    have the same length are counted together."""
    repeated = checkpointed(chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("chunk_id").alias("twice")))
    again, side = None, chunks["chunk_id"].eqNullSafe(repeated["twice"])
    if not repeated.isEmpty():
        few = F.broadcast(repeated) if fits(repeated) else repeated
        again, chunks = chunks.join(few, side, "left_semi"), chunks.join(few, side, "left_anti")

    def split(rows: DataFrame) -> DataFrame:
        return rows.select("chunk_id", terms(F.col(text)).alias("w")).select("chunk_id", F.size("w").alias("length"), "w")

    ordered = split(chunks).select("chunk_id", "length", F.sort_array("w").alias("w"))
    begins = F.filter(F.transform("w", lambda x, i: F.when((i == 0) | (F.get("w", i - 1) != x), F.struct(x.alias("term"), i.alias("at")))), lambda s: s.isNotNull())
    sizes = F.transform("s", lambda s, j: F.struct(s["term"].alias("term"), (F.coalesce(F.get("s", j + 1)["at"], F.col("length")) - s["at"]).cast("long").alias("tf")))
    found = ordered.select("chunk_id", "length", begins.alias("s")).select("chunk_id", "length", F.inline(sizes)).select("term", "chunk_id", "length", "tf")
    if again is None:
        return found
    exploded = split(again).select("chunk_id", "length", F.explode("w").alias("term"))
    return found.union(exploded.groupBy("term", "chunk_id", "length").agg(F.count(F.lit(1)).alias("tf")))


def build_index(chunks: DataFrame, text: str = "text", k1: float = 1.2, b: float = 0.75, block_rows: int = BLOCK_ROWS) -> KeywordIndex:
    """Postings of ``chunk_id`` and a text.  Impact: ``idf * tf (k1 + 1) / (tf + k1 (1 - b + b length / mean length))`` with
    ``idf = ln(1 + (N - df + 0.5) / (df + 0.5))``.  Chunks without terms count for N and the mean length."""
    counted = _stored(_counted(chunks, text))       # the only pass over the texts
    n, size = chunks.count(), counted.agg(F.sum("tf")).first()[0] or 0
    mean = size / n if n else 0.0
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(float(mean or 1.0) or 1.0)))
    weighed = counted.select("term", "chunk_id", tf.alias("weight"))
    stats = weighed.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("weight").alias("most"))
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    stats = _stored(stats.select("term", idf.alias("idf"), (idf * F.col("most")).alias("best")))

    def of(known: DataFrame, kept: Callable[[DataFrame], DataFrame], join: Callable[..., DataFrame]) -> KeywordIndex:
        met = join_checked(weighed, known, "term").withColumn("impact", F.col("idf") * F.col("weight"))
        level = F.least(F.floor((1 - F.col("impact") / F.col("best")) * LEVELS), F.lit(LEVELS - 1)).cast("int")
        levelled = met.select("term", level.alias("level"), "chunk_id", "impact")
        blocks = kept(levelled.groupBy("term", "level").agg(F.count(F.lit(1)).alias("n"), F.max("impact").alias("top")).withColumn(
            "blocks", F.ceil(F.col("n") / block_rows).cast("int")))
        dealt = join(levelled, blocks.where("blocks > 1").select("term", "level", "blocks"), ["term", "level"], "left")
        block = F.pmod(F.xxhash64("chunk_id"), F.coalesce("blocks", F.lit(1))).cast("int")
        return KeywordIndex(dealt.select("term", "level", block.alias("block"), "chunk_id", "impact"), blocks)

    def about(asked: DataFrame) -> KeywordIndex:
        return of(checkpointed(stats.join(F.broadcast(asked) if fits(asked) else asked, "term")), checkpointed, join_checked)

    whole = of(stats, lambda df: df, DataFrame.join)
    return KeywordIndex(whole.postings, whole.blocks, about)


def _best_of(numbers: np.ndarray, begins: np.ndarray, ids: pa.Array, k: int):
    """For ``mapInArrow`` over ``chunk_id, number, impact`` in the order of chunks: the k best chunks of a task for every query.

    The queries that ask for term ``t`` are ``numbers[begins[t]:begins[t + 1]]``, places in ``ids``.  Chunks are scored some at a time
    against all queries, so memory depends on the queries and k alone; of equal scores the chunk that comes first stays.
    """
    n = len(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, chunk, kind = np.full((k, n), -1.0), np.full((k, n), None, object), None
        held, held_id = None, None      # of the chunk that the last batch ended in

        def take(found: np.ndarray, names: list) -> None:
            rounded = np.where(found > 0, np.floor(found * 1e6 + 0.5) / 1e6, -1.0)
            at = np.flatnonzero((rounded > scores[-1]).any(0))
            if len(at):
                every = np.concatenate([scores[:, at], rounded[:, at]])
                order = np.argsort(-every, axis=0, kind="stable")[:k]
                labels = np.empty(len(names), object)
                labels[:] = names
                own = np.take_along_axis(chunk[:, at], np.minimum(order, k - 1), 0)
                chunk[:, at] = np.where(order < k, own, labels[np.maximum(order - k, 0)])
                scores[:, at] = np.take_along_axis(every, order, 0)

        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.column("chunk_id").type
            runs = pc.run_end_encode(batch.column("chunk_id"))
            ends, names = runs.run_ends.to_numpy(), runs.values.to_pylist()
            term, impact = batch.column("number").to_numpy(), batch.column("impact").to_numpy()
            step = max(1, TILE // n)
            for first in range(0, len(ends), step):
                last = min(first + step, len(ends))
                low, high = ends[first - 1] if first else 0, ends[last - 1]
                size = begins[term[low:high] + 1] - begins[term[low:high]]
                row = np.repeat(np.searchsorted(ends[first:last], np.arange(low, high), "right"), size)
                place = np.repeat(begins[term[low:high]] - np.cumsum(size) + size, size) + np.arange(size.sum())
                found = np.bincount(row * n + numbers[place], np.repeat(impact[low:high], size), (last - first) * n).reshape(-1, n)
                own = names[first:last]
                if held is not None and held_id == own[0]:
                    found[0] += held
                elif held is not None:
                    take(held[None], [held_id])
                take(found[:-1], own[:-1])
                held, held_id = found[-1].copy(), own[-1]
        if held is not None:
            take(held[None], [held_id])
            rank, query = np.nonzero(scores >= 0)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(query)), pa.array(list(chunk[rank, query]), kind), pa.array(scores[rank, query])],
                                             ["query_id", "chunk_id", "score"])
    return run


def _scored_whole(asked: DataFrame, index: KeywordIndex, k: int) -> DataFrame:
    """All postings of the asked terms, each chunk's together: the scores of the k best chunks of each task."""
    spark, columns = asked.sparkSession, {"query_id": asked.schema["query_id"], "chunk_id": index.postings.schema["chunk_id"]}
    rows = asked.select("query_id", "term").toArrow()
    own, names = (rows[c].combine_chunks().dictionary_encode(null_encoding="encode") for c in ("query_id", "term"))
    order = np.argsort(names.indices.to_numpy(), kind="stable")
    begins = np.concatenate([[0], np.cumsum(np.bincount(names.indices.to_numpy(), minlength=len(names.dictionary)))])
    numbered = spark.createDataFrame(pa.table({"term": names.dictionary, "number": pa.array(np.arange(len(names.dictionary)), pa.int32())}))
    met = index.postings.select("chunk_id", "term", "impact").join(F.broadcast(numbered), "term").select("chunk_id", "number", "impact")
    schema = T.StructType([*columns.values(), T.StructField("score", T.DoubleType())])
    return met.repartition("chunk_id").sortWithinPartitions("chunk_id").mapInArrow(
        _best_of(own.indices.to_numpy().astype(np.int64)[order], begins, own.dictionary, k), schema)


def keyword_search(queries: DataFrame, index: KeywordIndex, k: int = 5) -> DataFrame:
    """``(query_id, rank, chunk_id, score)``: the k chunks of highest BM25 score per query (``query_id, query``), exactly.

    A repeated term of a query counts once.  Chunks without any of the terms are no hits; equal scores are ordered by chunk id.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("query")))).alias("term"))
    if index.about:
        asked = checkpointed(asked)
        index = index.about(asked.select("term").distinct())
    most = index.blocks.groupBy("term").agg(F.max("top").alias("best"))
    asked = checkpointed(asked.join(most, "term"))
    levels = checkpointed(index.blocks.join(asked.select("term").distinct(), "term", "left_semi"))   # at most 16 rows a term

    # A bound for the k-th best score: the partial sums of the first block of each term's top levels, which hold k postings or more.
    upto = Window.partitionBy("term").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    first = levels.withColumn("before", F.coalesce(F.sum(F.ceil(F.col("n") / F.col("blocks"))).over(upto), F.lit(0))).where(F.col("before") < 2 * k)
    seeds = checkpointed(asked.join(first.select("term", "level"), "term").withColumn("block", F.lit(0)).select("query_id", "term", "level", "block"))
    partial = join_checked(index.postings, seeds, ["term", "level", "block"]).groupBy("query_id", "chunk_id").agg(
        F.sum("impact").alias("score"))
    bound = rank_hits(partial, k).where(F.col("rank") == k).select("query_id", (F.col("score") - SLACK).alias("bound"))

    # Terms that together can't reach the bound bring no chunk of their own; of the others, levels that can't, either.
    weakest = Window.partitionBy("query_id").orderBy("best", "term").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("query_id")
    judged = asked.join(checkpointed(bound), "query_id", "left").withColumns({
        "bound": F.coalesce("bound", F.lit(0.0)), "reach": F.sum("best").over(weakest), "rest": F.sum("best").over(whole) - F.col("best")})
    read = checkpointed(judged.where(F.col("reach") >= F.col("bound")).join(levels, "term").where(F.col("top") + F.col("rest") >= F.col("bound")).select(
        "query_id", "term", "level", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")))
    size = F.sum(F.col("n") / F.col("blocks"))
    wide = read.join(index.blocks, ["term", "level"]).agg(size).first()[0] or 0
    if wide > DENSE * (levels.agg(F.sum("n")).first()[0] or 0):
        # Long questions leave little to skip: each chunk's postings stay together and meet the terms of all queries there.
        if fits(asked.select("query_id", "term")):
            return rank_hits(_scored_whole(asked, index, k), k).select("query_id", "rank", "chunk_id", "score")
        met = index.postings.select("chunk_id", "term", "impact").repartition("chunk_id")
        scored = join_checked(met, asked.select("query_id", "term"), "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum("impact"), 6).alias("score"))
        return rank_hits(scored, k).select("query_id", "rank", "chunk_id", "score")
    found = index.postings.join(read, ["term", "level", "block"]).select("query_id", "chunk_id").distinct()
    wanted = found.join(asked.select("query_id", "term"), "query_id")
    scored = index.postings.join(wanted, ["chunk_id", "term"]).groupBy("query_id", "chunk_id").agg(F.round(F.sum("impact"), 6).alias("score"))
    return rank_hits(scored, k).select("query_id", "rank", "chunk_id", "score")


def fuse(lists: dict[str, DataFrame], k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (``query_id, rank, chunk_id``): a hit scores ``1 / (constant + rank)`` in each.

    Returns ``query_id, rank, chunk_id, score, total_candidates`` and the rank in each list (``<name>_rank``, null if not in it).
    """
    parts = None
    for name, hits in lists.items():
        part = hits.select("query_id", "chunk_id", F.lit(name).alias("list"), F.col("rank").alias("at"))
        parts = part if parts is None else parts.unionByName(part)
    ranks = [F.max(F.when(F.col("list") == n, F.col("at"))).alias(f"{n}_rank") for n in lists]
    merged = parts.groupBy("query_id", "chunk_id").agg(*ranks)
    shares = [F.coalesce(1 / (constant + F.col(f"{n}_rank")), F.lit(0.0)) for n in lists]
    merged = merged.withColumn("score", F.round(sum(shares[1:], shares[0]), 9)).withColumn(
        "total_candidates", F.count(F.lit(1)).over(Window.partitionBy("query_id")))      # at most the lists' horizons per query
    return rank_hits(merged, k).select("query_id", "rank", "chunk_id", "score", "total_candidates", *(f"{n}_rank" for n in lists))
