"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed, shared_folder, small_batches  # noqa: F401

BROADCAST_BYTES = 16 << 20
BLOCK_BYTES = 1 << 20

# Words of letters, digits and all characters past ASCII, in lower-cased text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is; pure ASCII takes the fast way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The words of a text in order; none for a null."""
    return F.regexp_extract_all(F.coalesce(ascii_lower(text), F.lit("")), F.lit(WORD), F.lit(0))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def is_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """True if all rows together, at ``row_bytes`` each, stay under the limit; reads no more than it must."""
    most = limit // row_bytes
    return df.select(F.lit(1)).limit(most + 1).count() <= most


def fits(df: DataFrame, row_bytes: Column, limit: int = BROADCAST_BYTES) -> bool:
    """True if the measured bytes of all rows together stay under the limit."""
    return (df.agg(F.sum(row_bytes)).first()[0] or 0) <= limit


def same(pairs: list[tuple[Column, Column]]) -> Column:
    """Null-safe equality of several columns."""
    return reduce(lambda a, b: a & b, (x.eqNullSafe(y) for x, y in pairs))


def joined_rows(rows: Column) -> Column:
    return F.array_join(rows, ",")


def word_blocks(data: bytes, size: int = 1) -> Iterator[list[bytes]]:
    """Words of a text, a block at a time; each list begins with the last ``size - 1`` words of the one before."""
    begin, last = 0, []
    while begin < len(data):
        end = begin + BLOCK_BYTES
        while end < len(data) and not data[end:end + 1].isspace():
            end += 1
        part = last + data[begin:end].split()
        yield part
        last, begin = part[max(0, len(part) - size + 1):], end


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder.  Unlike a checkpoint, which keeps the size that its plan was estimated at, the
    table has its real size: in a loop over joins the estimates square with every step, until planning takes longer than all tasks."""
    return _table(df, shared_folder(df.sparkSession))


def _table(df: DataFrame, folder: str) -> DataFrame:
    path = f"{folder}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)     # without its schema, a job would read it from the files


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Like ``written``, in a folder of the shared one that is removed at the end: what stays has to be written elsewhere before.

    A table is read in as many tasks as its bytes need.  A checkpoint keeps the partitions of its last exchange, however little
    they hold, and the next exchange writes files for each of them."""
    folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    try:
        yield lambda df: _table(df, folder)
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, cut: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """Connected components: ``a``, ``b`` longs -> ``node``, ``component`` (its smallest node), for every node of an edge.

    Alternating large-star and small-star steps.  A hub's neighbours are never brought into one
    task: minima are combined before the shuffle and written, and the join to them splits skewed keys.
    ``cut`` cuts the lineage of the edges after each step: ``written`` where the graph may take many of them.
    """
    edges = cut(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _settled(edges):
        edges = _star(_star(edges, True, cut), False, cut)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select("b", "b")).distinct()


def _settled(edges: DataFrame) -> bool:
    """True if every greater end has one edge and is no lesser end: the lesser ones are then the components, and no further step is
    needed to see that nothing changes."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("greater"), F.lit(0).alias("lesser")),
                                         F.struct(F.col("b").alias("node"), F.lit(0).alias("greater"), F.lit(1).alias("lesser")))))
    return ends.groupBy("node").agg(F.sum("greater").alias("greater"), F.max("lesser").alias("lesser")).where(
        "greater > 1 or greater + lesser > 1").isEmpty()


def _star(edges: DataFrame, large: bool, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``edges`` has a > b.  Large: every node sends its greater neighbours to the least of all; small: itself and its lesser ones."""
    seen = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        seen = seen.union(edges.select("b", "a"))
    least = cut(seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    sent = seen.where("v > u") if large else seen
    new = sent.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        new = new.union(least.select("u", "m"))
    return cut(new.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
