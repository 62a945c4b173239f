"""Checked broadcasts: a side is broadcast only after its size was measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
ROW_BYTES = 16


def _bytes(column: Column, kind: T.DataType) -> Column:
    """About what a value takes in memory."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(column) + 16
    elif isinstance(kind, T.StructType):
        size = sum((_bytes(column[f.name], f.dataType) for f in kind.fields), F.lit(ROW_BYTES))
    elif isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.StructType, T.ArrayType, T.MapType)):
        size = F.size(column) * 8 + ROW_BYTES
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        size = 2 * F.length(F.to_json(F.struct(column.alias("v")))) + ROW_BYTES
    else:
        return F.lit(8)
    return F.coalesce(size, F.lit(8))


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True if the frame has at most ``max_rows`` rows of at most ``max_bytes`` in all, as measured; reads no more rows than it must."""
    width = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(ROW_BYTES))
    n, size = df.select(width.cast("long").alias("w")).limit(max_rows + 1).agg(F.count("*"), F.sum("w")).first()
    return n <= max_rows and (size or 0) <= max_bytes


def join_checked(left: DataFrame, right: DataFrame, on, how: str = "inner",
                 max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with the right side broadcast if it is small, a shuffle join (AQE splits
    skewed keys) otherwise."""
    return left.join(F.broadcast(right) if fits(right, max_rows) else right, on, how)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input of few splits; leave an input with enough of them alone.

    A table of one small file is one task, however heavy the work on its rows.  With
    more splits than cores the extra shuffle would only cost, so there is none.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores) if df.rdd.getNumPartitions() <= cores else df


def dealt(df: DataFrame) -> DataFrame:
    """The same with one task per core, for work whose tasks each send a result of their own."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
