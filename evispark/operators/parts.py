"""Windows over keys of any size: bounded parts, overlap rows, running state.

A window partitioned by key alone puts a hot key into one task.  Here a key's rows
are cut into parts of ``SPAN`` positions.  A window that looks back a few rows gets
those rows copied into the next part; a running aggregate gets the combined state
of the parts before, which is one row per part.  ``pos`` orders the rows of
a key, as turns and steps are numbered; it may have gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 1024


def with_places(df: DataFrame, key: str, pos: str, span: int = SPAN) -> DataFrame:
    """Add ``_pos``: the row's place (0, 1, 2, ...) in its key by ``pos``, which may have gaps.

    Rows are counted per stretch of ``span`` positions, and numbered inside it.
    """
    cut = df.withColumn("_stretch", F.floor(F.col(pos) / span))
    earlier = Window.partitionBy(key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    base = cut.groupBy(key, "_stretch").agg(F.count(F.lit(1)).alias("_n")).select(
        F.col(key).alias("_key"), F.col("_stretch").alias("_at"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(key, "_stretch").orderBy(pos)
    return cut.withColumn("_i", F.row_number().over(inside) - 1).join(
        base, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_stretch") == F.col("_at"))).withColumn(
        "_pos", F.col("_base") + F.col("_i")).drop("_stretch", "_i", "_base", "_key", "_at")


def with_overlap(df: DataFrame, key: str, pos: str, back: int, span: int = SPAN, long: bool | None = None) -> DataFrame:
    """Add ``_pos`` (place in the key), ``_part`` and ``_own``; the last ``back`` rows of a part also enter the next.

    Parts are cut by place, not by ``pos``: gaps in ``pos`` lose no row.  ``back`` must not exceed ``span``.
    """
    if not (has_long(df, pos, span) if long is None else long):
        whole = Window.partitionBy(key).orderBy(pos)
        return df.withColumns({"_pos": F.row_number().over(whole) - 1, "_part": F.lit(0).cast("long"), "_own": F.lit(True)})
    placed = with_places(df, key, pos, span)
    part = F.floor(F.col("_pos") / span)
    parts = F.when(F.col("_pos") % span >= span - back, F.array(part, part + 1)).otherwise(F.array(part))
    # A literal list of parts per row, exploded: one copy for all but span edges.
    out = placed.withColumn("_part", F.explode(parts))
    return out.withColumn("_own", F.col("_part") == part)


def part_window(key: str, pos: str) -> Window:
    return Window.partitionBy(key, "_part").orderBy(pos)


def has_long(df: DataFrame, pos: str, span: int = SPAN) -> bool:
    """Whether any position lies beyond the first part (on a table, a test the scan can answer)."""
    return df.where(F.col(pos) >= span).limit(1).count() > 0


def running(df: DataFrame, key: str, pos: str, states: dict[str, tuple[str, Column]],
            inclusive: bool = True, span: int = SPAN, long: bool | None = None) -> DataFrame:
    """Add running columns: ``last`` (non-null), ``or`` (bits), ``count`` (sum of a number).

    With ``inclusive=False`` the row itself is left out.  ``long`` tells whether any key
    has more than one part; unless given, it is looked up in ``df``.
    """
    df = df.withColumns({"_part": F.floor(F.col(pos) / span), **{f"_v_{n}": c for n, (_, c) in states.items()}})
    upto = part_window(key, pos).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)

    def over(kind: str, col: Column, window) -> Column:
        if kind == "last":
            return F.last(col, ignorenulls=True).over(window)
        return (F.bit_or(col) if kind == "or" else F.sum(col)).over(window)

    within = df.withColumns({f"_r_{n}": over(kind, F.col(f"_v_{n}"), upto) for n, (kind, _) in states.items()})
    # Long keys are rare; a second pass is planned only where there are any.
    if not (has_long(df, pos, span) if long is None else long):
        before = {n: F.lit(None) for n in states}
    else:
        def total(kind: str, col: Column) -> Column:
            if kind == "last":
                return F.max_by(col, F.when(col.isNotNull(), F.col(pos)))
            return F.bit_or(col) if kind == "or" else F.sum(col)

        sums = df.groupBy(key, "_part").agg(*[total(kind, F.col(f"_v_{n}")).alias(f"_t_{n}")
                                              for n, (kind, _) in states.items()])
        earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        prefix = sums.select(key, "_part", *[over(kind, F.col(f"_t_{n}"), earlier).alias(f"_p_{n}")
                                             for n, (kind, _) in states.items()]).where("_part > 0")
        within = within.join(prefix, [key, "_part"], "left")
        before = {n: F.col(f"_p_{n}") for n in states}

    def combined(name: str, kind: str) -> Column:
        here, earlier_ = F.col(f"_r_{name}"), before[name]
        if kind == "last":
            return F.coalesce(here, earlier_)
        zero = F.lit(0).cast("long")
        a, b = F.coalesce(here.cast("long"), zero), F.coalesce(earlier_.cast("long"), zero)
        return a.bitwiseOR(b) if kind == "or" else a + b

    out = within.withColumns({n: combined(n, kind) for n, (kind, _) in states.items()})
    return out.drop(*[c for c in out.columns if c == "_part" or c[:3] in ("_v_", "_r_", "_p_")])
